"""Bootstrap by vectors of weights against replicates that are drawn out in full."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from failscope.operators import resampling as rs


def test_weights_are_poisson_and_unlike_by_row_and_replicate():
    w = rs.weights(np.arange(3000, dtype=np.int64) * 7919, 2001)
    assert w.shape == (3000, 2001) and abs(w.mean() - 1) < 0.003 and abs(w.var() - 1) < 0.01
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.1
    assert (w[5:9] == rs.weights(np.arange(5, 9, dtype=np.int64) * 7919, 2001)).all()


def table(spark, n=700, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, float(np.round(rng.normal(3 + (i % 2), 2), 2)), "ab"[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, "a"), (n + 1, float("nan"), "b"), (n + 2, 5.0, None)], "k bigint, v double, g string"), rows


def plain(spark, df, statistic, side):
    """(replicate, statistic) by the definition from the same weights."""
    got = df.where(F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")).select(F.xxhash64(F.col("k").cast("string")).alias("h"), "v", "g").toPandas()
    got = got[got["g"].isin(list(side))]
    w, v = rs.weights(got["h"].to_numpy(), 200), got["v"].to_numpy()
    if statistic == "mean":
        return (w * v[:, None]).sum(axis=0) / w.sum(axis=0)
    out = []
    for r in range(200):
        x = np.sort(np.repeat(v, w[:, r]))
        out.append(x.std(ddof=1) if statistic == "std" else x[int(np.ceil(len(x) * 0.5)) - 1])
    return np.array(out)


@pytest.mark.parametrize("statistic", ["mean", "std", "median"])
def test_replicates_equal_rows_that_are_drawn_out(spark, statistic):
    df, _ = table(spark)
    got = rs.replicated(df.where("g is not null"), "v", "k", statistic=statistic, replicates=200, range_rows=60).orderBy("replicate").toPandas()["stat"]
    assert np.allclose(got, plain(spark, df, statistic, "ab"))
    got = rs.replicated(df.repartition(7), "v", "k", "g", "b", "a", statistic, replicates=200, range_rows=60).orderBy("replicate").toPandas()["stat"]
    assert np.allclose(got, plain(spark, df, statistic, "b") - plain(spark, df, statistic, "a"))


def test_intervals(spark):
    df, rows = table(spark, 2000)
    x = np.array([v for _, v, _ in rows])
    r = rs.bootstrap(df.where("g is not null"), "v", "k").first()
    se = x.std(ddof=1) / np.sqrt(len(x))
    assert abs(r.estimate - x.mean()) < 1e-5 and abs((r.high - r.low) / (2 * 1.96 * se) - 1) < 0.1 and r.significant
    d = rs.bootstrap(df, "v", "k", "g", "b", "a", "median").first()
    assert d.low < d.estimate < d.high and d.significant and 0.5 < d.estimate < 1.5
    none = rs.bootstrap(df.limit(0), "v", "k", replicates=20).first()
    assert none.estimate is None and none.low is None
    one = rs.bootstrap(spark.createDataFrame([(1, 4.0)], "k int, v double"), "v", "k", replicates=50).first()
    assert (one.low, one.high) == (4.0, 4.0)


def test_intervals_cover_the_mean_about_as_often_as_they_say():
    rng, hit = np.random.default_rng(3), 0
    for t in range(400):
        v = rng.exponential(1.0, 150)
        w = rs.weights(rng.integers(1 << 62, size=150), 400).astype(float)
        low, high = np.quantile((w * v[:, None]).sum(axis=0) / w.sum(axis=0), [0.025, 0.975])
        hit += low <= 1.0 <= high
    assert 0.90 <= hit / 400 <= 0.98

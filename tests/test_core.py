"""Multi-level prefix scans and quantiles against plain sums, at every number of ranges and levels."""

import random
from collections import defaultdict

import numpy as np
import pytest

from failscope.functions import core


def histogram(seed, n=400):
    rng = random.Random(seed)
    groups = ["a"] * 8 + ["b", None]  # one group holds most rows
    return sorted({(rng.choice(groups), float(rng.randrange(10_000))): rng.randrange(0, 9) for _ in range(n)}.items(), key=str)


@pytest.mark.parametrize("rows, level", [(1 << 18, 4096), (50, 4096), (7, 4), (3, 2)])
def test_prefix_sums_by_group(spark, rows, level):
    hist = histogram(rows)
    df = spark.createDataFrame([(g, v, n, 1) for (g, v), n in hist], "g string, v double, n bigint, one int")
    got = {(r.g, r.v): (r.n, r.cum_n, r.cum_one) for r in core.prefix_sums(df, ["g"], "v", ["n", "one"], rows, level).collect()}
    want, n_, one = {}, defaultdict(int), defaultdict(int)
    for (g, v), n in sorted(hist, key=lambda x: x[0][1]):
        n_[g] += n
        one[g] += 1
        want[g, v] = (n, n_[g], one[g])
    assert got == want
    whole = {(r.g, r.v): r.cum_n for r in core.prefix_sums(df, [], "v", ["n"], rows, level).collect()}
    assert max(whole.values()) == sum(n for _, n in hist)


@pytest.mark.parametrize("rows, level", [(1 << 18, 4096), (9, 4), (2, 2)])
def test_suffix_min(spark, rows, level):
    rng = random.Random(1)
    table = [(float(v), rng.random()) for v in rng.sample(range(5000), 120)]
    got = {r.v: r.min_x for r in core.suffix_min(spark.createDataFrame(table, "v double, x double"), "v", "x", rows, level).collect()}
    assert got == {v: min(x for w, x in table if w >= v) for v, _ in table}


def test_quantiles_equal_linear_interpolation(spark):
    rng = np.random.default_rng(2)
    values = {g: np.round(rng.normal(size=n), 2) for g, n in (("a", 500), ("b", 1), (None, 7))}
    rows = [(g, float(v), int(n)) for g, x in values.items() for v, n in zip(*np.unique(x, return_counts=True))] + [("a", None, 3)]
    df = spark.createDataFrame(rows, "g string, v double, n bigint")
    at = [0.0, 0.1, 0.5, 0.9, 1.0]
    for size in (1 << 18, 20):
        got = {r.g: r.q for r in core.quantiles(df, ["g"], "v", at, size).collect()}
        assert got.keys() == values.keys() and all(np.allclose(got[g], np.quantile(x, at)) for g, x in values.items())
    assert core.quantiles(df.limit(0), [], "v", [0.5]).first().q == [None]
    assert core.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_a_written_table_is_written_once(spark):
    df = core.written(spark.range(5))
    assert core.written(df) is df and df.count() == 5
    plan = core.prefix_sums(df, [], "id", ["id"])._jdf.queryExecution().toString()
    assert "Range" not in plan


def test_a_local_warehouse_is_refused_on_a_cluster():
    class Fake:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "file:/tmp/warehouse" if "warehouse" in key else default

        class sparkContext:
            master, applicationId = "spark://far:7077", "x"

    with pytest.raises(ValueError):
        core.shared_dir(Fake)
    Fake.sparkContext.master = "local[2]"
    assert core.shared_dir(Fake).startswith("file:/tmp/warehouse/")

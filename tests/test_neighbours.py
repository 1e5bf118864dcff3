"""Exact nearest neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from failscope.operators import fairness as fa
from failscope.operators import neighbours as nb
from failscope.plans import registry


def brute(rows, k):
    fine = [(key, np.array(x, float)) for key, *x in rows if key is not None and all(v is not None and not np.isnan(v) for v in x)]
    keys, x, out = np.array([key for key, _ in fine]), np.stack([v for _, v in fine]), []
    for i in range(len(fine)):
        d = sum((x[:, c] - x[i, c]) ** 2 for c in range(x.shape[1]))
        order = [j for j in np.lexsort((keys, d)) if j != i][:k]
        out += [(int(keys[i]), r, int(keys[j]), float(d[j])) for r, j in enumerate(order, 1)]
    return sorted(out)


def rows_of(seed, n, dim, kind="mixed"):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)), 2 if kind == "mixed" else 6)
    if kind == "skewed":
        x = np.exp(3 * x)
    x[: n // 4] = x[0]  # a quarter is equal
    rows = [(7 * i, *map(float, v)) for i, v in enumerate(x)]
    return rows + [(10_000_001, None, *[1.0] * (dim - 1)), (10_000_002, float("nan"), *[1.0] * (dim - 1)), (None, *[1.0] * dim)]


@pytest.mark.parametrize("n, dim, kind, leaf, tile", [(2000, 2, "mixed", 64, 2048), (600, 3, "skewed", 16, 7), (300, 1, "mixed", 10, 5), (40, 2, "mixed", 1024, 2048)])
def test_equals_all_pairs(spark, n, dim, kind, leaf, tile):
    rows, names = rows_of(n, n, dim, kind), [f"f{i}" for i in range(dim)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in names))
    got = sorted((r.id, r["rank"], r.neighbour, r.d2) for r in nb.nearest(df, names, "id", 5, leaf, tile).collect())
    want = brute(rows, 5)
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0)], "id int, x double")
    assert sorted((r.id, r["rank"], r.neighbour) for r in nb.nearest(df, ["x"], "id").collect()) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]
    assert nb.nearest(df.limit(1), ["x"], "id").count() == 0 and nb.nearest(df.limit(0), ["x"], "id").count() == 0


def test_equal_rows_are_not_compared_with_each_other(spark, monkeypatch):
    df = spark.range(10_000).select(F.col("id").alias("k"), F.lit(1.0).alias("x"), (F.col("id") % 2).cast("double").alias("p"))
    got = nb.nearest(df, ["x"], "k").collect()
    assert len(got) == 50_000 and {r.neighbour for r in got} == set(range(6)) and {r.d2 for r in got} == {0.0}


def test_consistency_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.integers(0, 40)), float(rng.integers(0, 900)), float(rng.random())) for i in range(500)]
    rows += [(900, None, 1.0, 0.5), (901, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "k int, a double, b double, p double")
    fine = rows[:500]
    lo, hi = np.min([r[1:3] for r in fine], axis=0), np.max([r[1:3] for r in fine], axis=0)
    near, y = brute([(r[0], *(np.array(r[1:3]) - lo) / (hi - lo)) for r in fine], 5), {r[0]: r[3] for r in rows}
    want = 1 - np.mean([abs(y[a] - y[b]) for a, _, b, _ in near])
    got = fa.individual(df, ["a", "b"], "p", "k").first()
    assert abs(got.consistency - want) < 1e-6 and got.passes == (want >= 0.8)


def test_values_of_neighbours_come_with_them(spark):
    rows, names = rows_of(3, 400, 2), ["x0", "x1"]
    fine = [r for r in rows if None not in r and not any(np.isnan(v) for v in r[1:])]
    df = spark.createDataFrame([(k, float(k % 11), *x) for k, *x in fine], "k bigint, v double, x0 double, x1 double")
    got = {r.k: r for r in nb.near_lists(df, 2, 5, 16, 9).collect()}
    assert set(got) == {r[0] for r in fine} and all(r.v == r.k % 11 and all(n.v == n.k % 11 for n in r.near) for r in got.values())
    assert sorted((k, i, n.k) for k, r in got.items() for i, n in enumerate(r.near, 1)) == [w[:3] for w in brute(fine, 5)]


def test_pairs_meet_no_join_and_draws_use_all_cores(spark, monkeypatch):
    got = []
    monkeypatch.setattr(fa, "individual", lambda df, *a: got.append(df) or df)
    registry.queries()["fa7_individual"](spark, "/root/testdata/sf0.001")
    assert got[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # one file of one split
    monkeypatch.undo()
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, *map(float, rng.random(3))) for i in range(300)], "k bigint, a double, b double, p double")
    plan = fa.individual(df, ["a", "b"], "p", "k")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "tiles" not in line and "leaf" not in line]

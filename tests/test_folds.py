"""Folds by sufficient statistics against models that are fitted again."""

import numpy as np
from pyspark.sql import functions as F

from failscope.operators import folds as fo
from failscope.operators import models as bm
from failscope.operators import noise as ln


def table(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 1000, 0.01] + [5, 1e6, 0]
    y = 3 * x[:, 0] - 0.002 * x[:, 1] + rng.normal(size=n)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows + [(n, None, 1.0, 1.0, 1.0), (n + 1, 1.0, 1.0, 1.0, None)], "row_id int, a double, b double, c double, y double")


def refit(x, y, reg):
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / sd
    beta = np.linalg.solve(z.T @ z / len(z) + reg * np.eye(x.shape[1]), z.T @ (y - y.mean()) / len(z))
    return lambda t: (t - x.mean(axis=0)) / sd @ beta + y.mean()


def test_folds_and_grids_equal_refits(spark):
    df = table(spark)
    features, grid = ["a", "b", "c"], [0.0, 0.01, 0.1, 0.3, 1.0, 2.0, 3.0, 5.0, 8.0, 10.0]
    p = df.dropna().select("row_id", *features, "y", fo.fold_of("row_id", 5).alias("f"), fo.fold_of("row_id", 5, "outer").alias("o"), fo.fold_of("row_id", 3, "inner").alias("i")).toPandas()
    x, y = p[features].to_numpy(), p["y"].to_numpy()
    rmse = lambda train, test, reg: float(np.sqrt(np.mean((y[test] - refit(x[train], y[train], reg)(x[test])) ** 2)))
    got = {r.fold: r for r in fo.ridge_folds(df, features, "y", reg=0.2).collect()}
    want = [rmse((p["f"] != f).to_numpy(), (p["f"] == f).to_numpy(), 0.2) for f in range(5)]
    assert np.allclose([got[f].rmse for f in range(5)], want, atol=1e-6) and abs(got[0].mean - np.mean(want)) < 1e-6
    assert sum(r.n for r in got.values()) == 600
    for r in fo.ridge_nested(df, features, "y", grid).collect():
        out = (p["o"] != r.fold).to_numpy()
        tried = [np.mean([rmse(out & (p["i"] != i).to_numpy(), out & (p["i"] == i).to_numpy(), g) for i in range(3)]) for g in grid]
        assert r.reg == grid[int(np.argmin(tried))] and abs(r.rmse - rmse(out, ~out, r.reg)) < 1e-6
    parts = {f: m for (f,), m in fo.moments(df.dropna().withColumn("f", fo.fold_of("row_id", 5)), ["f"], [*features, "y"]).items()}
    w, b = fo.ridge(fo.together([m for f, m in parts.items() if f]), 0.0)
    assert np.allclose(x @ w + b, refit(x[(p["f"] != 0).to_numpy()], y[(p["f"] != 0).to_numpy()], 0.0)(x), rtol=1e-8)


def test_one_scan_for_all_folds(spark, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/t")
    df, jobs = spark.read.parquet(f"{tmp_path}/t"), []
    plain, fo.moments = fo.moments, lambda *a: (jobs.append(a[0]), plain(*a))[1]
    try:
        fo.ridge_nested(df, ["a", "b", "c"], "y", [0.0, 1.0, 2.0])
    finally:
        fo.moments = plain
    assert len(jobs) == 1


def test_constant_dependent_and_missing(spark):
    df = spark.createDataFrame([(i, 1.0, float(i), 2.0 * i, 4.0 * i + 1) for i in range(50)], "row_id int, a double, b double, c double, y double")
    assert all(r.rmse < 1e-4 for r in fo.ridge_folds(df, ["a", "b", "c"], "y").collect())
    assert [r.rmse for r in fo.ridge_folds(df.limit(0), ["a"], "y", k=2).collect()] == [None, None]
    assert fo.out_of_fold(df.limit(0), ["a"], "y").count() == 0
    assert fo.out_of_fold_classes(df.limit(0).withColumn("y", F.lit(1)), ["a"], "y", 2).count() == 0


def test_planted_flips_are_found_without_given_probabilities(spark):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 3, 900)
    x = rng.normal(size=(900, 2)) + np.array([[0, 0], [4, 0], [0, 4]])[label]
    flipped = rng.random(900) < 0.1
    noisy = np.where(flipped, (label + 1) % 3, label)
    df = spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, noisy))], "row_id int, a double, b double, k int")
    probs = fo.out_of_fold_classes(df, ["a", "b"], "k", 3)
    assert all(abs(r.p0 + r.p1 + r.p2 - 1) < 1e-9 for r in probs.collect())
    # the confident rule also marks rows of no confident class whose own is under average
    for flags, wrong in ((ln.found_out_of_fold(df, ["a", "b"], "k", 3), 0.06), (ln.confident_out_of_fold(df, ["a", "b"], "k", 3), 0.2)):
        found = {r.row_id for r in flags.where("is_issue").collect()}
        planted = set(np.flatnonzero(flipped).tolist())
        assert len(found & planted) > 0.9 * len(planted) and len(found - planted) < wrong * 900
    y = df.withColumn("y", F.col("a") * 3 + F.col("b") + F.when(F.col("row_id") % 100 == 7, 60).otherwise(0))
    got = {r.row_id for r in ln.residuals_out_of_fold(y, ["a", "b"], "y").where("is_issue").collect()}
    assert got == set(range(7, 900, 100))


def test_fits_by_fold_read_their_rows_once(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    from failscope.operators import models as bm
    from failscope.operators import splits as vs

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(400).selectExpr("id row_id", "cast(id % 7 as double) a", "cast(id % 7 > 2 as int) t").mapInPandas(count, "row_id bigint, a double, t int")
    fit = lambda d, g=None: Pipeline(stages=[bm.VectorAssembler(inputCols=["a"], outputCol="features"), LogisticRegression(labelCol="t", maxIter=3)]).fit(d)
    hit = (F.col("t") == F.col("prediction")).cast("double")
    for made in (lambda: vs.cross_validate(df, fit, hit, k=3), lambda: vs.nested(df, fit, [{"r": 0}], hit, outer=3, inner=2), lambda: bm.out_of_fold(df, ["a"], "t", k=2)):
        before = seen.value
        assert made().count() and seen.value - before == 400


def test_moments_of_a_null_group_and_far_values_equal_numpy(spark):
    import numpy as np
    from failscope.operators.folds import moments

    v = np.random.default_rng(0).normal(1e8, 1.0, (300, 2))
    rows = [(None if i % 3 == 2 else i % 3, *map(float, x)) for i, x in enumerate(v)]
    got = moments(spark.createDataFrame(rows, "g int, a double, b double").repartition(5), ["g"], ["a", "b"])
    assert set(got) == {(0,), (1,), (None,)}
    for k, own in (((0,), v[0::3]), ((1,), v[1::3]), ((None,), v[2::3])):
        gap = own - own.mean(axis=0)
        assert got[k].n == 100 and np.allclose(got[k].mean, own.mean(axis=0)) and np.allclose(got[k].products, gap.T @ gap, rtol=1e-6)


def test_elbow_keeps_the_features_alone(spark):
    df = spark.range(200).select((F.col("id") % 2 * 100 + F.col("id") / 100).alias("a"), F.when(F.col("id") >= 0, F.raise_error(F.lit("read"))).alias("other"))
    got = bm.elbow(df, ["a"], [2]).first()
    assert got.k == 2 and got.inertia < 200 and got.silhouette > 0.9


def test_forests_of_the_domain_classifier_read_even_parts(spark, monkeypatch):
    parts, plain = [], bm.tree
    monkeypatch.setattr(bm, "tree", lambda d, *a, **k: parts.append(d.rdd.getNumPartitions()) or plain(d, *a, **k))
    df = spark.range(600).coalesce(1).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "reference").otherwise("current").alias("cohort"), (F.col("id") % 2 * 5 + F.col("id") % 7).cast("double").alias("a"))
    got = bm.domain_classifier(df, ["a"]).first()
    assert got.level == "CRITICAL" and list(got.top_features) == ["a"] and len(parts) == 4 and min(parts) > 1

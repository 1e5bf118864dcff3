"""Local explanations by present and absent features."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from failscope.operators import attribution as xp
from failscope.operators import models as bm
from failscope.plans import registry
from failscope.sources.views import load

NAMES = ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize("kernel", ["exponential", "cosine"])
def test_two_planted_features_of_five(spark, kernel):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5)) * [1, 50, 1, 1, 1]
    y = 4 * x[:, 0] - 0.1 * x[:, 1]
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "row_id int, " + ", ".join(f"{c} double" for c in [*NAMES, "y"]))
    model = LinearRegression(labelCol="y").fit(bm.assemble(df, NAMES))
    some = df.where("row_id < 60").unionByName(df.where("row_id = 0").withColumn("row_id", F.lit(500)).withColumn("c", F.lit(None).cast("double")))
    run = lambda d: sorted(map(tuple, xp.lime_local(model, d, NAMES, F.col("prediction"), samples=500, k=2, kernel=kernel, background=200).collect()))
    got = run(some)
    assert len(got) == 120 and got == run(some.repartition(3))
    far = [i for i in range(60) if min(abs(4 * x[i, 0]), abs(0.1 * x[i, 1])) > 4]
    found = [{r[2] for r in got if r[0] == i} == {"a", "b"} for i in far]
    assert len(far) >= 3 and np.mean(found) >= 0.8, (found, far)
    assert np.mean([r[5] for r in got if r[0] in far]) > 0.3 and all(r[5] <= 1 for r in got)
    assert xp.lime_local(model, some.limit(0), NAMES, F.col("prediction")).count() == 0


def test_sums_of_samples_are_made_where_the_row_is(spark):
    df = spark.range(40).selectExpr("id row_id", "cast(id as double) a", "cast(id * id % 7 as double) b", "cast(3 * id + 2 as double) y")
    model = LinearRegression(labelCol="y").fit(bm.assemble(df, ["a", "b"]))
    some = df.unionByName(df.where("row_id = 0").selectExpr("99L row_id", "cast(null as double) a", "b", "y"))
    for made, rows in ((xp.kernel_shap(model, df, ["a", "b"], F.col("prediction")), 80), (xp.lime(model, some, ["a", "b"], F.col("prediction")), 80), (xp.lime_local(model, some, ["a", "b"], F.col("prediction"), samples=20), 80)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        sums = plan[plan.index("MapInPandas") : plan.index("UDF(")]
        assert "Exchange" not in sums, plan
        assert made.count() == rows
    got = {(r[0], r[1]): r[2] for r in xp.kernel_shap(model, df, ["a", "b"], F.col("prediction")).collect()}
    assert all(abs(got[i, "a"] - 3 * (i - 19.5)) < 1e-3 and abs(got[i, "b"]) < 1e-3 for i in range(40))


class Seen:
    """A model of two features that keeps what it scored."""

    def transform(self, d):
        self.rows = d
        v = vector_to_array("features")
        return d.withColumn("prediction", F.sin(v[0] / 300) + v[1] * v[1] / 4e6)


@pytest.fixture(scope="module")
def met(spark):
    """3,000 rows whose features tell them apart, what a model scored for them, and their explanations by 61 samples."""
    df, model = spark.range(3000).selectExpr("id row_id", "cast(id as double) a", "id + 0.5 b"), Seen()
    out = xp.lime_local(model, df, ["a", "b"], F.col("prediction"), samples=61).toPandas()
    v = vector_to_array("features")
    return model.rows.select("row_id", v[0].alias("a"), v[1].alias("b")).toPandas(), out


def test_every_row_is_a_background_row(met):
    scored, _ = met
    other = scored["a"].where(scored["a"] != scored["row_id"], scored["b"] - 0.5)
    left = scored.assign(other=other)[other != scored["row_id"]]
    assert left["other"].nunique() == 3000
    by = left.groupby("row_id")["other"].agg(["count", "nunique"])
    assert len(by) == 3000 and set(by["count"]) == {30, 31} and (by["count"] == by["nunique"]).all()
    assert np.corrcoef(left["row_id"], left["other"])[0, 1] < 0.05 and abs(left["other"].mean() - 1499.5) < 30


def test_explanation_is_the_weighted_fit_of_all_samples(met):
    scored, out = met
    s = np.std(np.arange(3000), ddof=1)
    for i in (0, 7, 1500, 2999):
        x = scored[scored["row_id"] == i][["a", "b"]].to_numpy()
        own = np.array([i, i + 0.5])
        x = x[(x != own).any(axis=1)]
        x = np.vstack([x, np.repeat(own[None], 61 - len(x), axis=0)])  # the samples that keep both
        z = np.column_stack([np.ones(61), x == own])
        y, w = np.sin(x[:, 0] / 300) + x[:, 1] ** 2 / 4e6, np.exp(-(((x - own) / s) ** 2).sum(axis=1) / (0.75**2 * 2))
        beta = np.linalg.solve(z.T @ (z * w[:, None]) + np.diag([0, 0.01, 0.01]), z.T @ (w * y))
        r2 = 1 - (w * (y - z @ beta) ** 2).sum() / (w * (y - np.average(y, weights=w)) ** 2).sum()
        got = out[out["row_id"] == i].set_index("feature")
        assert np.allclose(got.loc[["a", "b"], "value"], beta[1:], atol=2e-6) and np.allclose(got["intercept"], beta[0], atol=2e-6) and np.allclose(got["r2"], r2, atol=1e-4)


def test_one_feature_is_never_left_out(spark):
    df = spark.range(30).selectExpr("id row_id", "cast(id as double) a", "2.0D * id + 1 y")
    got = xp.lime_local(LinearRegression(labelCol="y").fit(bm.assemble(df, ["a"])), df, ["a"], F.col("prediction"), samples=20).collect()
    assert len(got) == 30 and all(r.value == 0 and abs(r.intercept - 2 * r.row_id - 1) < 1e-5 for r in got)


def test_query_takes_all_samples_and_features(spark):
    names, d = ["t", "x1", "x2"], load(spark, "/root/testdata/sf0.001", "study")
    want = xp.lime_local(bm.linear(d, names, "y"), d.select("row_id", *names), names, F.col("prediction"), samples=500, k=3)
    got = registry.queries()["xp8_lime_local"](spark, "/root/testdata/sf0.001").toPandas().sort_values(["row_id", "rank"]).reset_index(drop=True)
    want = want.toPandas().sort_values(["row_id", "rank"]).reset_index(drop=True)
    assert len(got) == 3 * d.count() and (got["row_id"] == want["row_id"]).all()
    assert np.allclose(got[["value", "intercept", "r2"]], want[["value", "intercept", "r2"]], atol=1e-4)

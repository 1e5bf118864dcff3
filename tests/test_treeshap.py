"""Shapley values of trees against all coalitions."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from failscope.operators import attribution as xp
from failscope.operators import models as bm
from failscope.operators import treeshap as ts


def table(spark, n, m, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, m)), 2)
    y = (x[:, 0] * x[:, 1] + x[:, min(2, m - 1)] > 0).astype(int)
    names = [f"f{i}" for i in range(m)]
    rows = [(i, *map(float, v), int(t), float(3 * v[0] - t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id int, " + ", ".join(f"{c} double" for c in names) + ", y int, z double"), names


@pytest.mark.parametrize("kind", ["classifier", "forest", "forest_regressor"])
def test_equals_all_coalitions(spark, kind):
    df, names = table(spark, 150, 5)
    regression = kind == "forest_regressor"
    model = bm.tree(df, names, "z" if regression else "y", kind, depth=4, trees=4)
    output = F.col("prediction") if regression else vector_to_array("probability")[1]
    some = df.where("row_id < 20")
    want = {(r.row_id, r.feature): r.value for r in xp.shapley(model, some, names, output).collect()}
    got = {(r.row_id, r.feature): r.value for r in ts.tree_shap(model, some, names).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and max(map(abs, got.values())) > 0.05


def test_thirty_features_add_up_to_the_change_of_output(spark):
    df, names = table(spark, 300, 30)
    model = bm.tree(df, names, "z", "regressor", depth=6)
    got = ts.tree_shap(model, df, names).groupBy("row_id").agg(F.sum("value").alias("s"))
    mean = df.agg(*[F.avg(c).alias(c) for c in names])
    base = model.transform(bm.assemble(mean, names)).first()["prediction"]
    both = model.transform(bm.assemble(df, names)).join(got, "row_id").select("prediction", "s").collect()
    assert len(both) == 300 and all(abs(r.prediction - base - r.s) < 1e-3 for r in both)


def test_odd_rows(spark):
    df, names = table(spark, 60, 3)
    model = bm.tree(df, names, "y", depth=3)
    odd = spark.createDataFrame([(1, None, 1.0, 1.0), (2, float("nan"), 1.0, 1.0), (3, 1.0, 1.0, 1.0)], "row_id int, f0 double, f1 double, f2 double")
    assert {r.row_id for r in ts.tree_shap(model, odd, names).collect()} == {3} and ts.tree_shap(model, odd.limit(0), names).count() == 0


def test_cells_hold_the_values_of_leaves_at_cuts_too(spark):
    df, names = table(spark, 400, 3)
    boxes = [t for t in ts.leaves(bm.tree(df, names, "y", "forest", trees=3))] + [[({}, 0.5)]]
    background = np.array([0.1, -0.2, 0.0])
    cuts = sorted({v for t in boxes for box, _ in t for ends in box.values() for v in ends if np.isfinite(v)})
    x = np.random.default_rng(0).choice([*cuts, *(np.array(cuts) + 1e-9), -9.0, 9.0, np.inf], (500, 3))
    made = [ts.cells(t, background) for t in boxes]
    assert all(isinstance(m, ts.Cells) for m in made)
    want = sum(ts.values(x, background, t) for t in boxes)
    assert np.abs(ts.tabled(x, background, made) - want).max() < 1e-12 and np.abs(want).max() > 0.01
    assert np.abs(ts.tabled(x, background, boxes) - want).max() < 1e-12  # without cells, from leaves

"""Queries over all of their input."""

import random

from failscope.operators import graphs as gr
from failscope.operators import stats as st
from failscope.plans import registry
from failscope.sources.views import load, table

SF = "/root/testdata/sf0.001"


def test_corrections_take_every_order_and_no_window_over_all(spark):
    assert load(spark, SF, "tests").count() == table(spark, SF, "orders").count()
    rng = random.Random(3)
    rows = [(i, rng.random() ** 4 if i % 3 else rng.choice([0.0, 0.001, 0.02, 1.0])) for i in range(3000)] + [(9000, None)]
    out = st.corrections(spark.createDataFrame(rows, "test_id bigint, p_value double"))
    assert "row_number" not in out._jdf.queryExecution().toString()
    got, m = {r.test_id: r for r in out.collect()}, len(rows)
    assert len(got) == m and got[9000].p_value is None and got[9000].bh == 1 and not got[9000].bh_reject
    least = 1.0
    for k, (i, p) in reversed(list(enumerate(sorted(rows[:-1], key=lambda r: (r[1], r[0])), 1))):
        least = min(least, p * m / k)
        assert abs(got[i].bh - least) < 1e-6 and got[i].bh_reject == (least <= 0.05)
        assert got[i].bonferroni_reject == (p < 0.05 / m) and abs(got[i].bonferroni - min(1, p * m)) < 1e-6


def test_relatives_of_many_pairs(spark):
    edges = spark.createDataFrame([("Z", "X"), ("Z", "Y"), ("X", "M"), ("M", "Y"), ("X", "W"), ("Y", "W"), ("A", "Z"), ("A", "Z")], "src string, dst string")
    pairs = spark.createDataFrame([("X", "Y"), ("Z", "W"), ("M", "W"), ("X", "gone")], "x string, y string")
    got = sorted((r.x, r.y, r.kind, r.node) for r in gr.relatives(edges, pairs).collect())
    want = [("X", "Y", "collider", "W"), ("X", "Y", "confounder", "A"), ("X", "Y", "confounder", "Z"), ("X", "Y", "mediator", "M")]
    want += [("Z", "W", "confounder", "A"), *[("Z", "W", "mediator", n) for n in "MXY"], *[("M", "W", "confounder", n) for n in "AXZ"], ("M", "W", "mediator", "Y")]
    assert got == sorted(want)


def test_relatives_query_is_about_the_tables(spark):
    got = registry.queries()["gr3_relatives"](spark, SF).toPandas()
    assert set(got["kind"]) == {"confounder", "collider", "mediator"} and got[["x", "y"]].drop_duplicates().shape[0] > 100
    assert got.loc[got["kind"] == "mediator", "node"].str[0].isin(["C", "S"]).all()

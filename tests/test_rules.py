"""Defined results of audit operators on nulls, absent groups and known cases; operators whose results SQL cannot give."""

import math
import os
import shutil
import subprocess
import sys
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from failscope.functions import core, dist
from failscope.operators import attribution as xp
from failscope.operators import calibration as ca
from failscope.operators import calibrators as cb
from failscope.operators import causal as cs
from failscope.operators import drift as dr
from failscope.operators import estimates as es
from failscope.operators import evaluation as ev
from failscope.operators import fairness as fa
from failscope.operators import governance as gv
from failscope.operators import graphs as gr
from failscope.operators import imputation as im
from failscope.operators import missing as md
from failscope.operators import models as bm
from failscope.operators import prep as pr
from failscope.operators import slices as sl
from failscope.operators import stats as st
from failscope.sources import files as io
from failscope.streaming import monitors as mon

NAN = float("nan")


def scored(spark, rows):
    return spark.createDataFrame(rows, "y_true int, y_prob double, grp string")


def test_null_and_nan_scores_take_no_part(spark):
    d = scored(spark, [(1, None, "a"), (0, 0.3, "a"), (None, 0.5, "a"), (1, NAN, "b"), (1, 0.9, None)])
    table = {r.threshold: r for r in ev.threshold_table(d).collect()}
    assert sorted(table) == [0.3, 0.9] and table[0.9].tp == 1 and table[0.9].fn == 0
    assert ca.errors(ca.reliability(d)).first().n == 2
    assert {r.grp for r in ev.auc(d, by=["grp"]).collect()} == {"a", None}
    counts = ev.binary_counts(d.withColumn("y_pred", F.when(~F.isnan("y_prob"), (F.col("y_prob") > 0.5).cast("int")))).first()
    assert (counts.tp, counts.fp, counts.tn, counts.fn) == (1, 0, 1, 0)


def test_drift_of_null_values_and_absent_cohorts(spark):
    rows = [("reference", "x", float(i)) for i in range(10)] + [("current", "x", float(i)) for i in range(10)] + [("current", "x", None)] * 3 + [("reference", "y", 1.0)]
    d = spark.createDataFrame(rows, "cohort string, feature string, value double")
    ks = {r.feature: r for r in dr.ks(d).collect()}
    assert ks["x"].ks == 0 and ks["x"].level == "NONE" and ks["y"].ks is None
    psi = {r.feature: r for r in dr.psi(d).collect()}
    assert abs(psi["x"].psi) < 1e-9 and psi["y"].psi is None


def test_a_null_stratum_is_no_total(spark):
    rows = [(None, 1, 1.0), (None, 0, 2.0), ("s", 1, 3.0), ("s", 0, 4.0)]
    got = cs.simpson(spark.createDataFrame(rows, "stratum string, t int, y double")).collect()
    assert sorted((r.whole, r.n) for r in got) == [(False, 2), (False, 2), (True, 4)]
    flip = [("a", 1, 9.0)] * 9 + [("a", 0, 8.0)] + [("b", 1, 2.0)] + [("b", 0, 1.0)] * 9
    rows = flip + [("c", 1, 2.0)] * 1 + [("c", 0, 1.0)] * 1
    assert not cs.simpson(spark.createDataFrame(rows, "stratum string, t int, y double")).first().paradox_by_effect
    flip = [("a", 1, 1.0)] * 9 + [("a", 0, 2.0)] + [("b", 1, 8.0)] + [("b", 0, 9.0)] * 1 + [("a", 0, 2.0)] * 0 + [("b", 1, 8.0)] * 30 + [("a", 0, 2.0)] * 30
    assert cs.simpson(spark.createDataFrame(flip, "stratum string, t int, y double")).first().paradox_by_effect


def test_filters_on_what_is_no_number(spark):
    d = spark.createDataFrame([("5",), ("x",), (None,), ("7.5",)], "a string")
    assert [r.a for r in pr.filters(d, [{"column": "a", "op": ">", "value": 6}]).collect()] == ["7.5"]


def test_quantiles_by_group(spark):
    import random

    rng = random.Random(0)
    rows = [(rng.choice(["a", "b", None]), round(rng.gauss(0, 1), 1)) for _ in range(500)]
    h = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for r in core.quantiles(h, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        x = sorted(v for g, v in rows if g == r.g)
        for q, got in zip([0.0, 0.25, 0.5, 0.9, 1.0], r.q):
            p = q * (len(x) - 1)
            want = x[int(p)] + (x[math.ceil(p)] - x[int(p)]) * (p - int(p))
            assert abs(got - want) < 1e-9


def test_tails_and_quantiles_against_tables():
    assert abs(dist.t_quantile(0.975, 10) - 2.228139) < 1e-5 and abs(dist.t_quantile(0.975, 1) - 12.7062) < 1e-3
    assert abs(dist.gamma_tail(0.5, 3.841459 / 2) - 0.05) < 1e-6 and abs(dist.gamma_tail(5, 18.307038 / 2) - 0.05) < 1e-6
    assert abs(dist.normal_tail(1.959964) - 0.025) < 1e-6 and abs(dist.t_tail(2.0, 5) - 0.0509697) < 1e-6


def test_p_values_of_results(spark):
    d = spark.createDataFrame([("a", float(i % 7)) for i in range(70)], "g string, v double")
    r = pr.one_sample(d, "v", 2.0, "g").first()
    assert 0 < r.p < 0.001 and r.low < 3.0 < r.high
    assert abs(st.one_sample_z(d, "v", 3.0, 2.0, "g").first().p - 1.0) < 1e-9
    assert st.with_p(spark.createDataFrame([(3.841459, 1)], "x double, df int"), "chi2", "x", "df").first().p == pytest.approx(0.05, abs=1e-6)


def test_calibrators_against_their_definition(spark):
    import random

    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        p = rng.random()
        q = 1 / (1 + math.exp(-2 * math.log(p / (1 - p))))  # the score is over-confident by a temperature of 2
        rows.append((int(rng.random() < p), q, "a"))
    d = scored(spark, rows + [(None, 0.5, "a"), (1, None, "a")])
    assert abs(cb.temperature(d) - 2.0) < 0.25
    fit = cb.isotonic(d)
    assert all(a[1] <= b[1] + 1e-12 and a[0] <= b[0] for a, b in zip(fit, fit[1:]))
    got = {r.method: r for r in cb.auto_calibrate(d.where("y_prob < 2"), d).collect()}
    assert len(got) == 4 and sum(r.chosen for r in got.values()) == 1 and not got["raw"].chosen and got["temperature"].ece < got["raw"].ece
    a, b = cb.platt(scored(spark, [(1, 0.9, "a"), (1, 0.8, "a")]))
    assert a == 0 and b > 0 and cb.isotonic(d.limit(0)) == []


def test_matching_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.4), rng.gauss(0, 1), round(rng.random(), 2)) for i in range(400)]
    got = es.matching(spark.createDataFrame(rows, "row_id int, t int, y double, s double"), "t", "y", "s").first()
    diffs = []
    for i, t, y, s in rows:
        _, _, _, m = min((abs(s - s2), s2, j, y2) for j, t2, y2, s2 in rows if t2 != t)
        diffs.append((y - m if t else m - y, t))
    assert got.n == 400 and got.ate == pytest.approx(sum(d for d, _ in diffs) / 400, abs=1e-6)
    assert got.att == pytest.approx(sum(d for d, t in diffs if t) / sum(t for _, t in diffs), abs=1e-6)


def test_shapley_of_a_linear_model_has_a_closed_form(spark):
    d = spark.createDataFrame([(i, float(i % 5), float(i * i % 7), 2.0 * (i % 5) - 3.0 * (i * i % 7)) for i in range(40)], "row_id int, a double, b double, y double")
    m = bm.linear(d, ["a", "b"], "y")
    means = d.agg(F.avg("a"), F.avg("b")).first()
    rows = {r.row_id: r for r in d.collect()}
    exact = xp.shapley(m, d, ["a", "b"], F.col("prediction"))
    for r in exact.collect():
        want = 2.0 * (rows[r.row_id].a - means[0]) if r.feature == "a" else -3.0 * (rows[r.row_id].b - means[1])
        assert r.value == pytest.approx(want, abs=1e-4)
    near = {(r.row_id, r.feature): r.value for r in xp.kernel_shap(m, d, ["a", "b"], F.col("prediction"), samples=20).collect()}
    assert all(abs(near[r.row_id, r.feature] - r.value) < 0.05 for r in exact.collect())
    local = xp.lime(m, d, ["a", "b"], F.col("prediction"), samples=60).groupBy("feature").agg(F.avg("value").alias("v")).collect()
    assert {r.feature: r.v > 0 for r in local} == {"a": True, "b": False}


def test_lattice_search_finds_a_planted_slice(spark):
    import random

    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        a, b, c = rng.choice("xyz"), rng.choice("pqr"), rng.choice("uv")
        rows.append((a, b, c, float(rng.random() < (0.9 if (a, b) == ("x", "p") else 0.1))))
    got = sl.search(spark.createDataFrame(rows, "a string, b string, c string, loss double"), ["a", "b", "c"], "loss", effect=0.9).collect()
    assert [r.slice for r in got] == ["a=x & b=p"] and got[0].n == sum((r[0], r[1]) == ("x", "p") for r in rows)


def test_imputation_fills_and_keeps(spark):
    rows = [(i, float(i), 2.0 * i + 1 if i % 4 else None) for i in range(200)]
    d = spark.createDataFrame(rows, "row_id int, a double, b double")
    got = {r.row_id: r for r in im.impute(d, ["a", "b"], cycles=2).collect()}
    assert all(got[i].b == b for i, _, b in rows if b is not None)
    assert max(abs(got[i].b - (2.0 * i + 1)) for i, _, b in rows if b is None) < 1.0
    assert md.little_test(d, ["a", "b"]).first().df == 1


def test_tails_of_arrays_equal_those_of_numbers(spark):
    rng = np.random.default_rng(1)
    t, df = rng.normal(scale=4, size=400), rng.choice([0.7, 1, 2, 5.5, 30, 1e4, 1e6], 400)
    t[:3] = 0.0, 1e9, -1e9
    assert np.allclose(dist.t_tail_all(t, df), [dist.t_tail(a, b) for a, b in zip(t, df)], rtol=1e-8, atol=1e-300)
    a, b, x = rng.uniform(0.2, 50, 300), rng.uniform(0.2, 50, 300), rng.uniform(-0.1, 1.1, 300)
    assert np.allclose(dist.beta_inc_all(a, b, x), [dist.beta_inc(*v) for v in zip(a, b, x)], rtol=1e-8, atol=1e-300)
    rows = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (2.0, None)], "t double, df double")
    got = [r.p for r in rows.select(dist.t_p_greater(F.col("t"), F.col("df")).alias("p")).collect()]
    assert abs(got[0] - dist.t_tail(1.0, 5.0)) < 1e-12 and got[1:] == [None, None]


def test_gates_and_failing_modules(spark):
    found = spark.createDataFrame([("m", "f", "x", 1.0, "HIGH"), ("m", "g", "x", 1.0, "LOW")], gv.FINDING)
    gv.gate(found, "HIGH")
    with pytest.raises(gv.GateError):
        gv.gate(found, "MEDIUM")
    with pytest.raises(gv.GateError):
        gv.gate_value(found, "value", most=0.05)
    out = gv.run_all(spark, {"good": lambda: found, "bad": lambda: found.select("absent")}).collect()
    assert len(out) == 3 and [r.metric for r in out if r.module == "bad"] == ["error: AnalysisException"]
    assert gv.risk(found.limit(0)).first().risk == "LOW"


def test_a_module_that_fails_while_it_runs_loses_its_own_findings_alone(spark, tmp_path):
    rows = spark.createDataFrame([("m", "f", "x", "a", "HIGH")], "module string, feature string, metric string, value string, severity string")
    bad = rows.withColumn("value", F.raise_error(F.lit("broken")).cast("double"))  # a fine plan that fails at work
    good = spark.createDataFrame([("m", "f", "x", 1.0, "LOW"), ("m", "g", "x", 2.0, "CRITICAL")], gv.FINDING)
    runs, folder = [], f"file://{tmp_path}"
    def module(name, result):
        return lambda: (runs.append(name), result)[1]
    out = gv.run_all(spark, {"good": module("good", good), "bad/one": module("bad/one", bad)}, folder).collect()
    assert [(r.module, r.severity) for r in out] == [("m", "CRITICAL"), ("bad/one", "HIGH"), ("m", "LOW")] and sorted(runs) == ["bad/one", "good"]
    assert {(r.module, r.status) for r in gv.manifest(spark, folder, ["good", "bad/one", "new"]).collect()} == {("good", "done"), ("bad/one", "failed")}
    out = gv.run_all(spark, {"good": module("good", good), "bad/one": module("bad/one", good), "new": module("new", good)}, folder).collect()
    assert len(out) == 6 and sorted(runs) == ["bad/one", "bad/one", "good", "new"]  # what is done is read, not run
    shutil.rmtree(tmp_path / "manifest" / "good")  # broken off before its row
    gv.run_all(spark, {"good": module("good", good)}, folder)
    assert runs.count("good") == 2


def test_a_repeated_batch_leaves_its_rows_once(spark, tmp_path):
    day = lambda d, n, acc: (f"2024-01-{d:02d}", n, acc)
    t = spark.createDataFrame([day(1, 10, 0.9), day(8, 30, 0.92), day(15, 10, 0.7), day(22, 10, 0.85)], "start string, n int, accuracy double")
    for _ in range(3):
        mon.put_batch(t, 4, str(tmp_path))
    mon.put_batch(t, 5, str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).groupBy("batch").count().orderBy("batch").collect() == [(4, 4), (5, 4)]
    got = mon.against_earlier(t, 2).orderBy("start").collect()
    assert [(r.baseline, r.status) for r in got] == [(None, "OK"), (0.9, "OK"), (0.915, "REGRESSION"), (0.865, "WARNING")]


def test_a_planted_regression_is_flagged_against_the_trailing_baseline(spark, tmp_path):
    rows = [(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d} 0{h}:00:00", h % 2, 0.9 if (h % 2) == (d < 84 or h > 5) else 0.1) for d in range(112) for h in range(9)]
    d = spark.createDataFrame([*rows, ("2024-09-01 00:00:00", 1, 0.9)], "ts string, y_true int, y_prob double").withColumn("ts", F.col("ts").cast("timestamp"))
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    job = mon.watch_performance(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", "28 days", "28 days").trigger(availableNow=True).start()
    job.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("start").collect()
    assert len(got) >= 4 and got[0].status == "OK" and "REGRESSION" in [r.status for r in got]
    assert len({r.start for r in got}) == len(got)


def test_individual_fairness_and_thresholds(spark):
    rows = [(i, float(i % 50), float(i % 2)) for i in range(400)]
    d = spark.createDataFrame(rows, "k int, x double, p double")
    assert fa.individual(d.withColumn("p", F.lit(1.0)), ["x"], "p", "k").first().consistency == 1.0
    s = scored(spark, [(i % 2, (i % 2) * 0.5 + 0.2 + 0.01 * (i % 3), "ab"[i % 4 // 2]) for i in range(200)])
    assert 0.22 < fa.fair_threshold(s).first().threshold <= 0.71


def test_streams_give_what_tables_give(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [(f"2024-01-{d:02d} {h:02d}:00:00", u, float(d % 5)) for d in range(1, 20) for h in (1, 2, 13) for u in (1, 2)]
    rows.append(("2024-03-01 00:00:00", 9, 1.0))  # closes what stands before it
    d = spark.createDataFrame(rows, "ts string, user_id int, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    d.coalesce(1).write.parquet(f"{folder}/in")
    bounds = spark.createDataFrame([("value", [1.0, 3.0])], "feature string, bounds array<double>")
    make = lambda t: {"drift": mon.drift_counts(t.withColumn("feature", F.lit("value")), bounds), "sessions": mon.sessions(t, gap="2 hours"),
                      "performance": mon.performance(t.withColumn("y_true", (F.col("value") > 2).cast("int")).withColumn("y_prob", F.col("value") / 5), baseline=0.5)}
    want = make(d)
    for name, frame in make(spark.readStream.schema(d.schema).parquet(f"{folder}/in")).items():
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        got, whole = {str(r) for r in spark.table(name).collect()}, {str(r) for r in want[name].collect()}
        assert got and got <= whole and len(whole) - len(got) <= 2  # the last window is still open
    ref = spark.createDataFrame([("value", 0, 10), ("value", 1, 10), ("value", 2, 10)], "feature string, bin int, ref bigint")
    q = mon.watch_drift(spark.readStream.schema(d.schema).parquet(f"{folder}/in").withColumn("feature", F.lit("value")), bounds, ref, f"{folder}/out", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{folder}/out").where("psi is not null").count() >= 2


def test_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    found = spark.createDataFrame([("m", "all", "auc", 0.5, "HIGH")], gv.FINDING)
    io.write_findings(found, f"{folder}/f")
    assert spark.read.json(f"{folder}/f").first().metric == "auc" and io.export_summary(found).first().Metric == "m auc"
    Path(f"{folder}/log").write_text("2024 - info - Hello\nplain line\n2025 - ERROR - hello - again\n")
    got = [(r.level, r.message) for r in io.read_log(spark, f"{folder}/log", text="HELLO").collect()]
    assert got == [("ERROR", "hello - again"), ("INFO", "Hello")]


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "d"), ("d", None)], "src string, dst string")
    assert sorted(r.node for r in gr.cycles(e).collect()) == ["a", "b", "c"]
    pairs = spark.createDataFrame([("b", "d")], "x string, y string")
    assert [(r.node, r.role) for r in cs.roles(e, pairs).collect()] in ([("c", "mediator"), ("a", "parent")], [("a", "parent"), ("c", "mediator")])


def test_the_rest_works_without_the_training_data_part():
    root, copy = Path(__file__).resolve().parents[1], tempfile.mkdtemp(prefix="spark-")
    shutil.copytree(root, f"{copy}/r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 150 and 'pipeline' not in q and set(s) <= set(q)"
    for _ in range(2):  # with the pipeline's file and without it
        subprocess.run([sys.executable, "-c", code], cwd=f"{copy}/r", check=True, timeout=120, env=os.environ | {"PYTHONPATH": f"{copy}/r"})
        Path(f"{copy}/r/corpus_pipeline.py").unlink(missing_ok=True)


def test_calibrators_count_scores_once(spark, monkeypatch):
    from failscope.operators import calibrators as cb

    df = spark.createDataFrame([(i % 3 == 0, (i % 10) / 10 + 0.01) for i in range(300)], "b boolean, y_prob double").selectExpr("cast(b as int) y_true", "y_prob")
    seen = []
    monkeypatch.setattr(cb, "written", lambda d, own=cb.written: seen.append(own(d)) or seen[-1])
    cb.auto_calibrate(df, df).collect()
    assert [d.count() for d in seen] == [20]


def test_a_draw_is_one_digest_of_the_same_value(spark):
    from failscope.sources import views

    mine = views._DRAW.sub(views._one_digest, views.draw("id", "a"))
    assert mine.count("md5(") == 1
    both = spark.range(-50, 500).selectExpr("id").unionByName(spark.sql("select cast(null as bigint) id")).selectExpr(f"{views.draw('id', 'a')} a", f"{mine} b")
    assert both.where("not (a <=> b)").count() == 0 and dict(both.dtypes) == {"a": "double", "b": "double"}
    assert all(views._DRAW.sub(views._one_digest, t).count("md5(") * 4 == t.count("md5(") for t in views.VIEWS.values())

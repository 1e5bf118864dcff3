"""Governance over findings: rules over small results, gates, risk, and a report that survives a failing part."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import shared_dir

#: Columns of a finding, and of the manifest of a run.
FINDING = "module string, feature string, metric string, value double, severity string"
MANIFEST = "module string, status string, error string"
# The levels of severity in order.
LEVELS = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")


class GateError(ValueError):
    """A gate that did not hold; the message names what failed."""


def level(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), severity) - 1, F.lit(0)).cast("int")


def findings(df: DataFrame, module: str, metric: str, value: str, severity: Column, feature: Column | None = None) -> DataFrame:
    """A result as findings."""
    return df.select(F.lit(module).alias("module"), (feature if feature is not None else F.lit("all")).cast("string").alias("feature"), F.lit(metric).alias("metric"), F.col(value).cast("double").alias("value"), severity.alias("severity"))


def risk(found: DataFrame) -> DataFrame:
    """GV1: the worst severity, findings of each level from MEDIUM on, and the risk: HIGH with any CRITICAL or HIGH, MEDIUM
    with any MEDIUM, else LOW (so for no findings)."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    g = found.agg(F.coalesce(F.max(level(F.col("severity"))), F.lit(0)).alias("_l"), n("CRITICAL"), n("HIGH"), n("MEDIUM"))
    return g.select(F.element_at(F.array(*map(F.lit, LEVELS)), F.col("_l") + 1).alias("worst"), "critical", "high", "medium", F.when(F.col("_l") >= 3, "HIGH").when(F.col("_l") == 2, "MEDIUM").otherwise("LOW").alias("risk"))


def gate(found: DataFrame, most: str = "MEDIUM") -> None:
    """GV2: raises where a finding is over a level."""
    bad = found.where(level(F.col("severity")) > LEVELS.index(most)).orderBy(F.desc(level(F.col("severity"))), "module", "feature", "metric").limit(5).collect()
    if bad:
        raise GateError("; ".join(f"{r['module']} {r['feature']} {r['metric']} = {r['value']}: {r['severity']}" for r in bad))


def gate_value(df: DataFrame, column: str, least: float | None = None, most: float | None = None) -> None:
    """GV2 on a metric: raises where a row's value is under ``least`` or over ``most`` (0.05 for ECE, 0.6 for agreement)."""
    c = F.col(column)
    bad = df.where((c < least if least is not None else F.lit(False)) | (c > most if most is not None else F.lit(False))).select(column).limit(1).collect()
    if bad:
        raise GateError(f"{column} = {bad[0][0]}, allowed {least} to {most}")


# Rules on metrics (metric, comparison, bound, severity), the most severe first.
RULES = (
    ("auc", "<", 0.6, "CRITICAL"), ("auc", "<", 0.7, "HIGH"), ("auc", "<", 0.8, "MEDIUM"),
    ("accuracy", "<", 0.6, "CRITICAL"), ("accuracy", "<", 0.7, "HIGH"), ("recall", "<", 0.5, "HIGH"), ("recall", "<", 0.7, "MEDIUM"), ("precision", "<", 0.5, "HIGH"), ("precision", "<", 0.7, "MEDIUM"),
    ("dp_gap", ">", 0.2, "CRITICAL"), ("dp_gap", ">", 0.1, "HIGH"), ("dp_gap", ">", 0.05, "MEDIUM"), ("eo_gap", ">", 0.2, "CRITICAL"), ("eo_gap", ">", 0.1, "HIGH"), ("eo_gap", ">", 0.05, "MEDIUM"),
    ("ece", ">", 0.1, "HIGH"), ("ece", ">", 0.05, "MEDIUM"), ("psi", ">", 0.25, "HIGH"), ("psi", ">", 0.1, "MEDIUM"),
)


def apply_rules(metrics: DataFrame, rules=RULES) -> DataFrame:
    """GV4: metrics (module, feature, metric, value) with the severity of the first rule that they meet, else NONE: a join
    with the broadcast table of rules."""
    t = metrics.sparkSession.createDataFrame([(i, m, op, float(b), s) for i, (m, op, b, s) in enumerate(rules)], "_i int, metric string, op string, bound double, _s string")
    hit = F.when(F.col("op") == "<", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    j = metrics.withColumn("_id", F.struct(*metrics.columns)).join(F.broadcast(t), "metric", "left")
    g = j.groupBy("_id").agg(F.min(F.when(hit, F.struct("_i", "_s"))).alias("m"))
    return g.select("_id.*", F.coalesce("m._s", F.lit("NONE")).alias("severity"))


def notes(summary: DataFrame) -> DataFrame:
    """GV5: notes on a one-row summary: the accuracy paradox (accuracy of at least 0.8 with a recall under 0.5), the
    direction of errors, a chance-like model, bad calibration; with advice, the worst first."""
    fp, fn = F.col("fp"), F.col("fn")
    rules = [("accuracy paradox", "HIGH", (F.col("accuracy") >= 0.8) & (F.col("recall") < 0.5), "report recall and precision, reweigh classes"),
             ("misses more than false alarms", "MEDIUM", fn > 2 * fp, "lower the threshold"), ("false alarms more than misses", "MEDIUM", fp > 2 * fn, "raise the threshold"),
             ("near chance", "CRITICAL", F.col("auc") < 0.6, "find better features"), ("calibration", "MEDIUM", F.col("ece") > 0.05, "calibrate the score")]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("note"), F.lit(s).alias("severity"), F.coalesce(on, F.lit(False)).alias("on"), F.lit(a).alias("advice")) for n, s, on, a in rules]))
    t = summary.select(rows.alias("x")).select("x.*").where("on").drop("on")
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(level(F.col("severity"))), "note")  # five rows at most
    return t.withColumn("rank", F.row_number().over(order))


def run_all(spark: SparkSession, modules: dict[str, Callable[[], DataFrame]], folder: str | None = None, at_once: int = 4) -> DataFrame:
    """GV6: findings of every module, the worst first; a module that fails is one HIGH finding that names its error.

    Each module runs and is written in a job of its own, ``at_once`` side by side, so what fails while it runs loses only its
    own findings. Beside them a row of the manifest (:func:`manifest`) is written, after the findings. With a ``folder`` that
    an earlier run has left, modules that the manifest calls done are read and not run again; failed and missing ones are.
    Without one each call has a new folder among those that executors share.
    """
    folder = folder or f"{shared_dir(spark)}/findings-{uuid.uuid4().hex}"
    done = {r["module"] for r in manifest(spark, folder, list(modules)).where("status = 'done'").collect()}

    def one(name: str) -> None:
        path, error = _module_path(folder, name), None
        try:
            modules[name]().select("module", "feature", "metric", "value", "severity").write.mode("overwrite").parquet(path)
        except Exception as e:  # a failing part must not take the report with it
            error = f"error: {type(e).__name__}"
            spark.createDataFrame([(name, "all", error, None, "HIGH")], FINDING).coalesce(1).write.mode("overwrite").parquet(path)
        row = (name, "failed" if error else "done", error)
        spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(_module_path(folder, name, "manifest"))

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(one, [m for m in modules if m not in done]))
    out = spark.createDataFrame([], FINDING)
    for name in modules:
        out = out.unionByName(spark.read.schema(FINDING).parquet(_module_path(folder, name)))
    return out.orderBy(F.desc(level(F.col("severity"))), "module", "feature", "metric")


def _module_path(folder: str, name: str, part: str = "findings") -> str:
    return f"{folder.rstrip('/')}/{part}/{quote(name, safe='')}"


def manifest(spark: SparkSession, folder: str, modules: list[str]) -> DataFrame:
    """(module, status, error) of the modules that a run in this folder has ended, well (done) or not (failed)."""
    out = spark.createDataFrame([], MANIFEST)
    for name in modules:
        try:
            out = out.unionByName(spark.createDataFrame(spark.read.parquet(_module_path(folder, name, "manifest")).select("module", "status", "error").collect(), MANIFEST))  # a row
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # not there, or broken off before its row
                raise
    return out


def top_actions(found: DataFrame, n: int = 10) -> DataFrame:
    """GV6: the ``n`` worst findings from MEDIUM on, as ranked actions."""
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(level(F.col("severity"))), F.desc("value"), "module", "feature", "metric"))
    return found.where(level(F.col("severity")) >= 2).withColumn("rank", rank).where(F.col("rank") <= n).select("rank", "module", "feature", "metric", "severity")

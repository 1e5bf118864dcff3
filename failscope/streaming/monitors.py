"""Structured Streaming monitors of drift, performance and activity. Each works on a stream and, for checks, on a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import r6, valid
from ..operators.evaluation import rates


def drift_counts(rows: DataFrame, bounds: DataFrame, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """ST1, first half: rows of each tumbling event-time window at each bin of the reference's boundaries (feature, bounds),
    from (ts, feature, value). Rows later than the watermark are dropped. bounds is a row a feature and static."""
    d = valid(rows, "value", "feature", "ts")
    d = d.withWatermark("ts", late) if d.isStreaming else d
    d = d.join(F.broadcast(bounds), "feature").withColumn("bin", F.size(F.filter("bounds", lambda x: x <= F.col("value"))))
    return d.groupBy(F.window("ts", window).alias("w"), "feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def drift_status(counts: DataFrame, reference: DataFrame, eps: float = 1e-6) -> DataFrame:
    """ST1, second half, on closed windows (a batch or foreachBatch): PSI of each window and feature against the reference's
    bin counts (feature, bin, ref), with its status."""
    total = Window.partitionBy("feature")
    ref = reference.select("feature", "bin", (F.col("ref") / F.sum("ref").over(total) + eps).alias("p"))
    seen = counts.select("w", "feature").distinct()
    whole = Window.partitionBy("w", "feature")
    c = seen.join(ref, "feature").join(counts, ["w", "feature", "bin"], "left").na.fill(0, ["n"])
    c = c.withColumn("q", F.col("n") / F.sum("n").over(whole) + eps)
    g = c.groupBy("w", "feature").agg(F.sum("n").alias("n"), F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
    return g.select(F.col("w.start").alias("start"), "feature", "n", r6("psi").alias("psi"), F.when(F.col("psi") >= 0.25, "DRIFT").when(F.col("psi") >= 0.10, "WARN").otherwise("STABLE").alias("status"))


def put_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Rows of a micro-batch at ``path`` under a partition of its own, which a repeated batch overwrites: every row is there
    once, however often a batch is tried."""
    batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def watch_drift(rows: DataFrame, bounds: DataFrame, reference: DataFrame, path: str, checkpoint: str, window: str = "7 days", late: str = "1 day"):
    """ST1 as a job: closed windows are judged in foreachBatch and put to ``path`` as Parquet, once each."""
    def judge(batch: DataFrame, batch_id: int) -> None:
        put_batch(drift_status(batch, reference), batch_id, path)

    return drift_counts(rows, bounds, window, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(judge)


def performance(rows: DataFrame, window: str = "14 days", slide: str = "7 days", late: str = "1 day", bins: int = 10, baseline: float | None = None, tol: float = 0.01) -> DataFrame:
    """ST2: rates, ECE and its numerator (gap) of each sliding window, from (ts, y_true, y_prob), with EV22's status of the accuracy against a
    baseline. All sums of a window are in one aggregate, so it runs in append mode."""
    d = valid(rows, "y_true", "y_prob", "ts")
    d = d.withWatermark("ts", late) if d.isStreaming else d
    p, y = F.least(F.greatest(F.col("y_prob"), F.lit(0.0)), F.lit(1.0)), F.col("y_true") == 1
    hat, b = F.col("y_prob") >= 0.5, F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    per_bin = [F.abs(F.sum(F.when(b == i, y.cast("double") - p).otherwise(0.0))).alias(f"_g{i}") for i in range(bins)]
    g = d.groupBy(F.window("ts", window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(on).alias(c) for c, on in (("tp", y & hat), ("fp", ~y & hat), ("tn", ~y & ~hat), ("fn", y & ~hat))], *per_bin)
    t = rates(g).withColumn("ece", r6(sum(F.col(f"_g{i}") for i in range(bins)) / F.col("n")))
    change = F.col("accuracy") - F.lit(baseline).cast("double")
    status = F.when(change < -2 * tol, "REGRESSION").when(change < -tol, "WARNING").otherwise("OK")
    return t.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "accuracy", "precision", "recall", "f1", "mcc", "kappa", "ece", F.round(sum(F.col(f"_g{i}") for i in range(bins)), 4).alias("gap"), status.alias("status"))


def against_earlier(windows: DataFrame, before: int = 3, metric: str = "accuracy", tol: float = 0.01) -> DataFrame:
    """ST2's closed windows with ``baseline``, the mean of the metric over up to ``before`` earlier windows weighted by their
    rows, and EV22's status of the change; the first window has no baseline and is OK. A row a window."""
    order = Window.orderBy("start").rowsBetween(-before, -1)
    base = F.try_divide(F.sum(F.col(metric) * F.col("n")).over(order), F.sum("n").over(order))
    change = F.col(metric) - F.col("baseline")
    status = F.when(change < -2 * tol, "REGRESSION").when(change < -tol, "WARNING").otherwise("OK")
    return windows.drop("status").withColumn("baseline", r6(base)).withColumn("status", status)


def watch_performance(rows: DataFrame, path: str, checkpoint: str, window: str = "14 days", slide: str = "14 days", late: str = "1 day", before: int = 3, tol: float = 0.01):
    """ST2 as a job: closed windows are put to ``path`` once each, with the baseline of the windows that earlier batches have
    put there and those of the batch before them."""
    def judge(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, [c for c in batch.columns if c != "status"]
        known = batch.select(*columns, F.lit(True).alias("_new"))
        try:
            earlier = spark.read.parquet(path).where(F.col("batch") < batch_id)
            last = earlier.orderBy(F.desc("start")).limit(before)  # a few windows
            known = known.unionByName(last.select(*columns, F.lit(False).alias("_new")))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing is there yet
                raise
        put_batch(against_earlier(known, before, tol=tol).where("_new").drop("_new"), batch_id, path)

    return performance(rows, window, slide, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(judge)


def sessions(events: DataFrame, user: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """ST3: each user's sessions (events closer than ``gap``) with their number of events, from (ts, user)."""
    d = events.where(F.col(user).isNotNull() & F.col("ts").isNotNull())
    d = d.withWatermark("ts", late) if d.isStreaming else d
    g = d.groupBy(F.session_window("ts", gap).alias("w"), F.col(user).alias("user")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

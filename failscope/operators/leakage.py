"""Leakage of the target or of the future into features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import corr, r6, valid, written
from .drift import bounds_of
from .prep import first_codes
from .splits import ordered_split, temporal_order


def coded(df: DataFrame, features: list[str], order: str, key: str = "row_id") -> DataFrame:
    """df with each text feature as its dense code by first appearance (PR6)."""
    kinds = dict(df.dtypes)
    for f in [f for f in features if kinds[f] == "string"]:
        df = df.drop(f).join(first_codes(df, f, order, key).withColumnRenamed("code", f), key)
    return df


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10, classes: int = 20) -> DataFrame:
    """LK1: mutual information (natural log) of each feature's quantile bin with the target's class, or its bin where it has
    more than ``classes`` values. One pass counts (feature, bin, class); the marginals are sums over that small table."""
    return _information(_long(df, features, target), bins, classes).select("feature", r6("mi").alias("mi"))


def _long(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, value, y, n), written once: how often each value of a feature and of the target come together, and the
    target itself as the feature null. Rows without a target are left out, and values that are null or NaN."""
    y = F.col(target).cast("double")
    both = [F.struct(F.lit(None).cast("string").alias("feature"), y.alias("value"))] + [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    long = valid(df, target).select(y.alias("y"), F.explode(F.array(*both)).alias("x")).select("x.feature", "x.value", "y").where("value is not null and not isnan(value)")
    return written(long.groupBy("feature", "value", "y").agg(F.count(F.lit(1)).alias("n")))


def _information(long: DataFrame, bins: int, classes: int) -> DataFrame:
    """(feature, mi) from the counts of _long: bounds of all features and of the target come from one prefix scan."""
    is_y = F.col("feature").isNull()
    named = long.withColumn("feature", F.coalesce(F.concat(F.lit("x"), "feature"), F.lit("y")))  # no name is like the target's
    bounds = written(bounds_of(named.groupBy("feature", "value").agg(F.sum("n").alias("n")), bins))
    many = long.where(is_y).agg((F.count(F.lit(1)) > classes).alias("_many"))
    cuts = bounds.where("feature = 'y'").select(F.col("bounds").alias("_cuts"))
    below = lambda cuts_, v: F.size(F.filter(cuts_, lambda x: x <= F.col(v)))
    rows = long.where(~is_y).join(F.broadcast(bounds.select(F.expr("substr(feature, 2)").alias("feature"), "bounds").where("feature <> ''")), "feature")  # a row a feature
    rows = rows.crossJoin(F.broadcast(many)).crossJoin(F.broadcast(cuts))
    cls = F.when(F.col("_many"), below("_cuts", "y").cast("double")).otherwise(F.col("y"))
    b = rows.groupBy("feature", below("bounds", "value").alias("bin"), cls.alias("_c")).agg(F.sum("n").cast("double").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy("feature", *c))
    part = F.col("n") / over() * F.ln(F.col("n") * over() / (over("bin") * over("_c")))
    return b.select("feature", part.alias("p")).groupBy("feature").agg(F.sum("p").alias("mi"))


def _correlation(long: DataFrame) -> DataFrame:
    """(feature, r): absolute correlation with the target from the same counts, about the means; null for a constant."""
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"_m{c}")
    rows = long.where("feature is not null")
    rows = rows.join(F.broadcast(rows.groupBy("feature").agg(mean("value"), mean("y"))), "feature")  # a row a feature
    dx, dy = F.col("value") - F.col("_mvalue"), F.col("y") - F.col("_my")
    of = lambda a, b: F.sum(a * b * F.col("n"))
    return rows.groupBy("feature").agg(F.abs(F.try_divide(of(dx, dy), F.sqrt(of(dx, dx)) * F.sqrt(of(dy, dy)))).alias("r"))


def scores(df: DataFrame, features: list[str], target: str, bins: int = 10, classes: int = 20) -> DataFrame:
    """LK3, LK4: |r|, mutual information, score 0.7 |r| + 0.3 min(1, MI), and the suspects: MI over 0.95 of the largest or
    |r| over 0.9; CRITICAL where both, HIGH where one. The rows are read once."""
    long = _long(df, features, target)
    every = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    t = every.join(_information(long, bins, classes), "feature", "left").join(_correlation(long), "feature", "left")
    t = written(t.select("feature", r6(F.coalesce("r", F.lit(0.0))).alias("r"), r6(F.coalesce("mi", F.lit(0.0))).alias("mi")))
    top = t.agg(F.max("mi").alias("_top"))
    by_mi, by_r = (F.col("mi") > 0.95 * F.col("_top")) & (F.col("_top") > 0), F.col("r") > 0.9
    risk = F.when(by_mi & by_r, "CRITICAL").when(by_mi | by_r, "HIGH").otherwise("LOW")
    return t.crossJoin(F.broadcast(top)).select("feature", "r", "mi", F.round(0.7 * F.col("r") + 0.3 * F.least(F.lit(1.0), F.col("mi")), 5).alias("score"), (by_mi | by_r).alias("suspect"), risk.alias("risk"))


def over_time(df: DataFrame, features: list[str], target: str, ts: str, least: int = 10) -> DataFrame:
    """LK5: features whose |r| with the target over the second half of time is over 0.7 and over twice that of the first, in
    halves of at least ``least`` rows."""
    halves = ordered_split(df, ts, 0.5)
    early, late = F.col("part") == "reference", F.col("part") == "current"
    n = [F.count_if(early).alias("_n1"), F.count_if(late).alias("_n2")]
    g = halves.agg(*n, *[F.abs(corr(F.when(side, F.col(f)), target)).alias(f"{s}_{f}") for f in features for s, side in (("a", early), ("b", late))])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in features]))
    g = g.select("_n1", "_n2", rows.alias("x")).select("_n1", "_n2", "x.*")
    leak = (F.col("b") > 2 * F.col("a")) & (F.col("b") > 0.7) & (F.least("_n1", "_n2") >= least)
    return g.select("feature", r6("a").alias("first_half"), r6("b").alias("second_half"), F.coalesce(leak, F.lit(False)).alias("leaks"))


def future_features(df: DataFrame, columns: list[str], event: str) -> DataFrame:
    """LK7: rows whose feature time is after the event's, by column; what is no time counts as none."""
    at = F.col(event)
    late = [F.count_if(F.coalesce(F.try_to_timestamp(F.col(c).cast("string")) > at, F.lit(False))).alias(c) for c in columns]
    return df.agg(F.count(F.lit(1)).alias("_n"), *late).unpivot(["_n"], columns, "feature", "late").select("feature", "late", r6(F.try_divide(F.col("late").cast("double"), F.col("_n").cast("double"))).alias("share"))


def temporal_report(df: DataFrame, columns: list[str], ts: str, role: str = "role") -> DataFrame:
    """LK8: VS10 and LK7 as findings (check, count, leaks)."""
    order = temporal_order(df, ts, role).select(F.lit("split order").alias("check"), F.col("overlap").alias("count"))
    rows = order.unionByName(future_features(df, columns, ts).select(F.concat(F.lit("future "), F.col("feature")).alias("check"), F.col("late").alias("count")))
    return rows.withColumn("leaks", F.col("count") > 0)


def window_audit(df: DataFrame, value: str, given: str, by: str, ts: str, days: int = 3) -> DataFrame:
    """LK9: rows whose given rolling mean equals the past-only mean of the days before, or the look-ahead mean of the days
    around instead (both: past). The window is by ``by``, over seconds."""
    seconds = F.col(ts).cast("timestamp").cast("long")
    w = Window.partitionBy(by).orderBy(seconds)
    past, around = F.avg(value).over(w.rangeBetween(-days * 86400, -1)), F.avg(value).over(w.rangeBetween(-days * 86400, days * 86400))
    near = lambda a: F.coalesce(F.abs(F.col(given) - a) < 1e-9, F.lit(False))
    d = df.select(near(past).alias("p"), near(around).alias("a"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if("p").alias("past_only"), F.count_if(F.col("a") & ~F.col("p")).alias("look_ahead"))


def encoding_audit(df: DataFrame, category: str, given: str, target: str, role: str = "role") -> DataFrame:
    """LK9: rows whose given target encoding equals their category's mean over training rows, or that over all rows instead."""
    df = df.select(category, given, target, role)
    g = df.groupBy(category).agg(F.avg(F.when(F.col(role) == "train", F.col(target).cast("double"))).alias("_t"), F.avg(F.col(target).cast("double")).alias("_a"))
    near = lambda a: F.coalesce(F.abs(F.col(given) - F.col(a)) < 1e-9, F.lit(False))
    d = df.join(g, category, "left")
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(near("_t")).alias("train_only"), F.count_if(near("_a") & ~near("_t")).alias("all_rows"))


def scan(df: DataFrame, features: list[str], target: str, times: list[str], ts: str, role: str = "role", spikes: DataFrame | None = None) -> DataFrame:
    """LK10: findings of LK3 (score over 0.8 HIGH, over 0.5 MEDIUM), of LK8 (CRITICAL) and, where given, of an importance
    spike (LK6, HIGH), with the worst of all."""
    rank = lambda c: F.when(c == "CRITICAL", 3).when(c == "HIGH", 2).when(c == "MEDIUM", 1).otherwise(0)
    s = scores(df, features, target)
    f = s.where(F.col("score") > 0.5).select(F.col("feature").alias("what"), F.lit("target leakage").alias("kind"), F.when(F.col("score") > 0.8, "HIGH").otherwise("MEDIUM").alias("severity"))
    f = f.unionByName(temporal_report(df, times, ts, role).where("leaks").select(F.col("check").alias("what"), F.lit("temporal leakage").alias("kind"), F.lit("CRITICAL").alias("severity")))
    if spikes is not None:
        f = f.unionByName(spikes.where("spike").select(F.col("feature").alias("what"), F.lit("importance spike").alias("kind"), F.lit("HIGH").alias("severity")))
    return f.withColumn("worst", F.max_by("severity", rank(F.col("severity"))).over(Window.partitionBy(F.lit(1))))


def importance_spikes(importance: DataFrame, by: str = "importance") -> DataFrame:
    """LK6: features whose permutation importance is over three times the median, or the top one where it is over ten times
    the mean of the others. A row a feature."""
    g = importance.agg(F.median(by).alias("_m"), F.max(by).alias("_top"), F.sum(by).alias("_s"), F.count(F.lit(1)).alias("_n"))
    others = F.try_divide(F.col("_s") - F.col("_top"), F.col("_n") - 1)
    spike = ((F.col("_m") > 0) & (F.col(by) > 3 * F.col("_m"))) | ((F.col(by) == F.col("_top")) & (others > 0) & (F.col("_top") / others > 10))
    return importance.crossJoin(F.broadcast(g)).select("feature", by, F.coalesce(spike, F.lit(False)).alias("spike"))

"""Calibration: bins by expression, one aggregate, rules over the small result.

Rows whose label or score is null or NaN take no part; a null group is a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import ratio, r6, valid


def reliability(df: DataFrame, y_true="y_true", y_prob="y_prob", bins: int = 10, by=(), half_open: bool = False) -> DataFrame:
    """CA1 (CA2 with half_open, which drops a probability of 1): count, mean probability and share of positives by bin."""
    p = F.least(F.greatest(F.col(y_prob), F.lit(0.0)), F.lit(1.0))
    df = valid(df, y_true, y_prob)
    rows = df.where(F.col(y_prob) < 1) if half_open else df
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_prob"), F.avg(F.col(y_true).cast("double")).alias("frac_pos"))


def errors(curve: DataFrame, by=()) -> DataFrame:
    """CA3, CA4: expected and maximal calibration error over a reliability curve."""
    gap = F.abs(F.col("frac_pos") - F.col("mean_prob"))
    return curve.groupBy(*by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), F.sum("n").alias("n"))


def brier(df: DataFrame, y_true="y_true", y_prob="y_prob", by=()) -> DataFrame:
    """CA5: Brier score and skill against the base rate (0 where the base score is 0)."""
    y, p = F.col(y_true).cast("double"), F.col(y_prob)
    g = valid(df, y_true, y_prob).groupBy(*by).agg(F.avg((p - y) * (p - y)).alias("b"), F.var_pop(y).alias("base"))
    return g.select(*by, r6("b").alias("brier"), r6(F.coalesce(1 - ratio("b", "base"), F.lit(0.0))).alias("skill"))


def compare(df: DataFrame, before: str, after: str, y_true="y_true", bins: int = 10) -> DataFrame:
    """CA9: errors of two score columns in one unpivoted pass, their changes (before less after) and whether ECE fell."""
    long = df.select(y_true, before, after).unpivot([y_true], [before, after], "score", "p")
    e = errors(reliability(long, y_true, "p", bins, by=["score"]), ["score"])
    t = e.join(brier(long, y_true, "p", by=["score"]), "score").select("score", r6("ece").alias("ece"), r6("mce").alias("mce"), "brier", "skill")
    of = lambda c, s: F.max(F.when(F.col("score") == s, F.col(c)))
    change = t.agg(*[r6(of(c, before) - of(c, after)).alias(f"{c}_change") for c in ("ece", "mce", "brier", "skill")])
    return t.crossJoin(F.broadcast(change)).withColumn("improved", F.col("ece_change") > 0)


def by_group(df: DataFrame, group: str, y_true="y_true", y_prob="y_prob", bins: int = 10) -> DataFrame:
    """CA10: ECE of each group with the worst group and the gap."""
    e = errors(reliability(df, y_true, y_prob, bins, by=[group]), [group])
    top = e.agg(F.max_by(group, F.struct("ece", group)).alias("worst_group"), (F.max("ece") - F.min("ece")).alias("gap"))
    return e.crossJoin(F.broadcast(top)).select(F.col(group).alias("grp"), "n", r6("ece").alias("ece"), "worst_group", r6("gap").alias("ece_gap"))


def rating(ece: Column) -> Column:
    """CA11: EXCELLENT, GOOD, MODERATE or POOR."""
    return F.when(ece < 0.02, "EXCELLENT").when(ece < 0.05, "GOOD").when(ece < 0.10, "MODERATE").otherwise("POOR")


def severity(ece: Column) -> Column:
    return F.when(ece < 0.02, "NONE").when(ece < 0.05, "LOW").when(ece < 0.10, "MEDIUM").otherwise("HIGH")

"""Data of charts: binned means, histograms, boxes, series; drawing is not built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import join_on, quantiles, r6, valid


def mean_by_category(df: DataFrame, x: str, y: str) -> DataFrame:
    """CH2: count and mean of y in each category of x."""
    return df.groupBy(F.col(x).alias("category")).agg(F.count(y).alias("n"), r6(F.avg(y)).alias("mean"))


def histogram(df: DataFrame, value: str, by=(), bins: int = 30) -> DataFrame:
    """CH3: rows in each equal-width bin of a group's joint range; the largest value falls into the last bin. ``by`` names the
    groups that have a range of their own first, then an optional colour."""
    own, rows = list(by[:1]), valid(df, value)
    ends = rows.groupBy(*own).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    rows = join_on(rows, ends, own) if own else rows.crossJoin(F.broadcast(ends))
    at = F.coalesce(F.try_divide((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return rows.groupBy(*by, F.least(F.floor(at), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def boxes(df: DataFrame, by: str, value: str) -> DataFrame:
    """CH4: quartiles, whiskers (the last values within 1.5 box lengths of the box) and the number of values beyond them."""
    rows = valid(df, value)
    q = quantiles(rows.groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), [by], "v", [0.25, 0.5, 0.75])
    q = q.select(by, *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)])
    v, reach = F.col(value).cast("double"), 1.5 * (F.col("q3") - F.col("q1"))
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    g = join_on(rows, q, [by]).groupBy(by).agg(*[F.first(f"q{i}").alias(f"q{i}") for i in (1, 2, 3)], F.min(F.when(inside, v)).alias("lo"), F.max(F.when(inside, v)).alias("hi"), F.count_if(~inside).alias("outliers"))
    return g.select(by, r6("q1").alias("p25"), r6("q2").alias("median"), r6("q3").alias("p75"), r6("lo").alias("whisker_low"), r6("hi").alias("whisker_high"), "outliers")


def line(df: DataFrame, x: str, y: str) -> DataFrame:
    """CH5: mean y at each x, sorted by x (a range-partitioned sort)."""
    return df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(y)).alias("y")).orderBy(x)


def calibration_residuals(curve: DataFrame) -> DataFrame:
    """CH7: share of positives less mean probability in each bin of a reliability curve."""
    return curve.select("bin", r6(F.col("frac_pos") - F.col("mean_prob")).alias("residual"))


def ranked(scores: DataFrame, name: str, score: str) -> DataFrame:
    """CH8: a table of a row a feature, ranked by a score (ties by name)."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(score), name)
    return scores.select(name, score, F.row_number().over(order).alias("rank"))


def label_integrity(flags: DataFrame, flag: str = "is_issue") -> DataFrame:
    """CH9: rows that are clean and rows whose label is suspected; a null flag is clean."""
    return flags.groupBy(F.when(F.col(flag), "suspected").otherwise("clean").alias("status")).agg(F.count(F.lit(1)).alias("n"))

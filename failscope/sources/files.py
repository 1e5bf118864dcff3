"""Sinks of findings and a scan of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_findings(found: DataFrame, path: str) -> None:
    """IO5: findings as JSON lines, in a folder a module."""
    found.write.partitionBy("module").mode("overwrite").json(path)


def shown(value: Column) -> Column:
    """A double rounded to six decimals as text, as DuckDB writes it: the shortest digits, plain from 0.0001 to under 1e16, else
    with an exponent of two digits (Spark's own text turns to E notation under 0.001 and from 1e7)."""
    v = F.round(value.cast("double"), 6)
    own, size = v.cast("string"), F.abs(v)
    digits = F.regexp_replace(F.regexp_replace(own, "\\.0(?=E)", ""), "E.*", "")
    power = F.regexp_extract(own, "E(-?)([0-9]+)", 2)
    e = F.concat(digits, F.when(size < 1, "e-").otherwise("e+"), F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
    plain = F.regexp_replace(v.cast("decimal(38,6)").cast("string"), "(\\.[0-9]+?)0*$", "$1")
    odd = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    return F.coalesce(odd, F.when((size >= 1e-3) & (size < 1e7), own).when((v == 0) | (size < 1e-4) | (size >= 1e16), F.when(v == 0, own).otherwise(e)).otherwise(plain))


def export_summary(found: DataFrame) -> DataFrame:
    """IO6: (Metric, Value) of every finding, sorted, for ``write.csv(header=True)``."""
    name = F.concat_ws(" ", "module", F.when(F.col("feature") != "all", F.col("feature")), "metric")
    return found.select(name.alias("Metric"), shown(F.col("value")).alias("Value")).orderBy("Metric")


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """IO7: ts, level and message of lines "ts - level - message"; any other line is an INFO message as it is."""
    parts = F.split(column, " - ", 3)
    whole = F.size(parts) == 3
    return lines.select(F.when(whole, parts[0]).alias("ts"), F.when(whole, F.upper(F.trim(parts[1]))).otherwise("INFO").alias("level"), F.when(whole, parts[2]).otherwise(F.col(column)).alias("message"))


def search_log(parsed: DataFrame, level: str | None = None, text: str | None = None, limit: int = 100) -> DataFrame:
    """IO7: the newest lines of a level that hold a text, whatever its case; lines without a time come last."""
    on: Column = F.lit(True)
    if level:
        on = on & (F.col("level") == level.upper())
    if text:
        on = on & F.contains(F.lower("message"), F.lit(text.lower()))
    return parsed.where(on).orderBy(F.desc_nulls_last("ts"), "message").limit(limit)


def read_log(spark: SparkSession, path: str, **search) -> DataFrame:
    return search_log(parse_log(spark.read.text(path)), **search)

"""Rollups of activity logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, ts: str = "ts", days: int = 7) -> DataFrame:
    """WK1: events of each of the last ``days`` days up to the last event, days without one counting 0."""
    e = events.select(F.to_date(ts).alias("day"))
    last = e.agg(F.max("day").alias("last"))
    spine = last.where("last is not null").select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    counts = e.join(F.broadcast(last), F.col("day") > F.date_sub("last", days)).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def active_users(events: DataFrame, status: str, user: str, since: Column, ts: str = "ts") -> DataFrame:
    """WK2: by status, events and distinct users over all time and since a date."""
    late = F.col(ts) >= since
    return events.groupBy(F.col(status).alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(user).alias("users"), F.count_if(late).alias("n_since"), F.count_distinct(F.when(late, F.col(user))).alias("users_since"))


def search(df: DataFrame, columns: list[str], text: str, order: Column, limit: int | None = None) -> DataFrame:
    """WK3: rows of which a column holds the text, whatever its case, sorted; % and _ are plain characters."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    out = df.where(found).orderBy(order)
    return out if limit is None else out.limit(limit)


def usage(users: DataFrame, key: str, uses: dict[str, DataFrame], latest: str, ts: str, n: int = 3) -> DataFrame:
    """WK4: each user's number of rows in every table of ``uses`` and the times of the ``n`` latest in one of them, newest
    first. Users without any count 0."""
    out = users.select(key)
    for name, table in uses.items():
        out = out.join(table.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}")), key, "left").na.fill(0, [f"n_{name}"])
    order = Window.partitionBy(key).orderBy(F.desc(ts))
    last = uses[latest].select(key, ts).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n)
    last = last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", ts))), lambda x: x[ts]).alias("latest"))
    return out.join(last, key, "left")

"""Exact top-k inner products of whole-number vectors by norm-bucketed retrieval."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, width

#: Lengths in one bucket differ by this factor at most; buckets are numbered by the logarithm of the squared length.
STEP = 1.05
#: Most candidates and most queries of a task, and how many of the longest vectors give the first thresholds.
CANDIDATES, QUERIES, FIRST = 8192, 4096, 1024
#: From this local cosine threshold on, coordinates prune; under it, lengths do. Coordinates looked at for each query.
COORDINATES_FROM, FOCUS = 0.5, 3
#: Queries multiplied with a bucket at once.
AT_ONCE = 64
#: Join keys with few values are spread over so many.
SALTS = 32
#: Slack of bounds in floating point; products themselves are exact.
SLACK = 1e-9


class Bucket:
    """Vectors of similar length, longest first, with what prunes them: lengths, and unit coordinates in sorted order."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        norm = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        by = np.lexsort((ids, -norm))
        self.rows, self.ids, self.norm = rows[by], ids[by], norm[by]
        self.unit = self.rows / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def column(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        if c not in self.columns:
            by = np.argsort(self.unit[:, c], kind="stable")
            self.columns[c] = by, self.unit[by, c]
        return self.columns[c]

    def by_coordinates(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Places that can have at least this cosine with a unit query: on each coordinate their angle to the axis is within
        the cosine's angle of the query's own. The shortest sorted list of the largest coordinates is cut by the others."""
        wide = math.acos(min(1.0, cosine))
        ranges = []
        for c in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            own = math.acos(max(-1.0, min(1.0, unit[c])))
            low, high = math.cos(min(math.pi, own + wide)) - SLACK, math.cos(max(0.0, own - wide)) + SLACK
            by, sorted_ = self.column(int(c))
            ranges.append((by, *np.searchsorted(sorted_, (low, high), ("left")), c, low, high))
        ranges.sort(key=lambda r: r[2] - r[1])
        by, start, end = ranges[0][:3]
        got = by[start:end]
        for _, _, _, c, low, high in ranges[1:]:
            x = self.unit[got, c]
            got = got[(x >= low) & (x <= high)]
        return got

    def by_length(self, least: float) -> int:
        """How many are of at least this length."""
        return int(np.searchsorted(-self.norm, -least * (1 - SLACK), "right"))


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(queries, rows) inner products, exact: in doubles while every sum is a whole number they hold, else in Python's whole
    numbers. One that doesn't fit 64 bits raises OverflowError."""
    if len(rows) and len(queries):
        most = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1).max() * (queries.astype(np.float64) ** 2).sum(axis=1).max())
        if most >= 2.0**52:
            return np.array((queries.astype(object) @ rows.astype(object).T).tolist(), np.int64)
    return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int, least: float) -> np.ndarray:
    """Which of the places have the k largest scores of at least ``least``, ties to smaller ids, in that order."""
    if len(scores) > k:
        least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
    some = np.flatnonzero(scores >= least)
    return some[np.lexsort((ids[places[some]], -scores[some]))[:k]]


def retrieve(bucket: Bucket, queries: np.ndarray, thresholds: np.ndarray, k: int) -> list[tuple[int, int, int, bool]]:
    """(query, id, score, equal) of each query's k best of the bucket that reach its threshold; equal: of one vector.

    A query's local threshold is the cosine that the longest vector of the bucket needs. Over 1 nothing is looked at; where
    it is high, coordinates prune, else only vectors long enough are multiplied. What is left is verified by its product.
    """
    norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(norm * bucket.norm[0] > 0, thresholds / (norm * bucket.norm[0]), -1.0)
        reach = np.where((norm > 0) & (thresholds > 0), thresholds / norm, 0.0)
    out: list[tuple[int, int, int, bool]] = []

    def keep(q: int, scores: np.ndarray, places: np.ndarray) -> None:
        for n in best(scores, bucket.ids, places, k, thresholds[q]):
            p = places[n]
            out.append((q, int(bucket.ids[p]), int(scores[n]), bool((bucket.rows[p] == queries[q]).all())))

    for q in np.flatnonzero((local >= COORDINATES_FROM) & (local <= 1 + SLACK)):
        places = bucket.by_coordinates(queries[q] / norm[q], max(0.0, local[q] - SLACK))
        if len(places):
            keep(q, products(bucket.rows[places], queries[q : q + 1])[0], places)
    low = np.flatnonzero(local < COORDINATES_FROM)
    low = low[np.argsort(-reach[low], kind="stable")]  # those that go equally deep together
    for s in range(0, len(low), AT_ONCE):
        some = low[s : s + AT_ONCE]
        deep = [bucket.by_length(r) for r in reach[some]]
        scores = products(bucket.rows[: max(deep)], queries[some])
        for q, n, row in zip(some, deep, scores):
            if n:
                keep(q, row[:n], np.arange(n))
    return out


def spread(df: DataFrame, small: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """Inner join with a small table on keys of few values: its rows are repeated under SALTS salts, so that no task gets all
    rows of a key."""
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(small, [*keys, "_salt"]).drop("_salt")


def usable(v: str) -> Column:
    """Not null, without null or non-finite components."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _search(dealt: DataFrame, by: list[str], k: int) -> DataFrame:
    """(dim, h1, h2, vec_id, score, equal) of groups that hold queries (query true) and the candidates of a bucket."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        q, rows = part["query"].to_numpy(bool), np.stack(part["vector"].to_numpy()).astype(np.int64)
        names = ["dim", "h1", "h2"]
        if not q.any() or q.all():
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in [*names, "vec_id", "score"]} | {"equal": pd.Series(dtype=bool)})
        if (np.abs(rows.astype(np.float64)) >= 2.0**62).any():
            raise OverflowError("a component times the unit doesn't fit a long")
        own = part[q].reset_index(drop=True)
        found = retrieve(Bucket(rows[~q], part["vec_id"].to_numpy()[~q].astype(np.int64)), rows[q], own["threshold"].fillna(-np.inf).to_numpy(np.float64), k)
        at, ids, scores, equal = (np.array(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        return own.loc[at, names].reset_index(drop=True).assign(vec_id=ids, score=scores, equal=equal)

    # a group is a block of bounded size; as many partitions keep them apart
    dealt = dealt.repartition(2 * width(dealt.sparkSession), *by)
    return dealt.groupBy(*by).applyInPandas(run, "dim int, h1 bigint, h2 int, vec_id bigint, score bigint, equal boolean")


def top_products(emb: DataFrame, is_query: Column, k: int = 5, unit: float = 256.0, candidates: int = CANDIDATES, queries: int = QUERIES, first: int = FIRST) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query row's k rows of largest inner product but its own, exactly, where
    a component x counts as floor(unit * x).

    Vectors are grouped into buckets by length. All queries meet the longest vectors first, which gives each a threshold (the
    score it has to beat); then only those buckets are joined whose longest vector can reach it. Queries are dealt into
    blocks by how short a vector can still reach their threshold, so block and bucket meet only where some query needs it.
    Every group is a block of bounded size. Of equal vectors the k + 1 smallest vec_ids are candidates (the others cannot be
    among k), and equal queries are searched once and then lose their own row.

    Vectors that are null or hold null or non-finite components, and null vec_ids, take no part; zero vectors do. Vectors meet
    those of their length; those without components have products of 0. Rows that share a vec_id are candidates each, for one
    another too. Ties go to the smaller vec_id. Fewer candidates than k: all. A product that doesn't fit 64 bits is an error.
    Other columns are left out. Empty input: no rows.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * unit).cast("bigint"))
    rows = emb.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("_q"), whole.alias("vector"))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.select("vec_id", "_q", "vector", F.size("vector").alias("dim"), F.xxhash64("vector").alias("h1"), F.hash(F.col("vector"), F.lit(3)).alias("h2"), squares.alias("square"))
    rows = cut(rows.withColumn("bucket", F.floor(F.log1p("square") / math.log(STEP * STEP)).cast("int")), "vectors")
    key = ["dim", "h1", "h2"]
    order = F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))
    held = cut(rows.drop("_q").withColumn("_n", order).where(F.col("_n") <= k + 1), "candidates")

    # a row a bucket: its candidates, the longest of them, and how many are in buckets of longer vectors
    longer = Window.partitionBy("dim").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = held.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max("square")).alias("longest"))
    buckets = cut(buckets.withColumn("before", F.coalesce(F.sum("n").over(longer), F.lit(0))).withColumn("parts", F.ceil(F.col("n") / candidates).cast("int")), "buckets")
    part = F.pmod(F.xxhash64("vec_id", "h1", "_n"), "parts").cast("int")
    held = spread(held, buckets, ["dim", "bucket"], F.xxhash64("vec_id")).withColumn("part", part)
    held = held.withColumn("early", (F.col("before") < first) & (F.col("part") == 0)).select("dim", "bucket", "part", "early", "vec_id", "vector")

    asked = rows.where("_q").groupBy(*key).agg(F.first("vector").alias("vector"), F.first("square").alias("square"))
    sizes = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / queries).cast("int").alias("blocks"))
    asked = cut(spread(asked, sizes, ["dim"], F.col("h1")).withColumn("block", F.pmod("h1", "blocks").cast("int")), "queries")
    no_key = [F.lit(0).cast("bigint").alias("h1"), F.lit(0).alias("h2")]
    as_query = [*key, F.lit(True).alias("query"), F.lit(None).cast("bigint").alias("vec_id"), "vector"]
    as_candidate = ["dim", *no_key, F.lit(False).alias("query"), "vec_id", "vector"]
    none = F.lit(None).cast("double").alias("threshold")

    # first round: every block of queries against the longest vectors
    blocks = asked.select("dim", "block").distinct()
    early = spread(held.where("early"), blocks, ["dim"], F.xxhash64("vec_id"))
    start = _search(asked.select("block", *as_query, none).unionByName(early.select("block", *as_candidate, none)), ["dim", "block"], k + 1)
    start = cut(start, "first_round")

    # second round: blocks of queries of like reach, against the buckets that one of them can need
    found = start.groupBy(*key).agg(F.when(F.count(F.lit(1)) > k, F.min("score")).cast("double").alias("threshold"))
    asked = asked.drop("block", "blocks").join(found, key, "left")
    reach = F.when((F.col("threshold") > 0) & (F.col("square") > 0), F.col("threshold") / F.sqrt("square")).otherwise(F.lit(0.0))
    asked = asked.withColumn("reach", reach).withColumn("level", F.floor(F.log1p(F.col("reach") * F.col("reach")) / math.log(STEP * STEP)).cast("int"))
    levels = asked.groupBy("dim", "level").agg(F.ceil(F.count(F.lit(1)) / queries).cast("int").alias("blocks"), F.min("reach").alias("least"))
    levels = cut(levels, "levels")
    asked = spread(asked, levels.drop("least"), ["dim", "level"], F.col("h1")).withColumn("block", F.pmod("h1", "blocks").cast("int"))
    needs = levels.join(buckets.select("dim", "bucket", "parts", "longest"), "dim").where(F.col("longest") * (1 + SLACK) >= F.col("least"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    wanted = needs.select("dim", "level", "bucket", "longest", each("parts").alias("part"))
    late = spread(asked, wanted, ["dim", "level"], F.col("h1")).where(F.col("longest") * (1 + SLACK) >= F.col("reach"))
    more = spread(held.where("not early"), needs.select("dim", "level", "bucket", each("blocks").alias("block")), ["dim", "bucket"], F.xxhash64("vec_id"))
    by = ["dim", "level", "block", "bucket", "part"]
    place = ["level", "block", "bucket", "part"]
    later = _search(late.select(*place, *as_query, "threshold").unionByName(more.select(*place, *as_candidate, none)), by, k + 1)

    nearest = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id", F.desc("equal"))
    merged = start.unionByName(later).withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k + 1)
    lists = merged.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score", "equal"))).alias("list"))
    out = rows.where("_q").select(F.col("vec_id").alias("query_id"), *key).join(lists, key)
    own = F.array_position(F.transform("list", lambda r: F.when(r["equal"], r["vec_id"])), F.col("query_id"))
    kept = F.slice(F.filter("list", lambda r, i: i != own - 1), 1, k)
    return out.select("query_id", F.posexplode(kept).alias("_p", "_r")).select("query_id", (F.col("_p") + 1).alias("rank"), "_r.vec_id", "_r.score")

"""Nearest neighbours by inner product: a block matrix join over int8 tiles with error bounds."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, width
from .lattice import usable

#: Queries and candidates of a block pair, and candidates multiplied at once.
QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 4096, 8192, 2048
#: Queries of a block that meet a tile at once, and components of pairs that are recomputed at once.
QUERIES_AT_ONCE, RECOMPUTED = 512, 1 << 20


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, length of the quantised vector and length of the rest, for each row."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


def nearest(queries: np.ndarray, query_rows: np.ndarray, rows: np.ndarray, row_keys: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query row, id, score) of the k largest inner products of each query, ties to the smaller id, own row left out.

    A tile's int8 products differ from the true ones by at most |q'||r - r'| + |q - q'||r|; a pair whose upper bound is
    under the k-th largest lower bound met so far cannot be among the k. The others are recomputed in double precision
    and go into a heap for each query.
    """
    found = []
    for s in range(0, len(queries), QUERIES_AT_ONCE):
        own = slice(s, s + QUERIES_AT_ONCE)
        found += _nearest(queries[own], query_rows[own], rows, row_keys, ids, k)
    return found


def _nearest(queries, query_rows, rows, row_keys, ids, k) -> list[tuple[int, int, float]]:
    wide = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products stay exact
    qi, qs, qn, qe = quantised(queries)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(queries))]
    floor = np.full(len(queries), -np.inf)
    step = max(1, RECOMPUTED // max(1, queries.shape[1]))
    for s in range(0, len(rows), TILE):
        part, own = rows[s : s + TILE], ids[s : s + TILE]
        keys = row_keys[s : s + TILE]
        ri, rs, _, re = quantised(part)
        rn = np.sqrt((part * part).sum(axis=1))
        near = (qi.astype(wide) @ ri.astype(wide).T).astype(np.float64) * qs[:, None] * rs[None, :]
        slack = qn[:, None] * re[None, :] + qe[:, None] * rn[None, :]
        slack += 1e-12 * (qn + qe)[:, None] * rn[None, :]
        self_ = query_rows[:, None] == keys[None, :]
        low = np.where(self_, -np.inf, near - slack)
        if low.shape[1] >= k:
            floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        i, j = np.nonzero((near + slack >= floor[:, None]) & ~self_)
        for at in range(0, len(i), step):
            a_, b_ = i[at : at + step], j[at : at + step]
            score = np.einsum("ij,ij->i", queries[a_], part[b_])
            for a, b, v in zip(a_.tolist(), own[b_].tolist(), score.tolist()):
                heap = heaps[a]
                if len(heap) < k:
                    heapq.heappush(heap, (v, -b))
                elif (v, -b) > heap[0]:
                    heapq.heapreplace(heap, (v, -b))
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
    return [(int(q), -b, v) for q, heap in zip(query_rows, heaps) for v, b in heap]


def neighbours(emb: DataFrame, is_query: Column, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k rows of largest inner product but its own, exactly.

    Queries and candidates are dealt into blocks of bounded size by a hash of vec_id, and every block of queries meets
    every block of candidates in a task of its own; each pair returns at most k rows a query, which are then merged.
    Vectors that are null, zero or hold null or non-finite components, and null vec_ids, take no part. Vectors meet those
    of their length. Of equal vectors only k + 1 are candidates, and pairs are recomputed in parts of bounded size, so copies
    cost no memory. Rows that share a vec_id are candidates each, for one another too, and queries each; ties go to the
    smaller vec_id (between rows of one vec_id and score there is nothing to tell apart). Fewer candidates than k: all.
    Other columns are left out. Empty input: no rows.
    """
    spark = emb.sparkSession
    rows = emb.where(usable("embedding") & F.col("vec_id").isNotNull()).withColumn("_q", is_query).select("vec_id", "embedding", "_q")
    # equal rows are told apart by a number, so a row is the same wherever it is computed again
    rows = rows.groupBy("vec_id", "embedding").agg(F.max("_q").alias("_q"), F.count(F.lit(1)).cast("int").alias("n"))
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("row", F.xxhash64("vec_id", "embedding", "n")).withColumn("dim", F.size("embedding"))
    # of equal vectors the k + 1 of smallest vec_id are candidates: the others come after k that are not the query
    equal = Window.partitionBy(F.xxhash64("embedding"), F.hash(F.col("embedding"), F.lit(3))).orderBy("vec_id", "n")
    rows = cut(rows.withColumn("_c", F.row_number().over(equal) <= k + 1).where("_q or _c").select("row", "vec_id", "embedding", "_q", "_c", "dim"), "rows")
    size = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("_q").alias("nq"))
    size = size.select("dim", F.ceil(F.col("n") / candidate_block).cast("int").alias("cbs"), F.greatest(F.lit(1), F.ceil(F.col("nq") / query_block)).cast("int").alias("qbs"))
    rows = rows.join(size, "dim")
    block = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = rows.where("_q").select("dim", block("qbs", 1).alias("qb"), each("cbs").alias("cb"), F.lit(True).alias("query"), "row", "vec_id", "embedding")
    others = rows.where("_c").select("dim", each("qbs").alias("qb"), block("cbs", 2).alias("cb"), F.lit(False).alias("query"), "row", "vec_id", "embedding")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, row, ids, q = np.stack(part["embedding"].to_numpy()).astype(np.float64), part["row"].to_numpy(), part["vec_id"].to_numpy(), part["query"].to_numpy(bool)
        got = nearest(x[q], row[q], x[~q], row[~q], ids[~q], k) if q.any() and not q.all() else []
        out = pd.DataFrame(got, columns=["row", "vec_id", "score"]).astype({"row": "int64", "vec_id": "int64", "score": "float64"})
        return out.assign(query_id=out["row"].map(dict(zip(row[q].tolist(), ids[q].tolist()))).astype("int64"))

    dealt = queries.unionByName(others).repartition(2 * width(spark), "dim", "qb", "cb")  # block pairs stay spread out
    found = dealt.groupBy("dim", "qb", "cb").applyInPandas(run, "row bigint, vec_id bigint, score double, query_id bigint")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")

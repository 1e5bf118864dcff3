"""Exact nearest neighbours by a join over a partition of space.

Points are filed in the leaves of a tree of median cuts. A point's neighbours among those filed with it bound how far its
true neighbours can be; it is then sent to every other leaf that comes as near as that, and no further; most points are sent
nowhere, and are done. Equal points are one class, of which the first k + 1 keys can be neighbours, so ties cost no more than
other points; leaves with many points are dealt into tiles of bounded size. What is wanted of a neighbour travels with its
point, so nothing is joined to the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import valid, written

#: Points of a leaf on average, and most leaves (the tree is what every task holds: 16 bytes and two corners a node).
LEAF_ROWS, LEAVES = 1024, 1 << 17
#: Points that the cuts are taken from, for each leaf; and most points of one tile.
SAMPLE, TILE = 16, 2048
#: Points compared with a tile at once.
AT_ONCE = 128


def cuts(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, at) of a full binary tree as a heap from 1, for a power of two of leaves: a node cuts its widest axis at the
    median of its part of the sample; a point goes left where its coordinate is at most that."""
    axis, at = np.zeros(leaves, np.int32), np.full(leaves, np.inf)
    parts = {1: sample}
    for node in range(1, leaves):
        part = parts.pop(node, sample[:0])
        if len(part):
            axis[node] = (part.max(axis=0) - part.min(axis=0)).argmax()
            middle = (len(part) - 1) // 2
            at[node] = np.partition(part[:, axis[node]], middle)[middle]
        left = part[:, axis[node]] <= at[node]
        parts[2 * node], parts[2 * node + 1] = part[left], part[~left]
    return axis, at


def leaf_of(x: np.ndarray, axis: np.ndarray, at: np.ndarray) -> np.ndarray:
    node = np.ones(len(x), np.int64)
    while len(x) and node[0] < len(axis):
        node = 2 * node + (x[np.arange(len(x)), axis[node]] > at[node])
    return node


def near_leaves(x: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, leaf) of all leaves whose box (corners of each node of the heap; empty: low over high) is within the squared
    reach of a point, found from the root down."""
    point, node, leaves = np.arange(len(x)), np.ones(len(x), np.int64), len(low) // 2
    while len(node):
        gap = np.maximum(np.maximum(low[node] - x[point], x[point] - high[node]), 0.0)
        near = (gap * gap).sum(axis=1) <= reach[point]
        point, node = point[near], node[near]
        if not len(node) or node[0] >= leaves:
            break
        point, node = np.concatenate([point, point]), np.concatenate([2 * node, 2 * node + 1])
    return point, node


def _best(x: np.ndarray, keys: np.ndarray, points: np.ndarray, k: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, place, squared distance) of each point's k nearest of x, ties to smaller keys (places are in order of keys); if
    given, only of those within the point's squared reach."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    by = np.argsort(keys, kind="stable")
    x = x[by]
    for s in range(0, len(points), AT_ONCE):
        d = np.zeros((len(points[s : s + AT_ONCE]), len(x)))
        for c in range(x.shape[1]):  # summed axis by axis, so a distance is the same wherever it is computed
            gap = points[s : s + AT_ONCE, c][:, None] - x[:, c][None, :]
            d += gap * gap
        own = None if reach is None else reach[s : s + AT_ONCE]
        if own is not None and np.isfinite(own).all():
            i, j = np.nonzero(d <= own[:, None])
        elif len(x) > k:
            least = np.partition(d, k - 1, axis=1)[:, k - 1]
            i, j = np.nonzero(d <= (least if own is None else np.minimum(least, own))[:, None])
        else:
            i, j = np.divmod(np.arange(d.size), len(x))
        order = np.lexsort((j, d[i, j], i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        out.append((i[keep] + s, by[j[keep]], d[i[keep], j[keep]]))
    return tuple(np.concatenate(a) for a in zip(*out))


def _columns(part: pa.Table | pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [part[c].to_numpy() if isinstance(part, pa.Table) else part[c].to_numpy(zero_copy_only=False) for c in names]


def _lists(rows: int, of: np.ndarray, **values: np.ndarray) -> pa.ListArray:
    """An array of structs for each of so many rows; of, in order, names the row of each struct."""
    ends = np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(v) for v in values.values()], list(values)))


def nearest(df: DataFrame, features: list[str], key: str, k: int = 5, leaf_rows: int = LEAF_ROWS, tile: int = TILE) -> DataFrame:
    """(key, rank from 1, neighbour, d2): the k rows of least squared distance to each row but itself, exactly; ties go to the
    smaller key. Keys are whole numbers, one to a row.

    Rows with a null or NaN feature take no part. Fewer than k other rows: all of them. The tree's cuts come from a bounded
    sample; whatever they are, the result is exact.
    """
    d = valid(df, *features).where(F.col(key).isNotNull())
    d = written(d.select(F.col(key).cast("bigint").alias("k"), F.lit(0.0).alias("v"), *[(F.col(c).cast("double") + 0.0).alias(f"x{i}") for i, c in enumerate(features)]))
    out = near_lists(d, len(features), k, leaf_rows, tile).select("k", F.posexplode("near").alias("rank", "r"))
    return out.select(F.col("k").alias(key), (F.col("rank") + 1).alias("rank"), F.col("r.k").alias("neighbour"), F.col("r.d2").alias("d2"))


def near_lists(d: DataFrame, features: int, k: int = 5, leaf_rows: int = LEAF_ROWS, tile: int = TILE) -> DataFrame:
    """(k, v, near) of every row of a written table (k bigint, v double, x0, x1, ... double, none null or NaN): near holds
    (d2, k, v) of the rows that :func:`nearest` finds, in order. v is any value that is wanted of neighbours."""
    spark, names = d.sparkSession, [f"x{i}" for i in range(features)]
    order = F.row_number().over(Window.partitionBy(*names).orderBy("k"))
    held = written(d.withColumn("n", order).where(F.col("n") <= k + 1))  # of equal points those that can be neighbours
    n = held.count()
    leaves = 1 << max(0, min(LEAVES, math.ceil(n / leaf_rows)) - 1).bit_length()
    share = min(1.0, 2.0 * SAMPLE * leaves / max(1, n))
    sample = held.where(F.abs(F.xxhash64("k", F.lit(5)) % 1_000_000) < share * 1_000_000).select(*names).limit(4 * SAMPLE * leaves).toArrow()
    shared = spark.sparkContext.broadcast(cuts(np.stack(_columns(sample, names), axis=1), leaves))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = leaf_of(np.stack(_columns(b, names), axis=1), *shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "leaf"])

    point = "k bigint, v double, " + ", ".join(f"{c} double" for c in names)
    filed = written(held.select("k", "v", *names, "n").mapInArrow(file, f"{point}, n int, leaf bigint"))
    sizes = written(filed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / tile).cast("bigint").alias("tiles"), *[f(c).alias(f"{e}{c}") for c in names for e, f in (("lo", F.min), ("hi", F.max))]))
    boxes = sizes.toArrow()  # at most LEAVES rows
    low, high, tiles = np.full((2 * leaves, features), np.inf), np.full((2 * leaves, features), -np.inf), np.zeros(2 * leaves, np.int64)
    (at,), (tiles_,) = _columns(boxes, ["leaf"]), _columns(boxes, ["tiles"])
    tiles[at] = tiles_
    for i, c in enumerate(names):
        low[at, i], high[at, i] = _columns(boxes, [f"lo{c}", f"hi{c}"])
    level = leaves // 2
    while level:
        low[level : 2 * level] = np.minimum(low[2 * level : 4 * level : 2], low[2 * level + 1 : 4 * level : 2])
        high[level : 2 * level] = np.maximum(high[2 * level : 4 * level : 2], high[2 * level + 1 : 4 * level : 2])
        level //= 2
    corners = spark.sparkContext.broadcast((low, high, tiles))
    dealt = filed.join(F.broadcast(sizes.where("tiles > 1").select("leaf", "tiles")), "leaf", "left")
    dealt = dealt.withColumn("tile", F.coalesce(F.pmod(F.xxhash64(*names), F.col("tiles")), F.lit(0)))  # equal points stay together

    def inside(part: pa.Table) -> pa.Table:
        x = np.stack(_columns(part, names), axis=1)
        n, keys, values, leaf, tile_ = _columns(part, ["n", "k", "v", "leaf", "tile"])
        by = np.lexsort((n, *x.T))  # the classes, each with its keys in order
        x, n, keys, values = x[by], n[by], keys[by], values[by]
        own = np.flatnonzero(n == 1)
        i, j, d2 = _best(x, keys, x[own], k + 1)  # a class is searched for once
        count = np.bincount(i, minlength=len(own))
        reach = np.where(count > k, d2[np.cumsum(count) - 1], np.inf)
        low, high, tiles = corners.value
        p, to = near_leaves(x[own], reach * (1 + 1e-12), low, high)
        times = tiles[to]
        p, to, first = np.repeat(p, times), np.repeat(to, times), np.repeat(np.cumsum(times) - times, times)
        t = np.arange(len(p)) - first
        other = (to != leaf[0]) | (t != tile_[0])
        p, to, t = p[other], to[other], t[other]
        order = np.argsort(p, kind="stable")
        columns = [pa.array(keys[own]), pa.array(reach), *[pa.array(np.ascontiguousarray(x[own, c])) for c in range(features)], _lists(len(own), np.cumsum(n == 1) - 1, k=keys, v=values),
                   _lists(len(own), i, d2=d2, k=keys[j], v=values[j]), _lists(len(own), p[order], leaf=to[order], tile=t[order])]
        return pa.Table.from_arrays(columns, ["k", "reach", *names, "members", "near", "sent"])

    near = "near array<struct<d2:double,k:bigint,v:double>>"
    held_by = f"k bigint, reach double, {', '.join(f'{c} double' for c in names)}, members array<struct<k:bigint,v:double>>, {near}, sent array<struct<leaf:bigint,tile:bigint>>"
    first = written(dealt.groupBy("leaf", "tile").applyInArrow(inside, held_by))
    sent = first.select("k", "reach", *names, F.explode("sent").alias("s")).select("k", "reach", *names, "s.leaf", "s.tile")

    def elsewhere(points: pa.Table, part: pa.Table) -> pa.Table:
        x, p = np.stack(_columns(part, names), axis=1), np.stack(_columns(points, names), axis=1)
        (own, reach), (keys, values) = _columns(points, ["k", "reach"]), _columns(part, ["k", "v"])
        i, j, d2 = _best(x, keys, p, k + 1, reach) if len(p) and len(x) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        met, at = np.unique(i, return_inverse=True)
        return pa.Table.from_arrays([pa.array(own[met]), _lists(len(met), at, d2=d2, k=keys[j], v=values[j])], ["k", "near"])

    more = sent.groupBy("leaf", "tile").cogroup(dealt.select("k", "v", *names, "leaf", "tile").groupBy("leaf", "tile")).applyInArrow(elsewhere, f"k bigint, {near}")
    every = first.where(F.size("sent") > 0).select("k", "members", "near").unionByName(more, allowMissingColumns=True)
    merged = every.groupBy("k").agg(F.first("members", ignorenulls=True).alias("members"), F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    classes = first.where(F.size("sent") == 0).select("members", "near").unionByName(merged.select("members", F.slice("near", 1, k + 1).alias("near")))
    others = F.slice(F.filter("near", lambda r: r["k"] != F.col("m.k")), 1, k)
    out = classes.select(F.explode("members").alias("m"), "near").select("m.k", "m.v", others.alias("near"))
    if d.count() == n:
        return out
    # copies beyond the first k + 1 have the first k of them beside them
    full = held.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("last"), F.array_sort(F.collect_list(F.struct(F.lit(0.0).alias("d2"), "k", "v"))).alias("near"))
    full = full.where(F.col("n") == k + 1).select(*names, "last", F.slice("near", 1, k).alias("near"))
    return out.unionByName(d.join(full, names).where("k > last").select("k", "v", "near"))

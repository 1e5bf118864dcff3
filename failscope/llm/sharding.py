"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

#: Hash buckets that number a shard's rows in parallel.
BUCKETS = 4096

Tree = list[list[list[int]]]


def layout(shards: int, base: int = 24, regions: int = 2, racks: int = 3) -> Tree:
    """Regions of racks of shards: the first ``base`` shards fill regions evenly, each later one is a region of its own.

    A shard that is added so changes the weights below the root only, and all that moves goes into it.
    """
    per = -(-base // (regions * racks))
    rack = lambda r, k: [s for s in range(min(base, shards)) if s // (per * racks) == r and s // per % racks == k]
    tree = [[x for k in range(racks) if (x := rack(r, k))] for r in range(regions)]
    return [r for r in tree if r] + [[[s]] for s in range(base, shards)]


def _pick(key: Column, level: int, nodes: list[tuple[int, float]]) -> Column:
    """The node with the least exponential draw, at a rate of its weight: chances in proportion to weights.

    A draw depends on key, level and node alone, so a node whose weight grows only wins keys, from all its siblings.
    """

    def draw(node: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 11)
        return -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(weight)

    if len(nodes) == 1:
        return F.lit(nodes[0][0])
    return F.least(*[F.struct(draw(n, w).alias("d"), F.lit(n).alias("n")) for n, w in nodes])["n"]


def assign(df: DataFrame, key: Column, tree: Tree, name: str, weights: dict[int, float] | None = None) -> DataFrame:
    """df with the shard of a key: descend region, rack and shard. A node is named by its first shard and weighs as much
    as its shards together (1 each unless given); a weight that changes moves keys only into or out of its subtree."""
    w = lambda shards: float(sum((weights or {}).get(s, 1.0) for s in shards))
    region, rack_, = fresh(df, "region", "rack")
    df = df.withColumn(region, _pick(key, 1, [(r[0][0], w([s for k in r for s in k])) for r in tree]))
    rack = leaf = F.lit(None).cast("int")
    for r in tree:
        rack = F.when(F.col(region) == r[0][0], _pick(key, 2, [(k[0], w(k)) for k in r])).otherwise(rack)
        for k in r:
            leaf = F.when(F.col(rack_) == k[0], _pick(key, 3, [(s, w([s])) for s in k])).otherwise(leaf)
    return df.withColumn(rack_, rack).withColumn(name, leaf.cast("int")).drop(region, rack_)


def numbered(df: DataFrame, group: str, order: list, salt: Column, name: str) -> DataFrame:
    """df with a number from 0 without gaps in each group, in two levels so that a large group spreads over BUCKETS tasks."""
    bucket, earlier, i = fresh(df, "bucket", "before", "i")
    df = df.withColumn(bucket, F.pmod(salt, F.lit(BUCKETS)).cast("int"))
    cells = df.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(group, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(earlier))
    inner = Window.partitionBy(group, bucket).orderBy(*order)
    out = df.withColumn(i, F.row_number().over(inner)).join(cells, [group, bucket])
    return out.withColumn(name, (F.col(earlier) + F.col(i) - 1).cast("bigint")).drop(bucket, earlier, i)


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """docs plus shard, grown_shard (with one more shard), slot (from 0 without gaps in its shard), size and text_crc32.

    doc_id and the number of shards decide alone: rows of equal doc_id share a shard, a null doc_id has a fixed one.
    size is the text's UTF-8 bytes (null: none) plus 8; text_crc32 of a null text is that of no bytes. Repeated rows each
    get a slot. Slots follow the hash bucket, then doc_id, then the text's hash. Very long texts count whole. Empty input: no rows.
    Columns of docs are kept, but for those named like one that is added, which are replaced.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0"))
    out = assign(docs, key, layout(shards), "shard")
    out = assign(out, key, layout(shards + 1), "grown_shard")
    out = out.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint"))
    return out.withColumn("text_crc32", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))


def with_slots(sharded: DataFrame) -> DataFrame:
    """Adds slot; only the columns at hand are shuffled, so drop texts first where they are not needed."""
    return numbered(sharded, "shard", ["doc_id", "text_crc32", "size"], F.xxhash64("doc_id", "text_crc32"), "slot")

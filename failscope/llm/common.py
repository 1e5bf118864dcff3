"""Helpers that several operators share: lineage cuts, bounded tiles, ordered groups, union-find over edges."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Largest number of rows of one group that a task compares at once; larger groups are split into pairs of tiles.
TILE_ROWS = 4096
#: Bytes of a slice of documents that a Python worker takes at once.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one in the warehouse (which a cluster shares as well)
    where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/failscope-shared"
    return base.rstrip("/")


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about so many bytes (one row at least), so that what a worker makes of them
    at once does not grow with the length of the texts."""
    for b in batches:
        if not b.num_rows:
            continue
        rows = max(1, int(b.num_rows * size // max(1, b.nbytes)))
        if rows >= b.num_rows:
            yield b
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b["text"]), 0)), dtype=np.int64) if "text" in b.schema.names else np.arange(1, b.num_rows + 1) * (size // rows)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, end - at)
            at = end


def in_slices(docs: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas over slices of bounded size; whole numbers stay whole where some are null."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}
        for frame in run(b.to_pandas(types_mapper=whole.get) for b in slices(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema=kind, preserve_index=False)

    return docs.mapInArrow(over, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
        taken.add(n.lower())
    return out


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/failscope-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like :func:`cut`, in buckets of the key, which later joins and groups by the key need not shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/failscope-{spark.sparkContext.applicationId}/{table}"
    df.write.bucketBy(width(spark), key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions to deal keys over."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """From batches sorted by keys, runs of whole groups: only the last group of a batch waits for the next batch.

    Memory is bounded by a batch and the largest group, which the callers bound by tiling.
    """
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[keys].iloc[-1]
        tail = (batch[keys] == last).all(axis=1).to_numpy()
        start = len(tail) - int(tail[::-1].argmin()) if not tail.all() else 0
        if start:
            rest.append(batch.iloc[:start])
            yield pd.concat(rest, ignore_index=True)
            rest = [batch.iloc[start:]]
        elif rest and (rest[-1][keys].iloc[-1] != last).any():
            yield pd.concat(rest, ignore_index=True)
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield pd.concat(rest, ignore_index=True)


def in_tiles(df: DataFrame, group: list[str], salt: Column, rows: int = TILE_ROWS, having: Column | None = None) -> DataFrame:
    """Deal each group's rows into pairs of tiles so that every two rows of a group meet, in tasks of bounded size.

    Adds ``tile_a``, ``tile_b`` (a <= b) and ``tile`` (the row's own). Rows meet in the pair of their tiles; rows of one
    tile meet where a = b. Groups of one row hold no pair and are dropped, as are those for which the aggregate ``having``
    is not true. The count of a group is summed map-side.
    """
    held = having if having is not None else F.lit(True)
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), held.alias("_held")).where("_n > 1 and _held").drop("_held")
    counts = counts.withColumn("_k", F.ceil(F.col("_n") / rows).cast("int")).drop("_n")
    dealt = df.join(counts, group).withColumn("tile", F.pmod(salt, F.col("_k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_o")
    return (
        dealt.select("*", other)
        .withColumn("tile_a", F.least("tile", "_o"))
        .withColumn("tile_b", F.greatest("tile", "_o"))
        .drop("_o", "_k")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: (node, root) for every node of the edges, root the smallest node it can reach.

    Alternates large-star and small-star steps; each is a min per node and a join, so a hub's edges are pre-aggregated
    and AQE splits its join. Every round is written to the shared folder. Ends as soon as the edges are stars (none where
    they are from the first), which takes a number of rounds logarithmic in the longest path. Null ends and self-loops are
    ignored.
    """
    pair = lambda u, v: edges_.select(F.col(u).alias("u"), F.col(v).alias("v"))
    edges_ = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges_ = cut(edges_, "edges")
    while not _stars(edges_):
        both = pair("a", "b").unionByName(pair("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges_ = star.distinct()
        least = edges_.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        down = edges_.withColumnRenamed("a", "u").join(least, "u")
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        edges_ = cut(small.where("a <> b").distinct(), "edges")
    return edges_.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges_.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every node that has a smaller one has that alone, and nothing hangs on it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    of = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not of.agg(F.count_if(F.expr("up + down > 1 and up > 0"))).first()[0]


def union_labels(n: int, pairs) -> np.ndarray:
    """Roots (smallest index) of 0..n-1 under an array of index pairs, by hooking and pointer jumping in numpy."""
    root = np.arange(n)
    if not len(pairs):
        return root
    x, y = np.asarray(pairs).T
    while True:
        rx, ry = root[x], root[y]
        open_ = rx != ry
        if not open_.any():
            return root
        x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]

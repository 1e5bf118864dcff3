"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

#: A document's expected copies are whole numbers of 1 / UNIT, so prefix sums are exact.
UNIT = 1 << 24
#: Most copies of a document, as a multiple of its source.
MOST = 3
#: Offsets that are tried for a source, from a random first one on in equal steps.
OFFSETS = 16
#: Hash buckets that number a stratum's documents in parallel.
BUCKETS = 64


#: The columns that mixing adds.
RESULTS = ("size", "source_size", "target", "copies", "taken")


def word_count(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights=(1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size, target) of each source: shares by repeating weights, in code point order with null last.

    A target stops at ``most`` times its source's size; what is over goes to the others by weight until none is above.
    That is the level x at which sum(min(weight * x, most * size)) is the whole: sources sorted by most * size / weight
    reach their cap in this order, so x follows from running sums over the table of sources (one row a source).
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_w", turn.cast("double")).withColumn("_cap", (most * F.col("source_size")).cast("double"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = F.try_divide(
        F.sum("source_size").over(Window.partitionBy()).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        F.sum("_w").over(rest),
    )
    # the first source in this order whose share at its level is within its cap
    per = per.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), level.alias("x"))))
    per = per.withColumn("_level", F.min("_level").over(Window.partitionBy())["x"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("_w"))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 17, weights=(1, 2, 3), most: int = MOST) -> DataFrame:
    """docs plus size, source_size, target, copies and taken (words taken, repeats counted).

    Systematic sampling: a document of source s is expected target_s / source_size_s times. The expected copies are
    summed along the source, one random offset (a hash of seed and source) is added, and a document is emitted once for
    each whole number its step crosses. Along the source documents are ordered by strata of nearly equal size. One long
    document more or less can still move a small source, so of OFFSETS equally spaced offsets after the random one that
    is used which brings the words taken nearest to the target. Numbering is a prefix sum in two levels: counts by
    (source, stratum, bucket), then row numbers within one bucket; a source with a third of all rows spreads over all
    its strata and buckets.

    Null or empty texts have size 0 and count as documents, so they may be emitted but take 0 words. Very long texts are
    counted whole. Repeated rows and equal doc_ids are numbered row by row (equal rows in any order). A null source is a
    source of its own, last in order. Empty input: no rows. Columns of docs are kept, but for those that are named like
    one that is added.
    """
    kept = [c for c in docs.columns if c not in RESULTS]
    stratum, bucket, at, cell = fresh(docs, "stratum", "bucket", "at", "cell")
    sized = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("size", word_count(F.col("text")))
    sized = sized.withColumn(stratum, F.floor(16 * F.log2(F.col("size") + 1)).cast("int"))  # 16 to an octave of size
    sized = sized.withColumn(bucket, F.pmod(F.xxhash64("doc_id", F.col("text"), F.lit(seed)), F.lit(BUCKETS)).cast("int"))
    cells = cut(sized.groupBy("source", F.col(stratum).alias("stratum"), F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "cells")
    targets = source_targets(cells, weights, most).withColumnRenamed("source", "of")
    along = Window.partitionBy("source").orderBy("stratum", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    cells = cells.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    step = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size")) * UNIT), F.lit(0)).cast("decimal(20,0)")
    cells = cells.withColumn("step", step).withColumn("first", F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\0"))), F.lit(UNIT)))
    crossed = lambda k, offset: F.floor((k.cast("decimal(18,0)") * F.col("step") + offset.cast("decimal(38,0)")) / F.lit(UNIT).cast("decimal(10,0)")).cast("bigint")
    offset = lambda n: F.pmod(F.col("first") + n * F.lit(UNIT // OFFSETS), F.lit(UNIT))
    # a cell's documents are of nearly one size, so the table of cells tells what each offset takes
    took = [F.sum((crossed(F.col("before") + F.col("n"), offset(n)) - crossed(F.col("before"), offset(n))) * F.col("size") / F.col("n")).alias(f"t{n}") for n in map(F.lit, range(OFFSETS))]
    tried = cells.groupBy(F.col("source").alias("of")).agg(*[t.alias(f"t{n}") for n, t in enumerate(took)], F.first("target").alias("target"))
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{n}") - F.col("target")).alias("off"), F.lit(n).alias("n")) for n in range(OFFSETS)]))["n"]
    cells = cells.join(tried.select("of", best.alias("tried")), F.col("source").eqNullSafe(F.col("of")))
    cells = cells.select(F.struct(F.struct("source", "stratum", "bucket").alias("key"), "before", "step", "target", "source_size", offset(F.col("tried")).alias("offset")).alias(cell))
    inner = Window.partitionBy("source", stratum, bucket).orderBy("doc_id", F.xxhash64("text"))
    out = sized.withColumn(at, F.row_number().over(inner) - 1)
    key = F.col(f"{cell}.key")
    out = out.join(cells, F.col("source").eqNullSafe(key["source"]) & (F.col(stratum) == key["stratum"]) & (F.col(bucket) == key["bucket"]))
    own = lambda name: F.col(f"{cell}.{name}")
    edge = lambda k: F.floor((k.cast("decimal(18,0)") * own("step") + own("offset").cast("decimal(38,0)")) / F.lit(UNIT).cast("decimal(10,0)")).cast("bigint")
    k = own("before") + F.col(at)
    copies = F.least(edge(k + 1) - edge(k), F.lit(most))
    added = [F.col("size"), own("source_size").alias("source_size"), own("target").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken")]
    return out.select(*[F.col(f"`{c}`") for c in kept], *added)


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))

"""How filters interact: survivors of every subset of filters, from truth-table words and carry-save positional popcounts."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most filters whose subsets fit a word.
MOST = 5
#: Words whose bits are counted at once.
AT_ONCE = 1 << 16

_BLANKS = "\t\n\x0b\x0c\r"


def survival_words(failed: np.ndarray, filters: int = MOST) -> np.ndarray:
    """Truth tables as unsigned 32-bit words: bit s is 1 if a document with these failures (bit i: filter i) passes every
    filter of subset s."""
    subsets = np.arange(1 << filters, dtype=np.uint32)
    table = np.array([sum(1 << int(s) for s in subsets if not s & f) for f in range(1 << filters)], np.uint32)
    return table[failed]


def positional_popcounts(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each of 32 bit positions, how often it is set, words counted ``times`` often.

    Carry-save: three words of one weight become their exclusive or at that weight and their majority at twice the weight,
    so only the one or two words that stay at a weight are taken apart. A word that counts n times enters at the weights of
    n's binary digits.
    """
    waiting = {w: words[times >> w & 1 == 1] for w in range(int(times.max(initial=0)).bit_length())}
    counts, weight = np.zeros(32, np.int64), 0
    while weight in waiting or any(w > weight for w in waiting):
        own = waiting.pop(weight, words[:0])
        while len(own) > 2:
            n = len(own) // 3
            a, b, c = own[:n], own[n : 2 * n], own[2 * n : 3 * n]
            odd = a ^ b
            carry = (a & b) | (odd & c)
            waiting[weight + 1] = np.concatenate([waiting.get(weight + 1, words[:0]), carry])
            own = np.concatenate([odd ^ c, own[3 * n :]])
        bits = own[:, None] >> np.arange(32, dtype=np.uint32) & np.uint32(1)
        counts += bits.sum(axis=0, dtype=np.int64) << weight
        weight += 1
    return counts


def with_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, failed): bits 0 to 3 of ``failed`` are set where A to D fail, each a condition on the whole
    text. Texts are told apart by their SHA-256; null and empty texts are one."""
    text = F.coalesce("text", F.lit(""))
    blank = F.translate(text, _BLANKS, " " * len(_BLANKS))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(blank, " "), "").alias("words"))
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    upper = F.char_length("text") - F.char_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    conditions = [words < 100, 100 * distinct < 80 * words, 100 * upper > 10 * F.char_length("text"), F.col("text").rlike("[#$%&*|]")]
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _bits(conditions).alias("failed"))


def _bits(conditions: list[Column]) -> Column:
    out = F.lit(0)
    for i, c in enumerate(conditions):
        out = out.bitwiseOR(F.when(c, F.lit(1 << i)).otherwise(F.lit(0)))
    return out


def with_copies(rows: DataFrame, bit: int = 4) -> DataFrame:
    """Rows (doc_id, part, digest, failed, good, toxic, n), one for each document and what else is kept, summed to (part,
    failed, good, toxic, n), with ``bit`` of failed set for documents whose digest a smaller doc_id has, in any part. Null
    doc_ids are smaller than none and none is smaller than they; rows of one doc_id are not smaller than each other.

    Copies of a text are summed map-side, with the smallest doc_id and the rows that have it. Only those sums, at most one for
    each part and label of a text, meet by text.
    """
    kind = ["digest", "part", "failed", "good", "toxic"]
    sums = rows.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("n_null"))
    both = sums.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    passing = F.coalesce("n_null", F.lit(0)) + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0))
    halves = F.explode(F.array(F.struct(F.col("failed"), passing.alias("n")), F.struct(F.col("failed").bitwiseOR(F.lit(1 << bit)).alias("failed"), (F.col("n") - passing).alias("n"))))
    return both.select("part", "good", "toxic", halves.alias("h")).select("part", "h.failed", "good", "toxic", "h.n").where("n > 0")


def survivors(rows: DataFrame, filters: int = MOST) -> DataFrame:
    """(part, subset, survivors, good, toxic) for each part and subset of filters: documents that pass all of the subset,
    and those of them that are labelled good or toxic.

    Rows are (part, failed, good, toxic, n). Each task turns its rows into survival words and counts their bits by part and
    label; what leaves it is a row for each part, label and subset, whatever the number of documents.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                some = batch.iloc[at : at + AT_ONCE]
                for (part, good, toxic), own in some.groupby(["part", "good", "toxic"], sort=False):
                    got = positional_popcounts(survival_words(own["failed"].to_numpy(), filters), own["n"].to_numpy(np.int64))
                    yield pd.DataFrame({"part": part, "subset": np.arange(1 << filters, dtype=np.int32), "n": got[: 1 << filters], "good": got[: 1 << filters] * good, "toxic": got[: 1 << filters] * toxic})

    counted = rows.mapInPandas(count, "part string, subset int, n bigint, good bigint, toxic bigint")
    return counted.groupBy("part", "subset").agg(F.sum("n").alias("survivors"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def orders(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """The audit of every order of filters from the survivors of every subset: (part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley).

    A filter at a step removes what survives those before it and not those up to it. Its Shapley value sums that over all
    orders: a subset of k others stands before it in k! (m - 1 - k)! of them. Work is a row a part.
    """
    m, whole = len(names), (1 << len(names)) - 1
    sums = ("survivors", "good", "toxic")
    table = counts.groupBy("part").agg(*[
        F.array_sort(F.collect_list(F.struct("subset", c))).getField(c).alias(c) for c in sums])
    steps = []
    for order in itertools.permutations(range(m)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(names[i] for i in order), step, f, before, before | 1 << f))
            before |= 1 << f
    letters, number, f, before, after = (np.array(x) for x in zip(*steps))
    one, others = 1 << f, np.array([[s for s in range(whole + 1) if not s >> i & 1] for i in range(m)])
    times = np.array([math.factorial(k) * math.factorial(m - 1 - k) for k in range(m)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, *arrays in zip(batch["part"], *[batch[c] for c in sums]):
                n, good, toxic = (np.asarray(x, np.int64) for x in arrays)
                removed = n[before] - n[after]
                weight = times[np.array([[bin(s).count("1") for s in row] for row in others])]
                shapley = ((n[others] - n[others | (1 << np.arange(m))[:, None]]) * weight).sum(axis=1)
                yield pd.DataFrame({
                    "part": part, "filter_order": letters, "step": number, "kept": n[after], "removed": removed, "redundant": n[0] - n[one] - removed,
                    "unique_fails": n[whole ^ one] - n[whole], "good_lost": good[before] - good[after], "toxic_lost": toxic[before] - toxic[after], "shapley": shapley[f]})

    return table.mapInPandas(run, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`orders` of five filters on whole texts, in each lang (null: empty string).

    A: under 100 words; B: distinct words under four fifths of the words (of none: passes); C: over a tenth of the characters
    are A to Z; D: holds one of # $ % & * |; E: a smaller doc_id has the same text anywhere in the table. Null texts are empty.
    Documents of no label, or a null one, are neither good nor toxic; of several labels of an id each that is 1 counts.
    Repeated rows are documents each. Other columns are left out. No documents: no rows.
    """
    rows = with_failures(docs).groupBy("doc_id", "part", "digest", "failed").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_doc_id")).agg(
        F.max(F.col("quality").eqNullSafe(1).cast("int")).alias("good"), F.max(F.col("toxic").eqNullSafe(1).cast("int")).alias("toxic"))
    rows = rows.join(marks, F.col("doc_id") == F.col("_doc_id"), "left").drop("_doc_id")
    return orders(survivors(with_copies(rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")}))))

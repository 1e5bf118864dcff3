"""Best-fit packing of token sequences by exact-complement hashing."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, in_slices

#: Tokens of a sequence.
CAPACITY = 2048
#: Least number of hash buckets that number the pieces of one length in parallel, and rows of a bucket where all pieces
#: have one length.
BUCKETS, BUCKET_ROWS = 256, 1 << 15
#: Id after each document.
END = 0


def encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """A function from texts to id arrays. With ranks (the same vocabulary) texts without special strings go through the
    faster of the two public encoders, which gives the same ids; others go through the vocabulary file itself."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    fast = None
    if ranks_path:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if fast is None or any(s in text for s in special):
            return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        # very long runs without a break are slow in the faster encoder
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None,
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then id 0; longer ones are cut into
    pieces of ``capacity`` tokens of which the first may be shorter. Null texts count as empty (one piece: id 0)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(json_path, ranks_path, pattern)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].astype("Int64"), b["text"]):
                ids = np.append(encode(text if isinstance(text, str) else ""), np.uint32(END))
                first = len(ids) % capacity or capacity
                for n, s in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[s : first if n == 0 else s + capacity].astype("<u4")
                    rows.append((doc_id, n, s, len(part), zlib.crc32(part.tobytes()), *((part.astype("i4"),) if with_ids else ())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc_id": "Int64"})

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return in_slices(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema)


class Sums:
    """An index of the sums of one, two and three lengths under availability counts.

    For each sum the pair that can be taken most often is kept with that number. Counts only fall, so a kept number is a
    bound from above: it is worked out anew when the sum is looked up after a count changed. A triple's sum is a single
    length and a pair's, hashed to the rest. Every look-up is a vector operation over at most ``capacity`` lengths.
    """

    def __init__(self, lengths: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for n, c in lengths.items():
            self.left[n] += max(0, c)
        self.left[0], self.changes = 0, 1
        self.pairs, self.most, self.fresh = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
        for s in range(2, capacity + 1):
            self.pair(s)

    def take(self, combo, times: int) -> None:
        for n in combo:
            self.left[n] -= times
        self.changes += 1

    def pair(self, s: int, free: np.ndarray | None = None) -> tuple[int, int]:
        """The smaller length of the pair of sum s that can be taken most often, and how often (0: none). With ``free``
        counts in place of the index's own nothing is kept."""
        if free is None and self.fresh[s] == self.changes:
            return int(self.pairs[s]), int(self.most[s])
        own = self.left if free is None else free
        a = own[1 : s // 2 + 1]
        b = own[s - 1 : s - len(a) - 1 : -1] if len(a) < s - 1 else own[s - 1 : 0 : -1]
        n = np.minimum(a, b)
        if s % 2 == 0 and len(n):
            n[-1] = a[-1] // 2
        at = int(n.argmax()) if len(n) else 0
        found = (at + 1, int(n[at])) if len(n) else (0, 0)
        if free is None:
            self.pairs[s], self.most[s], self.fresh[s] = *found, self.changes
        return found

    def exact(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """Lengths of sum gap beside those in use: one, else the pair, else the triple that can be taken most often."""
        free = self.left
        if used:
            free = free.copy()
            for n, c in used.items():
                free[n] -= c
        if free[gap] > 0:
            return (gap,)
        a, most = self.pair(gap, free)
        if most > 0:
            return a, gap - a
        if gap < 3:
            return None
        one = np.arange(1, gap - 1)
        bound = np.minimum(free[1 : gap - 1], self.most[gap - one])
        while len(bound) and bound.max() > 0:
            x = int(bound.argmax()) + 1
            if (now := min(int(free[x]), self.pair(gap - x)[1])) < bound[x - 1]:  # the kept bound was too high
                bound[x - 1] = now
                continue
            free_x = free.copy()
            free_x[x] -= 1
            a, most = self.pair(gap - x, free_x)
            if most > 0:
                return x, a, gap - x - a
            bound[x - 1] = 0
        return None


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used: all pieces, in few sequences of at most ``capacity``.

    Works on the histogram of lengths (at most ``capacity`` entries, whatever the corpus), each step for as many equal
    sequences as availability counts allow. From the largest length down, a gap is filled exactly from the index of
    single, pair and triple sums (:class:`Sums`), plentiful combinations first. Where no exact filling is left, the
    largest length that fits goes in (best fit) and the rest of the gap is tried again.
    """
    sums = Sums(lengths, capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    while (there := np.flatnonzero(sums.left)).size:
        first = int(there[-1])
        combo, gap = [first], capacity - first
        while gap > 0:
            used = Counter(combo)
            if filling := sums.exact(gap, used):
                combo.extend(filling)
                break
            fits = [int(n) for n in there[: np.searchsorted(there, gap, "right")] if sums.left[n] > used[int(n)]]
            if not fits:
                break
            combo.append(fits[-1])
            gap -= fits[-1]
        counts = Counter(combo)
        times = min(int(sums.left[n]) // c for n, c in counts.items())
        out.append((tuple(combo), times))
        sums.take(combo, times)
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, start, length, ...) plus sequence_id and offset.

    The driver sees the histogram of lengths only. Pieces of one length are numbered in two levels (counts by length and
    bucket, then inside a bucket), so a length that a third of all pieces share spreads out; the number falls into one
    range of the plan, which names sequence and offset. Ranges are joined by (length, block of numbers).
    """
    spark = parts.sparkSession
    bucket, number, low, mine = fresh(parts, "bucket", "number", "before", "ranges")
    hist = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken: Counter = Counter()
    rows, base = [], 0
    for combo, times in plan(hist, capacity):
        at = 0
        for n in combo:
            rows.append((n, taken[n], taken[n] + times, base, at))
            taken[n] += times
            at += n
        base += times
    schema = "length bigint, low bigint, high bigint, base bigint, offset bigint"
    ranges = spark.createDataFrame(rows, schema)
    by_length = ranges.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "base", "offset"))).alias("_ranges"))
    buckets = max(BUCKETS, -(-sum(hist.values()) // BUCKET_ROWS))
    salted = parts.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    cells = salted.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", bucket, F.coalesce(F.sum("_n").over(along), F.lit(0)).alias(low), "_n")
    # the ranges of a length that meet a bucket's numbers; at most capacity for each bucket
    cells = cells.join(by_length, "length").withColumn(
        mine, F.filter("_ranges", lambda r: (r["low"] < F.col(low) + F.col("_n")) & (r["high"] > F.col(low)))).drop("_n", "_ranges")
    inner = Window.partitionBy("length", bucket).orderBy("doc_id", "piece", "ids_crc32")
    placed = salted.withColumn(number, F.row_number().over(inner) - 1).join(cells, ["length", bucket])
    placed = placed.withColumn(number, F.col(low) + F.col(number))
    placed = placed.withColumn(mine, F.filter(mine, lambda r: (r["low"] <= F.col(number)) & (F.col(number) < r["high"]))[0])
    placed = placed.withColumn("sequence_id", F.col(mine)["base"] + F.col(number) - F.col(mine)["low"]).withColumn("offset", F.col(mine)["offset"])
    return placed.select(*[F.col(f"`{c}`") for c in parts.columns], "sequence_id", "offset")


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None,
                   capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of docs.

    Repeated rows are packed each; a null doc_id stays null; null and empty texts are one piece of one token. Texts longer
    than a sequence are cut, the first piece being the shorter one. Other columns are left out. Empty input: no rows.
    """
    return pack(cut(pieces(docs, json_path, ranks_path, pattern, capacity), "pieces"), capacity)


def sequences(packed_with_ids: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token sequences themselves, from pieces that carry ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_with_ids.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))

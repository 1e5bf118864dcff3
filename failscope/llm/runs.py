"""Periodic runs of words by internal pattern matching over a suffix array.

A run of period q and at least four periods holds an aligned block of 2**k words, q <= 2**k < 2q, that occurs again just q
words before or after inside the run; no nearer, since a block of a whole period or more cannot overlap itself more closely.
So the nearest occurrences of every dyadic block in the windows beside it hold each run's period. Periods of one word have
blocks of two, as a run has six words at least.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of texts whose words share a suffix array (one text at least).
SLICE = 1 << 19

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split_words(key: int | None, text: str | None) -> list[str]:
    """Words of a text; null: none. The document's key plays no part."""
    return _WORD.findall(text or "")


def looped_words(key: int | None, text: str | None) -> list[str]:
    """Words of a text; of about each tenth document, told by its key, the tail repeats a few of its words over and over."""
    words = _WORD.findall(text or "")
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


class Levels:
    """Ranks of all stretches of 2**k codes, for k = 0, 1, ..., and the places in their order.

    ``rank[k][i]`` is the first place in ``order`` of those that start with the 2**k codes at i, ``size[k][j]`` the number
    of those that start with block j, the 2**k codes at j * 2**k. Doubling sorts only what is not yet told apart. It ends at ``last``, or where no stretch occurs three times.
    """

    def __init__(self, codes: np.ndarray, last: int):
        n = len(codes)
        self.order = np.argsort(codes, kind="stable").astype(np.int32)
        fresh = np.concatenate([[True], np.diff(codes[self.order]) != 0])
        self.rank, self.size = [], []
        rank, size = np.empty(n, np.int32), np.empty(n, np.int32)
        self._name(np.arange(n), self.order, fresh, rank, size)
        self._keep(rank, size)
        for k in range(last):
            slots = np.flatnonzero(size[self.order] > 1)
            if not len(slots) or size.max() < 3:
                break
            at = self.order[slots]
            after = at.astype(np.int64) + (1 << k)
            key = rank[at].astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            by = np.argsort(key)
            at, key = at[by], key[by]
            self.order[slots] = at
            self._name(slots, at, np.concatenate([[True], np.diff(key) != 0]), rank, size)
            self._keep(rank, size)

    @staticmethod
    def _name(slots, at, fresh, rank, size) -> None:
        first = np.flatnonzero(fresh)
        count = np.diff(np.append(first, len(at)))
        rank[at] = np.repeat(slots[first], count)
        size[at] = np.repeat(count, count)

    def _keep(self, rank, size) -> None:
        self.size.append(size[:: 1 << len(self.rank)].copy())
        self.rank.append(rank.copy())

    def common(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """How many codes after (step 1; from i and j on) or before (step -1) are equal at places i < j."""
        n, got = len(self.order), np.zeros(len(i), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            rank, open_ = self.rank[k], np.arange(len(i))
            while len(open_):
                back = (1 << k) if step < 0 else 0
                a, b = i[open_] + step * got[open_] - back, j[open_] + step * got[open_] - back
                fine = (a >= 0) & (b < n)
                open_ = open_[fine]
                open_ = open_[rank[a[fine]] == rank[b[fine]]]
                got[open_] += 1 << k
                if k < len(self.rank) - 1:
                    break  # the level above has taken all it could, so this one fits once at most
        return got


class WaveletTree:
    """Order statistics of any part of an array of whole numbers, by counts of zeros at each bit from the highest."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, values = [], values.astype(np.int32)
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            count = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=count[1:])
            self.zeros.append(count)
            values = np.concatenate([values[~one], values[one]])

    def smaller(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of the values at places lo to hi - 1, how many are under x."""
        got = np.zeros(len(x), np.int32)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            low, high = zeros[lo], zeros[hi]
            one = (x >> b & 1).astype(bool)
            got += np.where(one, high - low, 0)
            lo, hi = np.where(one, zeros[-1] + lo - low, low), np.where(one, zeros[-1] + hi - high, high)
        return got

    def ranked(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values at places lo to hi - 1."""
        got = np.zeros(len(k), np.int32)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            low, high = zeros[lo], zeros[hi]
            one = k >= high - low
            k = np.where(one, k - (high - low), k)
            got += one.astype(np.int32) << b
            lo, hi = np.where(one, zeros[-1] + lo - low, low), np.where(one, zeros[-1] + hi - high, high)
        return got

    def beside(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Range predecessor and successor of x, which is itself at places lo to hi - 1: (queries that have one, it) each."""
        at = self.smaller(lo, hi, x)
        before, after = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < hi - lo)
        return (before, self.ranked(lo[before], hi[before], at[before] - 1), after, self.ranked(lo[after], hi[after], at[after] + 1))


def candidates(levels: Levels, tree: WaveletTree, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods) that blocks of 2**level codes (level >= 1) give: a place and that one period later hold the same
    block. Only blocks that occur three times or more can lie in a run, and periods of another level are left to it."""
    block, often = 1 << level, np.flatnonzero(levels.size[level] >= 3)
    b = (often * block).astype(np.int32)
    lo = levels.rank[level][b]
    before, left, after, right = tree.beside(lo, lo + levels.size[level][often], b)
    place = np.concatenate([left, b[after]]).astype(np.int64)
    period = np.concatenate([b[before] - left, right - b[after]]).astype(np.int64)
    near = (period <= block) & (2 * period > block if level > 1 else True)
    return place[near], period[near]


def find(codes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period. ``longest`` bounds the length of a run; what must not
    hold a run together, such as the ends of texts, has codes of its own."""
    none = np.zeros(0, np.int64)
    if longest < LEAST_WORDS or len(codes) < LEAST_WORDS:
        return none, none, none
    levels = Levels(codes, max(1, (longest // LEAST_PERIODS - 1).bit_length()))
    tree = WaveletTree(levels.order)
    found = [candidates(levels, tree, k) for k in range(1, len(levels.rank))]
    if not found:
        return none, none, none
    place, period = (np.concatenate(x) for x in zip(*found))
    start = place - levels.common(place, place + period, -1)
    end = place + period + levels.common(place, place + period, 1)
    whole = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, end, period = start[whole], end[whole], period[whole]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.ones(len(by), bool)  # a stretch has one smallest period
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


def scan(texts: list[list[str]]) -> tuple[list[np.ndarray], list[str]]:
    """Runs of each text as rows (start, length, period), and its words without those after a run's first period."""
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1)
    codes = np.full(int(ends[-1]) if len(texts) else 0, -1, np.int64)
    starts = ends - lengths - 1
    for s, t in zip(starts.tolist(), texts):
        codes[s : s + len(t)] = [numbers[w] for w in t]
    codes[ends - 1] = len(numbers) + np.arange(len(texts))  # each text's end is unlike all else
    start, length, period = find(codes, int(lengths.max(initial=0)))
    owner = np.searchsorted(ends, start, "right")
    mark = np.zeros(len(codes) + 1, np.int64)
    np.add.at(mark, start + period, 1)
    np.add.at(mark, start + length, -1)
    gone = np.cumsum(mark)[:-1] > 0
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    rows, kept = [], []
    for d, (s, t) in enumerate(zip(starts.tolist(), texts)):
        own = slice(bounds[d], bounds[d + 1])
        rows.append(np.stack([start[own] - s, length[own], period[own]], axis=1))
        stays = ~gone[s : s + len(t)]
        kept.append(" ".join(t if stays.all() else [w for w, keep in zip(t, stays.tolist()) if keep]))
    return rows, kept


def find_runs(docs: DataFrame, words: Callable[[int | None, str | None], list[str]] = split_words, key: str = "doc_id") -> DataFrame:
    """docs without ``text``, plus ``n_words``, ``runs`` (an array of (start, length, period) by start, then period) and
    ``collapsed``, the words that are left when every run keeps its first period only, joined by a space.

    ``words`` makes the words from a document's key and text. A run is a stretch of words of smallest period q that no
    neighbour extends, of at least LEAST_WORDS words and LEAST_PERIODS periods; runs may overlap, and a word goes if any of
    them drops it. Null and empty texts have no words, no runs and an empty collapsed text. Rows are independent, so repeated
    rows repeat. Whole texts take part, however long: a worker holds about 8 log2(n) bytes a word of its longest text. Columns
    of the names added are replaced, others pass through. No rows: none. One pass, no shuffle.
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kept = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_words bigint", "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            texts = [words(k, t) for k, t in zip(b[key].to_pylist(), b["text"].to_pylist())]
            rows, collapsed = scan(texts)
            flat = np.concatenate(rows)
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(kind.value_type))
            found = pa.ListArray.from_arrays(pa.array(ends), items).cast(kind)
            columns = [b[f.name] for f in kept] + [pa.array([len(t) for t in texts], pa.int64()), found, pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "n_words", "runs", "collapsed"])

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """A row a document of find_runs: the number of runs, the longest (ties: smallest start, then period; nulls where there
    is none) and digests of all runs and of the collapsed text."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best)
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    best = F.aggregate("runs", F.lit(None).cast(kind), better)  # runs come by start, then period
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("_best"),
                       F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("_best.length * 1000 div _best.period")
    return out.select("doc_id", "n_runs", "_best.start", "_best.length", "_best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

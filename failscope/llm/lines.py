"""Fuzzy line deduplication by MinHash.

Signatures and the exact comparison run in numpy inside tasks; Spark splits, shuffles and joins. (The first form, with
DataFrame functions only, could not meet the limits; see the README for its figures.)
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, fresh, in_slices, slices, sorted_groups

#: Characters of a shingle and the least Jaccard similarity of two linked lines.
SHINGLE, SIMILARITY = 8, 0.8
#: Bands of a signature and values of a band: at similarity s a pair shares a band with chance 1 - (1 - s^ROWS)^BANDS,
#: 0.9998 at 0.8.
BANDS, ROWS = 16, 4
#: Characters that are hashed at once (they fit a core's cache).
CHARS = 1 << 16
#: Bits of a line's sketch, and rows and characters of each side of a bucket that a task compares at once.
SKETCH_BITS, SIDE_ROWS, SIDE_CHARS = 4096, 4096, 1 << 22
#: Bits of the filter by which texts are left out before they are shuffled (a fixed size; full, it lets all pass).
FILTER_BITS = 1 << 26
LAST = (1 << 63) - 1
#: Characters of the lines whose shingle sets a worker keeps ready.
HELD_CHARS = 1 << 18
_READY: dict[tuple[str, int], frozenset] = {}

_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_OFFSETS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_BASE = 0x9E3779B97F4A7C15


def _rolled(chars: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of every k characters, put together from hashes of 1, 2, 4, ... characters."""
    out, done, h, span, factor = None, 0, chars, 1, _BASE
    while True:
        if k & span:
            n = len(chars) - done - span + 1
            out = h if out is None else out[:n] * np.uint64(factor) + h[done : done + n]
            done += span
        if span * 2 > k:
            return out[: len(chars) - k + 1]
        n = len(h) - span
        h = h[:n] * np.uint64(factor) + h[span : span + n]
        factor, span = factor * factor % (1 << 64), span * 2


def shingle_hashes(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all k-character shingles of the lines (none empty), and where each line's begin. A shorter line
    is its own shingle, filled up with a character that no text holds."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if lengths.min() < k:
        padded = np.maximum(lengths, k)
        ends = np.cumsum(padded)
        at = np.arange(len(chars)) + np.repeat(ends - padded - np.cumsum(lengths) + lengths, lengths)
        chars, plain, lengths = np.full(int(ends[-1]), 0xFFFFFFFF, np.uint64), chars, padded
        chars[at] = plain
    ends = np.cumsum(lengths)
    with np.errstate(over="ignore"):
        h = _rolled(chars, k)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h >>= np.uint64(32)
    keep = np.ones(len(h), bool)
    keep[(ends[:-1, None] - np.arange(1, k)).ravel()] = False  # those that reach into the next line
    counts = lengths - k + 1
    return h.astype(np.uint32)[keep], np.cumsum(counts) - counts


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys: MinHash values of the shingles, ROWS to a band."""
    h, starts = shingle_hashes(lines)
    keys, drawn = np.zeros((len(lines), BANDS), np.uint64), np.empty_like(h)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            keys[:, b] = b + 1
            for r in range(b * ROWS, (b + 1) * ROWS):
                np.multiply(h, _FACTORS[r], out=drawn)
                np.add(drawn, _OFFSETS[r], out=drawn)
                keys[:, b] = (keys[:, b] ^ np.minimum.reduceat(drawn, starts)) * np.uint64(_BASE)
                keys[:, b] ^= keys[:, b] >> np.uint64(29)
    return keys.view(np.int64)


def sketches(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each line, with repeats, and (lines, SKETCH_BITS / 64) words: the bits of its shingles' hashes."""
    counts, words = np.zeros(len(lines), np.int64), np.zeros((len(lines), SKETCH_BITS // 64), np.uint64)
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and end - at < 256 and (size < CHARS or end == at):
            size += len(lines[end])
            end += 1
        h, starts = shingle_hashes(lines[at:end])
        counts[at:end] = np.diff(starts, append=len(h))
        bits = np.zeros((end - at, SKETCH_BITS), np.uint8)
        bits[np.repeat(np.arange(end - at), counts[at:end]), h % np.uint32(SKETCH_BITS)] = 1
        words[at:end] = np.packbits(bits, axis=1).view(np.uint64)
        at = end
    return counts, words


def split_lines(batch: pd.DataFrame) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Parts of about CHARS characters: document (null: LAST), number from 0 and stripped line of every line that is not
    blank. Lines are compared without spaces, tabs and carriage returns at their ends."""
    docs, numbers, lines, size = [], [], [], 0
    for doc, text in zip(batch["doc_id"].astype("Int64").fillna(LAST).tolist(), batch["text"]):
        if not isinstance(text, str):
            continue
        for n, line in enumerate(text.split("\n")):
            if line := line.strip(" \t\r"):
                docs.append(doc)
                numbers.append(n)
                lines.append(line)
                size += len(line)
        if size >= CHARS:
            yield docs, numbers, lines
            docs, numbers, lines, size = [], [], [], 0
    if lines:
        yield docs, numbers, lines


def line_keys(lines: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in lines], np.uint64).view(np.int64)


def line_checks(lines: list[str]) -> np.ndarray:
    """Second hashes, by which unlike lines of one key are told apart."""
    return np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in lines], np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """(node, doc, line, check, bands) of every line that is not blank; of equal lines that stand close, the first place alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for doc, line, texts in split_lines(b.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)):
                first: dict[str, int] = {}
                for i in sorted(range(len(texts)), key=lambda i: (doc[i], line[i])):
                    first.setdefault(texts[i], i)
                own, at = list(first), list(first.values())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(own).ravel()))
                columns = [pa.array(line_keys(own)), pa.array([doc[i] for i in at], pa.int64()), pa.array([line[i] for i in at], pa.int32()), pa.array(line_checks(own)), bands]
                yield pa.RecordBatch.from_arrays(columns, ["node", "doc", "line", "check", "bands"])

    return docs.mapInArrow(run, "node bigint, doc bigint, line int, check bigint, bands array<bigint>")


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text_hash, line_no, node, check) of every line; node is null where it is blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            doc, hashes, number, node, check = [], [], [], [], []
            for d, h, text in zip(b["doc_id"].astype("Int64").fillna(LAST).tolist(), b["text_hash"].tolist(), b["text"]):
                if isinstance(text, str):
                    own = [t.strip(" \t\r") for t in text.split("\n")]
                    doc += [d] * len(own)
                    hashes += [h] * len(own)
                    number += range(len(own))
                    node += [int(k) if t else None for t, k in zip(own, line_keys(own))]
                    check += line_checks(own).tolist()
            yield pd.DataFrame({"doc": doc, "text_hash": hashes, "line_no": number, "node": pd.array(node, "Int64"), "check": check})

    out = in_slices(docs.withColumn("text_hash", F.xxhash64("text")), run, "doc bigint, text_hash bigint, line_no int, node bigint, check bigint")
    return out.select(F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id"), "doc", "text_hash", "line_no", "node", "check")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted (node, place). Lines that cannot be wanted are dropped before the shuffle by a filter of
    a fixed number of bits, which is all that comes to the driver."""
    bit = F.pmod(F.col("node"), F.lit(FILTER_BITS))
    bits = wanted.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(node, 64) as int))")).alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for b in batches:
            for doc, line, texts in split_lines(b):
                node = line_keys(texts)
                at = node % FILTER_BITS
                hit = (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                yield pd.DataFrame({"node": node, "doc": doc, "line": line, "text": texts})[hit]

    found = in_slices(docs, run, "node bigint, doc bigint, line int, text string")
    place = F.struct(F.col("doc"), F.col("line"))
    found = found.select("node", place.alias("place"), "text").join(wanted, ["node", "place"])
    return found.select("node", "text").dropDuplicates(["node"])


def similar(a: str, b: str, similarity: float, k: int = SHINGLE) -> bool:
    """Whether the shingle sets have at least this Jaccard similarity, exactly."""
    x, y = _shingles(a, k), _shingles(b, k)
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    common = len(x & y)
    return common >= similarity * (len(x) + len(y) - common)


def _shingles(text: str, k: int) -> frozenset:
    """The shingle set of a line. Lines met lately are kept ready, of HELD_CHARS characters together at most."""
    got = _READY.get((text, k))
    if got is None:
        got = frozenset(text[i : i + k] for i in range(len(text) - k + 1)) or frozenset((text,))
        if sum(len(t) for t, _ in _READY) + len(text) > HELD_CHARS:
            _READY.clear()
        _READY[text, k] = got
    return got


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes that are similar: sketches rule out most others before the exact comparison."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x, y = p["ta"].tolist(), p["tb"].tolist()
            code, own = pd.factorize(pd.concat([p["a"], p["b"]]))
            texts = dict(zip(code.tolist(), x + y))
            counts, words = sketches([texts[k] for k in range(len(own))])
            c, d = code[: len(p)], code[len(p) :]
            keep = may_be_similar(words[c], counts[c], words[d], counts[d], similarity)
            for i in np.flatnonzero(keep):
                keep[i] = similar(x[i], y[i], similarity)
            yield p.loc[keep, ["a", "b"]]

    return both.mapInPandas(run, "a bigint, b bigint")


def may_be_similar(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, similarity: float) -> np.ndarray:
    """False only for sketches x and y (rows, or one row and many) whose shingle sets cannot have this Jaccard similarity.

    Every differing bit is a shingle that one set lacks, and sets of similarity s differ in at most (1 - s) / (1 + s) of
    their summed sizes, which are at most nx + ny; so no similar pair is lost.
    """
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= ((1 - similarity) / (1 + similarity) + 1e-9) * (nx + ny)


def joining_links(xs: np.ndarray, ys: np.ndarray, label: np.ndarray, texts: list[str], sketch: np.ndarray, counts: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Similar pairs (of xs, of ys) that join the components named by label, as few as join all that any such pair does."""
    out = []
    for i in xs:
        near = ys[label[ys] != label[i]]
        for j in near[may_be_similar(sketch[i], counts[i], sketch[near], counts[near], similarity)]:
            if label[i] != label[j] and similar(texts[i], texts[j], similarity):
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _open_links(open_: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the components within each band's bucket: as many as a tile has components, not pairs.

    open_ holds (band, node, root, largest, text). Rows outside the largest component meet all rows, in tasks of about
    SIDE_ROWS by SIDE_ROWS or SIDE_CHARS by SIDE_CHARS: each side is dealt into tiles, and a row is sent once to every
    tile of the other side (in a bucket of one tile, once at all).
    """
    outside, length = F.col("root") != F.col("largest"), F.length("text")
    sizes = open_.groupBy("band").agg(F.count_if(outside).alias("l"), F.sum(F.when(outside, length)).alias("lc"), F.count(F.lit(1)).alias("r"), F.sum(length).alias("rc"))
    sizes = sizes.select("band", *[F.ceil(F.greatest(F.col(c) / SIDE_ROWS, F.col(f"{c}c") / SIDE_CHARS)).cast("int").alias(f"k{c}") for c in "lr"])
    dealt = open_.join(sizes, "band")
    tiles = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    own = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    columns = ["band", "tl", "tr", "side", "node", "root", "largest", "text"]
    left = dealt.where(outside & (F.col("kr") > 1)).withColumn("side", F.lit(0)).withColumn("tl", own("kl")).withColumn("tr", tiles("kr"))
    right = dealt.withColumn("side", F.lit(1)).withColumn("tr", own("kr")).withColumn("tl", tiles("kl"))
    rows = left.select(columns).unionByName(right.select(columns)).repartition("band", "tl", "tr").sortWithinPartitions("band", "tl", "tr")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sorted_groups(batches, ["band", "tl", "tr"]):
            band, tl, tr, side, node, root, largest = (part[c].to_numpy() for c in columns[:-1])
            texts = part["text"].tolist()
            counts, words = sketches(texts)
            starts = np.flatnonzero((np.diff(band) != 0) | (np.diff(tl) != 0) | (np.diff(tr) != 0)) + 1
            a, b = [], []
            for lo, hi in zip([0, *starts], [*starts, len(part)]):
                own, mine = slice(lo, hi), side[lo:hi]
                ys = np.flatnonzero(mine == 1)
                xs = np.flatnonzero(mine == 0) if len(ys) < hi - lo else np.flatnonzero(root[own] != largest[own])
                for i, j in joining_links(xs, ys, root[own].copy(), texts[own], words[own], counts[own], similarity):
                    a.append(node[lo + i])
                    b.append(node[lo + j])
            if a:
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.mapInPandas(run, "a bigint, b bigint").distinct()


def line_components(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, line_no, blank, component_doc, component_line, kept) of every line of docs.

    Lines are compared without blanks at their ends. Equal lines are one class (by a 64-bit hash; an unlike line of
    the same hash, told by a second one, stays alone and is kept) with its first place, the smallest (doc_id, line_no). Classes that share a band are candidates; a shared band links nothing by itself: the
    shingle sets are compared exactly. Of a bucket, every class is compared with the bucket's first; where that leaves
    several components in a bucket, all classes outside its largest component are compared with all that are not in
    theirs, first by sketches that rule out no similar pair, save pairs that other links have joined by then. So no link is
    lost between components, and a bucket of copies costs its size, not its square. Then union-find
    over the links keeps the first place of each component.

    Blank lines are kept and stand alone (component null), null texts have no line, an empty text has one blank line.
    A null doc_id counts as the last. Repeated rows: equal places share ``kept``. Very long texts go line by line, so only a
    line has to fit into memory. Ties in a component go to the first place. Empty input: no rows.
    """
    return _components(docs, similarity).drop("doc", "text_hash")


def _components(docs: DataFrame, similarity: float) -> DataFrame:
    """Those of :func:`line_components`, with doc (null: LAST) and the text's hash."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    signed = _signed(docs).select("node", F.struct("doc", "line", "check", "bands").alias("first"))
    signed = signed.groupBy("node").agg(F.min("first").alias("first"))
    classes = cut(signed.select("node", F.struct("first.doc", "first.line").alias("place"), "first.check", "first.bands"), "lines")

    in_band = classes.select("node", F.explode("bands").alias("band"))
    buckets = in_band.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1")
    live = cut(in_band.join(buckets, "band").select("band", "node", "n", "first"), "buckets")
    star = live.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    star = cut(star, "pairs")
    wanted = live.select("node").distinct().join(classes.select("node", "place"), "node")
    texts = cut(_texts(docs, wanted), "texts")
    links = cut(_similar(star, texts, similarity), "links")
    first = components(links)

    # buckets of several components
    named = live.where("n > 2").join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named.select("band", "node", "root", "first"), "named")
    of = named.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m"))
    top = of.groupBy("band").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("m", "root")).alias("top")).where("roots > 1")
    open_ = named.join(top.select("band", F.col("top.root").alias("largest")), "band")
    open_ = cut(open_.select("band", "node", "root", "largest"), "open")
    more = _open_links(open_.join(texts, "node"), similarity)
    links = cut(links.unionByName(more), "links")
    comp = components(links)
    firsts = comp.join(classes.select("node", "place"), "node")
    kept = firsts.groupBy("root").agg(F.min("place").alias("keeper"))
    keeper = classes.select("node", "place", "check").join(firsts.select("node", "root").join(kept, "root").select("node", "keeper"), "node", "left")
    keeper = keeper.select("node", F.struct(F.coalesce("keeper", "place").alias("at"), "check").alias("of"))
    numbered = cut(_numbered(docs), "numbered")
    # lines of more than a thousandth of all places (so at most a thousand) are joined by broadcast, and spread out
    often = numbered.groupBy("node").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(numbered.agg(F.count(F.lit(1)).alias("all"))))
    often = keeper.join(F.broadcast(often.where("node is not null and n * 1000 > all").select("node")), "node").withColumnRenamed("of", "hot")
    own = F.when(F.col("node").isNull() | F.col("hot").isNotNull(), F.xxhash64("doc", "line_no")).otherwise(F.col("node"))
    out = numbered.join(F.broadcast(often), "node", "left").withColumn("own", own)
    out = out.join(keeper.withColumnRenamed("node", "own"), "own", "left").withColumn("of", F.coalesce("hot", "of")).withColumn("blank", F.col("node").isNull())
    alone = F.struct(F.col("doc"), F.col("line_no").alias("line"))
    at = F.when(~F.col("blank"), F.when(F.col("of.check") == F.col("check"), F.col("of.at")).otherwise(alone))
    out = out.withColumn("keeper", at)
    mine = (F.col("keeper.doc") == F.col("doc")) & (F.col("keeper.line") == F.col("line_no"))
    named_doc = F.when(F.col("keeper.doc") < LAST, F.col("keeper.doc"))
    return out.select("doc_id", "doc", "text_hash", "line_no", "blank", named_doc.alias("component_doc"), F.col("keeper.line").alias("component_line"), (F.col("blank") | mine).alias("kept"))


def drop_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with only the kept lines of each text, in order; n_chars, where there is one, is counted anew.

    Every row stays, as does a null text. Only the numbers of dropped lines are joined back, by doc_id and the text's hash:
    rows of one doc_id with different texts lose their own lines alone, and rows of a null doc_id, which come last, lose
    theirs like any other. Equal lines at one place (doc_id, number) share ``kept``, so all of them stay or go. Other
    columns stay as they are, whatever their names. Empty input: no rows.
    """
    i, t, g = fresh(docs, "_id", "_th", "_gone")
    gone = _components(docs, similarity).where("not kept").groupBy(F.col("doc").alias(i), F.col("text_hash").alias(t)).agg(F.collect_set("line_no").alias(g))
    own = (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)) == F.col(i)) & (F.xxhash64("text") == F.col(t))
    out = docs.join(gone, own, "left")
    left = F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains(g, at))
    out = out.withColumn("text", F.when(F.col(g).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(g).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, fresh, in_slices, sorted_groups, union_labels, width

#: Largest number of fingerprints on a side of a tile pair.
TILE = 8192
#: Rows that are compared with the other side at once.
ROWS = 64
#: Of 128 bits, those in which two sets may differ to be compared exactly. At a Jaccard similarity of 0.8 sets differ in
#: 128 * acos(1.6 / 1.8) / pi = 19 on average (24 for sets of 4 and 5), with a deviation of 4; unrelated ones in 64.
WIDE_RADIUS = 38
#: Largest number of sets on a side of a tile pair where sizes leave out most pairs.
WIDE_TILE = 1 << 15
#: Bits of a set's sketch, each the parity of the hashes that fall to it.
PARITIES = 1024
LAST = (1 << 63) - 1


def shingles(text: str | None, k: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every k words, repeats included; fewer words are one shingle, none are none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts, n, digest = [0, *ends], max(1, len(words) - k + 1), xxhash.xxh64_intdigest
    last = min(k, len(words)) - 1
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts[:n], ends[last:])], dtype="<u8")


def _majority(h: np.ndarray) -> int:
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """64 bits, each 1 if set in over half the XXH64 of the k-word shingles, repeats included; no words: 0."""
    h = shingles(text, k, seed)
    return _majority(h) if len(h) else 0


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp bigint) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t if isinstance(t, str) else None, k, seed) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_hash": b["text_hash"], "fp": fp.view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")
    return in_slices(rows, run, "doc_id bigint, text_hash bigint, fp bigint")


def _segments(fp: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of equal parts of each fingerprint; their L1 distance is never over the Hamming distance."""
    return np.bitwise_count(fp.view(f"<u{8 // parts}").reshape(-1, parts)).astype(np.int16)


def linked(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """Pairs (i, j) over the rows of a then b that join whatever is linked by at most radius differing bits.

    Exact exclusive-or and bit counts of all of a against all of b, but for parts whose population counts by quarter
    differ by more than the radius in sum. Links inside what is joined already are left out, so the pairs are fewer than
    the rows. same: b is a.
    """
    n = len(a)
    total = n if same else n + len(b)
    root, out = np.arange(total), []
    cells = []
    for side in (a, b):
        seg = _segments(side, 4)
        order = np.lexsort(seg.T)
        seg = seg[order]
        cut_at = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]).any(axis=1)]) if len(seg) else np.array([], int)
        cells.append((order, seg[cut_at], cut_at, np.r_[cut_at[1:], len(seg)]))
    (oa, sa, fa, ta), (ob, sb, fb, tb) = cells
    for c in range(len(sa)):
        near = np.flatnonzero(np.abs(sb - sa[c]).sum(axis=1) <= radius)
        if same:
            near = near[near >= c]
        if not len(near):
            continue
        cols = np.concatenate([ob[f:t] for f, t in zip(fb[near], tb[near])])
        right = b[cols]
        for s in range(fa[c], ta[c], ROWS):
            rows = oa[s : min(s + ROWS, ta[c])]
            i, j = np.nonzero(np.bitwise_count(a[rows][:, None] ^ right[None, :]) <= radius)
            i, j = rows[i], cols[j] + (0 if same else n)
            ri, rj = root[i], root[j]
            open_ = ri != rj
            if open_.any():
                pairs = np.unique(np.stack([ri[open_], rj[open_]], axis=1), axis=0)
                out.append(pairs)
                root = union_labels(total, pairs)[root]
    if not out:
        return np.empty((0, 2), int)
    member = np.flatnonzero(root != np.arange(total))
    return np.stack([member, root[member]], axis=1)


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that join all those within radius bits of each other.

    A tile holds fingerprints with the same population counts of both halves, split by hash where it has more than
    ``tile``. Tiles whose counts differ by more than the radius in sum cannot hold a link and are never paired. Their
    number of keys is at most 33 * 33, so the table of pairs has a fixed bound; a fingerprint is copied to the tiles
    within reach. The work is the square of the number of distinct fingerprints times the share of the pairs left.
    """
    spark = fps.sparkSession
    halves = lambda c: (F.bit_count(F.shiftrightunsigned(c, 32)), F.bit_count(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))))
    hi, lo = halves("fp")
    keyed = fps.select("fp", hi.cast("int").alias("hi"), lo.cast("int").alias("lo"))
    sizes = keyed.groupBy("hi", "lo").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("n"))
    chunks = sizes.select("hi", "lo", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    x, y = chunks.select(*[F.col(c).alias(f"x{c}") for c in ("hi", "lo", "chunk")]), chunks
    reach = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius])
    near = x.withColumn("r", F.explode(reach)).withColumn("hi", F.col("xhi") + F.col("r.i")).withColumn("lo", F.col("xlo") + F.col("r.j"))
    near = near.join(y, ["hi", "lo"]).where(F.struct("xhi", "xlo", "xchunk") <= F.struct("hi", "lo", "chunk"))
    same = F.expr("xhi = hi and xlo = lo and xchunk = chunk")
    near = near.select("xhi", "xlo", "xchunk", "hi", "lo", "chunk", same.alias("same"), F.monotonically_increasing_id().alias("pair"))
    pairs = cut(near, "tiles")  # the ids stay as they are
    left = pairs.select("pair", "same", F.lit(0).alias("side"), F.col("xhi").alias("hi"), F.col("xlo").alias("lo"), F.col("xchunk").alias("chunk"))
    right = pairs.where("not same").select("pair", "same", F.lit(1).alias("side"), "hi", "lo", "chunk")
    keyed = keyed.repartition(2 * width(spark), "fp")  # else few tasks make all the copies
    dealt = keyed.join(sizes, ["hi", "lo"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = dealt.join(left.unionByName(right), ["hi", "lo", "chunk"]).select("pair", "side", "same", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sorted_groups(batches, ["pair"]):
            pair, fp, side = part["pair"].to_numpy(), part["fp"].to_numpy().view(np.uint64), part["side"].to_numpy()
            same = part["same"].to_numpy(dtype=bool)
            at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            for s, t in zip(at, np.r_[at[1:], len(pair)]):
                a = np.ascontiguousarray(fp[s:t][side[s:t] == 0])
                b = a if same[s] else np.ascontiguousarray(fp[s:t][side[s:t] == 1])
                if len(a) and len(b) and len(got := linked(a, b, radius, bool(same[s]))):
                    both = (a if same[s] else np.concatenate([a, b])).view(np.int64)
                    yield pd.DataFrame({"a": both[got[:, 0]], "b": both[got[:, 1]]})

    dealt = dealt.repartition(4 * width(spark), "pair").sortWithinPartitions("pair")
    return dealt.mapInPandas(run, "a bigint, b bigint")


def simhash_components(docs: DataFrame, k: int = 3, seed: int = 42, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, keeper): component_id is the smallest doc_id reachable over fingerprints
    within radius bits; keeper is the (doc_id, text_hash) of the component that is smallest.

    Equal fingerprints are one class, so copies are never paired. Null and empty texts and texts without words have
    fingerprint 0 and link like any other. Rows of a null doc_id keep their row and link, but name no component unless
    no other row is in it (then null). Repeated rows appear as often as they come. Empty input: no rows.
    """
    fps = cut(fingerprints(docs, k, seed), "fingerprints")
    mine = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "text_hash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(mine).alias("keeper"))
    comp = components(links(classes.select("fp"), radius, tile)).withColumnRenamed("node", "fp")
    joined = classes.join(comp, "fp")
    whole = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.min("keeper").alias("keeper"))
    joined = joined.select("fp", "root").join(whole, "root").select("fp", "component_id", "keeper")
    alone = classes.join(comp, "fp", "left_anti").select("fp", F.col("least").alias("component_id"), "keeper")
    return fps.join(joined.unionByName(alone), "fp").select("doc_id", "text_hash", "fp", "component_id", "keeper")


def shingle_set(text: str | None, k: int, seed: int = 42) -> np.ndarray:
    """The distinct shingles in order."""
    return np.unique(shingles(text, k, seed))


def wide_fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles: majorities of the hashes and of the hashes mixed once more."""
    if not len(own):
        return 0, 0
    with np.errstate(over="ignore"):
        h = (own ^ (own >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _majority(own), _majority(h ^ (h >> np.uint64(31)))


def parities(own: np.ndarray) -> bytes:
    """The sketch of a set. Sketches differ in no more bits than the sets have elements of one alone."""
    return np.packbits(np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def near_sets(left: tuple, right: tuple, same: bool, similarity: float, radius: int, joining: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) of other labels whose sizes allow the similarity and whose bits differ in at most radius.

    A side is (sizes, first words, second words, labels, sketches or None), the right one in order of sizes. Sketches rule
    out pairs that cannot have the similarity and no other. joining: only so many pairs as join the labels that all of
    them join. same: left is right, and each pair is given once.
    """
    n, f, g, label, drawn = left
    m, p, q, other, sketch = right
    if joining:  # one numbering of the labels of both sides
        both = np.unique(np.concatenate([label, other]), return_inverse=True)[1]
        label, other = both[: len(n)], both[len(n) :]
        root = np.arange(both.max() + 1) if len(both) else both
    lo = np.searchsorted(m, np.ceil(n * similarity - 1e-6), "left")
    hi = np.searchsorted(m, np.floor(n / similarity + 1e-6), "right")
    lo = np.maximum(lo, np.arange(len(n)) + 1) if same else lo
    a, b = [], []
    for i in np.flatnonzero(lo < hi):
        s, t = lo[i], hi[i]
        hit = s + np.flatnonzero(np.bitwise_count(p[s:t] ^ f[i]) + np.bitwise_count(q[s:t] ^ g[i]) <= radius)
        own, theirs = (root[label[i]], root[other[hit]]) if joining else (label[i], other[hit])
        hit = hit[theirs != own]
        if sketch is not None and len(hit):
            alone = np.bitwise_count(sketch[hit] ^ drawn[i]).sum(axis=1, dtype=np.int64)
            hit = hit[alone <= (1 - similarity) / (1 + similarity) * (n[i] + m[hit]) + 1e-6]
        if joining and len(hit):
            theirs, at = np.unique(root[other[hit]], return_index=True)
            hit = hit[at]
            root[np.isin(root, theirs)] = own
        a.append(np.full(len(hit), i))
        b.append(hit)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, int), np.empty(0, int))


def near_pairs(sets: DataFrame, similarity: float, joining: bool, radius: int = WIDE_RADIUS, tile: int = WIDE_TILE) -> DataFrame:
    """(a, b): pairs of sets (node, n, f, g, label, and sketch where there is one) as in :func:`near_sets`, each within its pair of tiles.

    A tile holds sets of sizes within a factor of the similarity, split by hash where it has more than ``tile``. A set of
    the least similarity is in the same class of sizes or the next, so no other tiles are paired.
    """
    spark = sets.sparkSession
    keyed = sets.withColumn("c", F.floor(F.log(F.col("n")) / float(-np.log(similarity))).cast("int")).where("n > 0")
    sizes = keyed.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("k"))
    chunks = sizes.select("c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("chunk"))
    x = chunks.select(F.col("c").alias("xc"), F.col("chunk").alias("xchunk"), F.explode(F.sequence(F.col("c"), F.col("c") + 2)).alias("c"))
    near = x.join(chunks, "c").where("c > xc or chunk >= xchunk")
    near = cut(near.select("*", F.expr("xc = c and xchunk = chunk").alias("same"), F.monotonically_increasing_id().alias("pair")), "tiles")
    left = near.select("pair", "same", F.lit(0).alias("side"), F.col("xc").alias("c"), F.col("xchunk").alias("chunk"))
    right = near.where("not same").select("pair", "same", F.lit(1).alias("side"), "c", "chunk")
    dealt = keyed.join(F.broadcast(sizes), "c").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = dealt.join(left.unionByName(right), ["c", "chunk"]).select("pair", "side", "same", "node", "n", "f", "g", "label", *[c for c in sets.columns if c == "sketch"])

    def drawn(side: pd.DataFrame) -> np.ndarray | None:
        return np.frombuffer(b"".join(side["sketch"]), np.uint64).reshape(len(side), -1) if "sketch" in side and len(side) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sorted_groups(batches, ["pair"]):
            pair = part["pair"].to_numpy()
            at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            for s, t in zip(at, np.r_[at[1:], len(pair)]):
                own = part.iloc[s:t].sort_values("n", kind="stable")
                same = bool(own["same"].iloc[0])
                sides = [own[own["side"] == i] for i in ((0, 0) if same else (0, 1))]
                x, y = [(d["n"].to_numpy(), d["f"].to_numpy().view(np.uint64), d["g"].to_numpy().view(np.uint64), d["label"].to_numpy(), drawn(d)) for d in sides]
                i, j = near_sets(x, y, same, similarity, radius, joining)
                if len(i):
                    u, v = sides[0]["node"].to_numpy()[i], sides[1]["node"].to_numpy()[j]
                    yield pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v)})

    dealt = dealt.repartition(4 * width(spark), "pair").sortWithinPartitions("pair")
    return dealt.mapInPandas(run, "a bigint, b bigint")


def _alike(pairs: DataFrame, contents: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have at least this Jaccard similarity, exactly."""
    side = lambda c: contents.select(F.col("node").alias(c), F.col("own").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = np.zeros(len(p), bool)
            for i, (x, y) in enumerate(zip(p["sa"], p["sb"])):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = common >= similarity * (len(x) + len(y) - common) - 1e-9
            yield p.loc[keep, ["a", "b"]]

    return both.mapInPandas(run, "a bigint, b bigint")


def _placed(docs: DataFrame) -> DataFrame:
    """text with the place of a row: _id (null last) and _th, the text's hash."""
    return docs.select("text", F.col("doc_id")).withColumn("_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))).withColumn("_th", F.xxhash64("text"))


def _sets(docs: DataFrame, k: int, seed: int, contents: bool) -> DataFrame:
    """(_id, _th, node, n, f, g) of every row, or (node, own, sketch): the hash of its set, size, fingerprint and content."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [shingle_set(t if isinstance(t, str) else None, k, seed) for t in b["text"]]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in own], np.uint64).view(np.int64)
            if contents:
                yield pd.DataFrame({"node": node, "own": [s.tobytes() for s in own], "sketch": [parities(s) for s in own]})
            else:
                fp = np.array([wide_fingerprint(s) for s in own], np.uint64).reshape(-1, 2).view(np.int64)
                yield pd.DataFrame({"_id": b["_id"], "_th": b["_th"], "node": node, "n": [len(s) for s in own], "f": fp[:, 0], "g": fp[:, 1]})

    rows = docs.select("_id", "_th", "text")
    return in_slices(rows, run, "node bigint, own binary, sketch binary" if contents else "_id bigint, _th bigint, node bigint, n bigint, f bigint, g bigint")


def similar_components(docs: DataFrame, k: int, similarity: float, seed: int = 42, radius: int = WIDE_RADIUS, tile: int = WIDE_TILE) -> DataFrame:
    """(keeper, node) for each distinct set of shingles: keeper is the smallest (_id, _th) of its component.

    Two sets are linked by a Jaccard similarity of at least ``similarity``, computed exactly for all pairs within radius
    of 128 bits of SimHash whose sizes and sketches allow it. Sketches are made of the sets that are near any other.
    First only as many pairs are compared as join what may be similar; then all such pairs between the components that
    this left, so a group of near copies costs comparisons by its size, not its square. Rows of an equal set, those without words too, are one.
    """
    placed = _placed(docs)
    place = F.struct("_id", "_th")
    rows = _sets(placed, k, seed, False).groupBy("node").agg(F.min(place).alias("place"), *[F.first(c).alias(c) for c in "nfg"])
    classes = cut(rows, "sets")
    labelled = classes.withColumn("label", F.col("node"))
    near = cut(near_pairs(labelled, similarity, True, radius, tile), "near")  # any set that is near another is in one
    open_ = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    wanted = classes.join(open_, "node").select("place.*")
    own = _sets(placed.join(wanted, ["_id", "_th"], "left_semi"), k, seed, True).dropDuplicates(["node"])
    own = cut(own, "contents")
    labelled = cut(labelled.join(own.select("node", "sketch"), "node").drop("place"), "open")
    pairs = cut(near_pairs(labelled, similarity, True, radius, tile).distinct(), "pairs")
    links = cut(_alike(pairs, own, similarity), "links")
    labelled = labelled.join(components(links), "node", "left").withColumn("label", F.coalesce("root", "node"))
    rest = near_pairs(labelled, similarity, False, radius, tile).distinct().join(pairs, ["a", "b"], "left_anti")
    more = _alike(cut(rest, "pairs"), own, similarity)
    comp = components(links.unionByName(more))
    named = classes.join(comp, "node", "left").select("node", "place", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("place").alias("keeper"))
    return named.join(least, "root").select("node", "keeper")


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    i, t = fresh(docs, "_id", "_th")
    placed = docs.withColumn(i, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))).withColumn(t, F.xxhash64("text"))
    kept = kept.select(F.col("_id").alias(i), F.col("_th").alias(t))
    return placed.join(kept, [i, t], "left_semi").dropDuplicates([i, t]).drop(i, t)


def keep_one_similar(docs: DataFrame, k: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """Like :func:`keep_one` for the components of :func:`similar_components`."""
    return _only(docs, similar_components(docs, k, similarity, seed).select("keeper.*").distinct())


def keep_one(docs: DataFrame, k: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id, then text hash; of equal rows any one.

    A null doc_id comes last; null and empty texts are like texts without words. Columns of docs are kept as they are,
    whatever their names. Empty input: no rows.
    """
    kept = simhash_components(docs, k, seed, radius).select("keeper.*").distinct()
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"))
    return _only(docs, kept)

"""Toxicity by a convolutional text classifier, trained in numpy."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

#: Rows of a shard on average, and most shards (each learns on its own in a round; then their steps are averaged).
SHARD_ROWS, SHARDS = 6000, 64
#: Passes over all rows where one shard holds them, and where there are several.
PASSES, SHARED_PASSES = 6, 3
#: Rows of a mini-batch, and values of a block in which models are averaged.
BATCH, BLOCK = 32, 1 << 14
#: Steps between 0 and 1 in which scores are counted for thresholds.
SCORE_STEPS = 20_000
#: Bits of the filter by which documents without a label are left out before they are read (a fixed size; full, it lets all pass).
FILTER_BITS = 1 << 26
#: Parts of the rows that are scored by a model of the other parts, and toxic rows of a language at which its own threshold
#: counts as much as that over all languages.
PARTS, PRIOR = 3, 20
#: Buckets of hashed words, size of their embeddings, filters of each width, widths.
WORDS, DIM, FILTERS, WIDTHS = 1 << 16, 6, 6, (1, 2, 3)
#: A document is toxic at this score or above.
CUT = 0.3
#: Words that a worker remembers, and words that go through the filters at once.
REMEMBERED, AT_ONCE = 50_000, 1 << 15

# Frequent short words by which a text's language is told from the text alone.
LANGUAGE_WORDS = {
    "en": "the and of to in is that for with as was on are it he be by at this have".split(),
    "de": "der die und das ist nicht ein zu den mit sich auf für im dem des sie es auch".split(),
    "fr": "le la les de des et un une du que qui dans est pour par pas au ce elle il".split(),
    "es": "el la los las de y que en un una por con para es se del al lo como su".split(),
}
_WORD = re.compile(r"\w+")
_LANGUAGE_SETS = [set(w) for w in LANGUAGE_WORDS.values()]


def words(text: str | None) -> list[str]:
    """Words of the whole text in lower case; null: none."""
    return _WORD.findall((text or "").lower())


def buckets(word: str) -> tuple[int, int]:
    """Buckets of the word and of its first four letters; a word's embedding is the sum of both."""
    raw = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) % WORDS, zlib.crc32(b"^" + word[:4].encode("utf-8", "surrogatepass")) % WORDS


class Vocabulary:
    """Numbers for words, with the buckets and the language marks of each; forgets all when it has grown too large."""

    def __init__(self, most: int = REMEMBERED):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.pairs, self.marks = np.zeros((1024, 2), np.int32), np.zeros((1024, len(LANGUAGE_WORDS)), np.uint8)

    def read(self, tokens: list[str]) -> tuple[np.ndarray, int]:
        """(words, 2) buckets of a text, and its language: by place in LANGUAGE_WORDS, that whose frequent words are most
        common in the text itself (the first, if none is met)."""
        if len(self.index) > self.most:
            self.forget()
        get, add = self.index.get, self._add
        ids = np.fromiter((i if (i := get(t)) is not None else add(t) for t in tokens), np.int64, len(tokens))
        return self.pairs[ids], int(self.marks[ids].sum(axis=0, dtype=np.int64).argmax())

    def _add(self, word: str) -> int:
        n = self.index[word] = len(self.index)
        if n == len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
            self.marks = np.concatenate([self.marks, np.zeros_like(self.marks)])
        self.pairs[n] = buckets(word)
        self.marks[n] = [word in own for own in _LANGUAGE_SETS]
        return n


@dataclass
class Model:
    """Embeddings (a last row of zeros fills up), filters of each width, output layer, and the score that is CUT in each
    language."""

    emb: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: list[float] = field(default_factory=list)

    def pooled(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw maxima over each whole text (texts, filters), the word each is at in the filled-up row of all texts, and
        that row's buckets. Every text is followed by zeros, so one shorter than a filter meets the filter's first rows."""
        fill = max(WIDTHS)
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths + fill) - lengths - fill
        row = np.full((int((lengths + fill).sum()), 2), WORDS, np.int64)
        for s, t in zip(starts, texts):
            row[s : s + len(t)] = t
        every = (self.emb[row[:, 0]] + self.emb[row[:, 1]]) @ np.concatenate([f for w in WIDTHS for f in self.filters[w]], axis=1)
        best, at, col = np.empty((len(texts), len(WIDTHS) * FILTERS), np.float32), np.empty((len(texts), len(WIDTHS) * FILTERS), np.int64), 0
        owner = np.repeat(np.arange(len(texts)), lengths + fill)
        for i, w in enumerate(WIDTHS):
            act = every[:, col : col + FILTERS].copy()
            for k in range(1, w):
                act[: len(row) - k] += every[k:, col + k * FILTERS : col + (k + 1) * FILTERS]
            col += w * FILTERS
            act[np.arange(len(row)) >= np.repeat(starts + np.maximum(1, lengths - w + 1), lengths + fill)] = -np.inf
            top = np.maximum.reduceat(act, starts, axis=0)
            hit_row, hit_col = np.nonzero(act == top[owner])
            first = np.unique(owner[hit_row] * FILTERS + hit_col, return_index=True)[1]
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            best[:, own], at[:, own] = top, hit_row[first].reshape(len(texts), FILTERS)
        return best, at, row

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scores before calibration. Long texts go through the filters in overlapping parts, so memory is bounded."""
        fill, parts, owner = max(WIDTHS) - 1, [], []
        for n, t in enumerate(texts):
            for s in range(0, max(1, len(t) - fill), AT_ONCE):
                parts.append(t[s : s + AT_ONCE + fill])
                owner.append(n)
        best, s = np.full((len(texts), len(self.bias)), -np.inf, np.float32), 0
        while s < len(parts):
            e, size = s, 0
            while e < len(parts) and (e == s or size + len(parts[e]) <= AT_ONCE):
                size += len(parts[e])
                e += 1
            np.maximum.at(best, owner[s:e], self.pooled(parts[s:e])[0])
            s = e
        z = np.maximum(best + self.bias, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def scores(self, texts: list[str | None], vocabulary: Vocabulary) -> np.ndarray:
        """0 to 1, with the language's threshold moved to CUT (monotone in the raw score for each language)."""
        read = [vocabulary.read(words(t)) for t in texts]
        p, t = self.raw([pairs for pairs, _ in read]), np.array([self.thresholds[lang] for _, lang in read])
        return np.where(p < t, p / t * CUT, CUT + (p - t) / (1 - t) * (1 - CUT))


def gradients(m: Model, texts: list[np.ndarray], y: np.ndarray) -> dict:
    """Gradients of the mean log loss by part; those of the embeddings as (rows, values)."""
    best, at, row = m.pooled(texts)
    h = np.maximum(best + m.bias, 0)
    d = (1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -30, 30))) - y) / len(texts)
    g = d[:, None] * m.out[None, :] * (h > 0)
    out: dict = {"out": d @ h, "out_bias": d.sum(), "bias": g.sum(axis=0), "filters": {}}
    rows, values = [], []
    for i, w in enumerate(WIDTHS):
        own = slice(i * FILTERS, (i + 1) * FILTERS)
        out["filters"][w] = np.zeros_like(m.filters[w])
        for j in range(w):
            word = row[np.minimum(at[:, own] + j, len(row) - 1)]  # (texts, filters, 2)
            out["filters"][w][j] = np.einsum("tfd,tf->df", m.emb[word[..., 0]] + m.emb[word[..., 1]], g[:, own])
            part = g[:, own, None] * m.filters[w][j].T[None]  # (texts, filters, DIM)
            for k in (0, 1):
                rows.append(word[..., k].ravel())
                values.append(part.reshape(-1, DIM))
    rows, values = np.concatenate(rows), np.concatenate(values)
    real = (rows < WORDS) & values.any(axis=1)
    some, which = np.unique(rows[real], return_inverse=True)
    total = np.zeros((len(some), DIM), np.float64)
    np.add.at(total, which, values[real])
    out["emb"] = some, total.astype(np.float32)
    return out


def train(texts: Iterable[str | None], labels: Iterable[int], epochs: int = 6, seed: int = 7) -> Model:
    """:func:`calibrated` on texts with labels 0/1. Texts may be an iterator; only their buckets are kept."""
    vocabulary, ids, languages, y = Vocabulary(), [], [], []
    for text, label in zip(texts, labels):
        pairs, language = vocabulary.read(words(text))
        ids.append(pairs)
        languages.append(language)
        y.append(label)
    return calibrated(ids, languages, y, epochs, seed)


def calibrated(ids: list[np.ndarray], languages: list[int], y: list[int], epochs: int = 6, seed: int = 7) -> Model:
    """A model of all rows, with a threshold of each language from scores of all rows by models that have not seen them:
    PARTS parts, each scored by a model of the others. Of fewer than 50 rows, or where a part would leave the others without
    toxic rows, the thresholds are of the rows themselves. Deterministic. Without rows the model scores all alike, under CUT."""
    y = np.array(y, np.float32)
    m = fitted(ids, y, epochs, seed)
    part = np.arange(len(y)) % PARTS
    if len(y) >= 50 and all(y[part != k].any() for k in range(PARTS)):
        raw = np.zeros(len(y))
        for k in range(PARTS):
            inside, outside = np.flatnonzero(part == k), np.flatnonzero(part != k)
            raw[inside] = fitted([ids[i] for i in outside], y[outside], epochs, seed).raw([ids[i] for i in inside])
    else:
        raw = m.raw(ids)
    m.thresholds = thresholds(list(zip(languages, raw.tolist(), y.tolist())))
    return m


def fitted(ids: list[np.ndarray], y: np.ndarray, epochs: int, seed: int) -> Model:
    """Fit by mini-batches (Adam) to buckets of words and labels; without thresholds."""
    rng = np.random.default_rng(seed)
    counts = np.zeros((2, WORDS), np.int64)
    for pairs, label in zip(ids, y):
        counts[int(label), np.unique(pairs)] += 1
    m = begun(counts, np.array([(1 - y).sum(), y.sum()]), rng)
    learner, order = Learner(m), np.arange(len(y))
    for _ in range(epochs if len(order) else 0):
        rng.shuffle(order)
        for s in range(0, len(order), BATCH):
            batch = order[s : s + BATCH]
            learner.step([ids[i] for i in batch], y[batch])
    return m


def begun(counts: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> Model:
    """The model before its first step: the first embedding axis starts at the smoothed log-odds of a word's presence, the
    others near zero. counts holds the rows of each label (clean, toxic) that have a bucket, rows those there are."""
    (neg, pos), (nneg, npos) = counts, np.maximum(1, rows)
    shrink = (pos + neg) / (pos + neg + 4)
    odds = shrink * (np.log((pos + 0.5) / (npos + 1)) - np.log((neg + 0.5) / (nneg + 1)))
    emb = rng.normal(0, 0.01, (WORDS + 1, DIM)).astype(np.float32)
    emb[:-1, 0] = np.clip(odds, -3, 3) / 2
    emb[:-1][pos + neg == 0] = 0
    emb[-1] = 0
    filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for f in filters.values():
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3
    return Model(emb, filters, np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0.1, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)


class Learner:
    """Steps of Adam on a model."""

    def __init__(self, model: Model):
        self.model, self.t, self.moments = model, 0, {}
        self.base = np.array([model.out_bias], np.float32)

    def step(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """One step on a mini-batch of buckets and labels."""
        m, self.t = self.model, self.t + 1
        g = gradients(m, texts, y)
        self._move("out", m.out, g["out"] + 1e-4 * m.out, 0.02)
        self._move("base", self.base, np.array([g["out_bias"]], np.float32), 0.02)
        self._move("bias", m.bias, g["bias"], 0.02)
        for w in WIDTHS:
            self._move(w, m.filters[w], g["filters"][w], 0.01)
        if len(g["emb"][0]):
            self._move("emb", m.emb, g["emb"][1], 0.02, g["emb"][0])
        m.out_bias = float(self.base[0])

    def _move(self, name, value, grad, rate, rows=None):
        a, b = self.moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        ix = slice(None) if rows is None else rows
        a[ix] = 0.9 * a[ix] + 0.1 * grad
        b[ix] = 0.999 * b[ix] + 0.001 * grad * grad
        value[ix] -= rate * (a[ix] / (1 - 0.9**self.t)) / (np.sqrt(b[ix] / (1 - 0.999**self.t)) + 1e-6)


def flat(m: Model) -> np.ndarray:
    """All values that are learned, in one row."""
    return np.concatenate([m.emb.ravel(), *(m.filters[w].ravel() for w in WIDTHS), m.bias, m.out, [m.out_bias]]).astype(np.float32)


def unflat(values: np.ndarray) -> Model:
    """The model of a row of :func:`flat`."""
    shapes = [(WORDS + 1, DIM), *((w, DIM, FILTERS) for w in WIDTHS), (FILTERS * len(WIDTHS),), (FILTERS * len(WIDTHS),), (1,)]
    parts = np.split(np.array(values, np.float32), np.cumsum([math.prod(s) for s in shapes])[:-1])
    emb, *filters, bias, out, base = (p.reshape(s) for p, s in zip(parts, shapes))
    return Model(emb, dict(zip(WIDTHS, filters)), bias, out, float(base[0]))


def thresholds(scored: list[tuple], prior: float = PRIOR) -> list[float]:
    """For each language the raw score of the best F1 (midway between scores), drawn towards that over all languages: with
    n toxic rows, its own counts n and the common one ``prior``. Where no document is toxic at all, one that no score
    reaches but 1. scored holds (language, score, label), and the number of such rows where it isn't one."""

    def best(rows) -> float:
        rows = sorted(rows, reverse=True)
        total = sum(label * k for _, label, k in rows)
        if not total:
            return 0.98
        hits, n, top, at = 0.0, 0, -1.0, 0.5
        for i, (p, label, k) in enumerate(rows, 1):
            hits += label * k
            n += k
            following = rows[i][0] if i < len(rows) else 0.0
            if p > following and (f1 := 2 * hits / (n + total)) > top + 1e-12:
                top, at = f1, (p + following) / 2
        return at

    scored = [(g, p, y, *(more or [1])) for g, p, y, *more in scored]
    whole, out = best([(p, y, k) for _, p, y, k in scored]), []
    for lang in range(len(LANGUAGE_WORDS)):
        own = [(p, y, k) for g, p, y, k in scored if g == lang]
        toxic, rows = sum(y * k for _, y, k in own), sum(k for *_, k in own)
        at = (toxic * best(own) + prior * whole) / (toxic + prior) if 0 < toxic < rows else whole
        out.append(float(np.clip(at, 0.02, 0.98)))
    return out


def held_out(doc_id):
    """crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int | None = None, most: int | None = None) -> Model:
    """Model from all labelled documents that are not held out (null labels and ids are left out; of several labels of one
    id the largest counts; repeated documents are rows each); if given, only from those of least hash, at most ``rows`` of
    at most ``most`` words together. Empty tables: a model that marks nothing.

    Counts, models and thresholds are of all these rows. Executors turn the texts into buckets of words, written once, and
    count the rows of each bucket. In a round every shard of the rows learns from the same models and the means of their
    steps are the next round's; a task holds its models and one batch of rows, and only models and counts of bounded size
    meet the driver. Thresholds come from scores by models of the other parts (see :func:`calibrated`), counted by score.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = labels.select(F.expr(f"try_cast(doc_id as {kind})").alias("doc_id"), "toxic").where("toxic in (0, 1) and doc_id is not null")
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    h = F.xxhash64("doc_id", F.lit(11))
    if rows is not None:
        named = named.orderBy(h, "doc_id").limit(rows)
    bit = F.pmod(h, F.lit(FILTER_BITS))
    bits = named.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id, 11), 64) as int))")).alias("bits"), F.count(F.lit(1)).alias("n")).toArrow()
    shards = max(1, min(SHARDS, math.ceil(sum(bits["n"].to_pylist()) / SHARD_ROWS)))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for b in slices(batches):
            at = b["h"].to_numpy() % FILTER_BITS
            b = b.filter(pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            got = [vocabulary.read(words(t)) for t in b["text"].to_pylist()]
            columns = [b["h"], b["doc_id"], b["t"], pa.array([language for _, language in got], pa.int32()),
                       pa.array([len(pairs) for pairs, _ in got], pa.int64()), pa.array([pairs.astype("<u2").tobytes() for pairs, _ in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "t", "language", "n", "pairs"])

    first = ["h", "doc_id", "t"]
    sample = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(h.alias("h"), "doc_id", F.xxhash64("text").alias("t"), "text")
    got = sample.mapInArrow(read, f"h bigint, doc_id {kind}, t bigint, language int, n bigint, pairs binary")
    got = got.join(named.select("doc_id", F.col("toxic").cast("int").alias("toxic")).hint("merge"), "doc_id")  # no broadcast of a table that grows
    if rows is not None:
        got = got.orderBy(*first).limit(rows)
    if most is not None:
        before = Window.orderBy(*first).rowsBetween(Window.unboundedPreceding, 0)  # a bounded number of rows where rows is given
        got = got.withColumn("_w", F.sum("n").over(before)).where(F.col("_w") <= most)
    dealt = lambda salt, n: F.pmod(F.xxhash64("h", "t", F.lit(salt)), F.lit(n)).cast("int")
    got = got.select("h", "t", "toxic", "language", "pairs", dealt(1, PARTS).alias("part"), dealt(2, shards).alias("shard"))
    return _learned(cut(got.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "t"), "toxic"), shards)


def _learned(seen: DataFrame, shards: int, seed: int = 7) -> Model:
    """Model of a written table (h, t, toxic, language, pairs, part, shard) with a file for each shard."""
    sizes = np.zeros((PARTS, 2), np.int64)
    for r in seen.groupBy("part", "toxic").count().collect():
        sizes[r["part"], r["toxic"]] = r["count"]
    total = int(sizes.sum())
    if not total:
        return calibrated([], [], [])
    counts = _bucket_rows(seen)
    apart = total >= 50 and all(sizes.sum(axis=0)[1] > sizes[k, 1] for k in range(PARTS))
    # the last model is of all rows, that of a part of the others
    left = [*range(PARTS), -1] if apart else [-1]
    others = lambda a, k: a.sum(axis=0) - (a[k] if k >= 0 else 0)
    models = np.stack([flat(begun(others(counts, k), others(sizes, k), np.random.default_rng(seed))) for k in left])
    for turn in range(PASSES if shards == 1 else SHARED_PASSES):
        models = models + _mean_step(seen, models, left, turn)
    m = unflat(models[-1])
    m.thresholds = thresholds(_scored(seen, models, left))
    return m


def _pairs(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").reshape(-1, 2).astype(np.int32) for x in column.to_pylist()]


def _bucket_rows(seen: DataFrame) -> np.ndarray:
    """(PARTS, 2, WORDS) rows of each part and label that have a bucket. A task sends sums of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(PARTS * 2 * WORDS, np.int64)
        for b in slices(batches):
            for part, toxic, pairs in zip(b["part"].to_pylist(), b["toxic"].to_pylist(), _pairs(b["pairs"])):
                sums[(part * 2 + toxic) * WORDS + np.unique(pairs)] += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    got = seen.select("part", "toxic", "pairs").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(PARTS * 2 * WORDS, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(PARTS, 2, WORDS)


def _mean_step(seen: DataFrame, models: np.ndarray, left: list[int], turn: int) -> np.ndarray:
    """What to add to each model (a row of values; left: the part it doesn't see) after a pass over the rows: of a value the
    mean over the shards that moved it. Shards and their order are by hash, so a run can be repeated."""
    shared = seen.sparkSession.sparkContext.broadcast(models)
    size = models.shape[1]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, learners, waiting = None, [], []

        def ended() -> pa.RecordBatch:
            for learner, rows in zip(learners, waiting):
                if rows:
                    learner.step([p for p, _ in rows], np.array([y for _, y in rows], np.float32))
            fits, blocks, steps = [], [], []
            for k, learner in enumerate(learners):
                moved = flat(learner.model) - shared.value[k]
                for s in range(0, size, BLOCK):
                    if moved[s : s + BLOCK].any():
                        fits.append(k)
                        blocks.append(s // BLOCK)
                        steps.append(moved[s : s + BLOCK].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(fits, pa.int32()), pa.array(blocks, pa.int32()), pa.array([shard] * len(fits), pa.int32()), pa.array(steps, pa.binary())], ["fit", "block", "shard", "step"])

        for b in slices(batches):
            for own, part, toxic, pairs in zip(b["shard"].to_pylist(), b["part"].to_pylist(), b["toxic"].to_pylist(), _pairs(b["pairs"])):
                if own != shard:
                    if shard is not None:
                        yield ended()
                    shard, learners, waiting = own, [Learner(unflat(v)) for v in shared.value], [[] for _ in left]
                for learner, out, rows in zip(learners, left, waiting):
                    if part != out:
                        rows.append((pairs, toxic))
                        if len(rows) == BATCH:
                            learner.step([p for p, _ in rows], np.array([y for _, y in rows], np.float32))
                            rows.clear()
        if shard is not None:
            yield ended()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, times = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([(total / np.maximum(1, times)).astype(np.float32).tobytes()], pa.binary())], ["fit", "block", "step"])
        for b in batches:
            for fit_, block, step in zip(b["fit"].to_pylist(), b["block"].to_pylist(), b["step"].to_pylist()):
                step = np.frombuffer(step, np.float32)
                if at != (fit_, block):
                    if at is not None:
                        yield done()
                    at, total, times = (fit_, block), np.zeros(len(step)), np.zeros(len(step))
                total += step
                times += step != 0
        if at is not None:
            yield done()

    # a shard is in one file, so nothing is shuffled (the pieces of a file larger than a split learn on their own)
    rows = seen.select("shard", F.xxhash64("h", "t", F.lit(3 + turn)).alias("turn"), "part", "toxic", "pairs").sortWithinPartitions("shard", "turn", "pairs")
    steps = rows.mapInArrow(learn, "fit int, block int, shard int, step binary")
    got = steps.repartition("fit", "block").sortWithinPartitions("fit", "block", "shard", "step").mapInArrow(mean, "fit int, block int, step binary").toArrow()
    out = np.zeros_like(models)
    for k, block, step in zip(got["fit"].to_pylist(), got["block"].to_pylist(), got["step"].to_pylist()):
        out[k, block * BLOCK : block * BLOCK + BLOCK] = np.frombuffer(step, np.float32)
    shared.destroy()
    return out


def _scored(seen: DataFrame, models: np.ndarray, left: list[int]) -> list[tuple]:
    """(language, score, label, rows) over all rows, each scored by the model that hasn't seen its part (by that of all rows,
    where there is no other), in SCORE_STEPS steps."""
    shared = seen.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: unflat(v) for k, v in zip(left, shared.value)}
        for b in slices(batches):
            pairs, part = _pairs(b["pairs"]), b["part"].to_numpy()
            if len(left) == 1:
                part = np.full(len(part), -1)
            at = np.zeros(len(part), np.int32)
            for k in np.unique(part):
                mine = np.flatnonzero(part == k)
                at[mine] = np.rint(own[int(k)].raw([pairs[i] for i in mine]) * SCORE_STEPS)
            yield pa.RecordBatch.from_arrays([b["language"], pa.array(at), b["toxic"]], ["language", "at", "toxic"])

    got = seen.select("part", "language", "toxic", "pairs").mapInArrow(run, "language int, at int, toxic int").groupBy("language", "at", "toxic").count().toArrow()
    shared.destroy()
    return [(g, at / SCORE_STEPS, y, n) for g, at, y, n in zip(*(got[c].to_pylist() for c in ("language", "at", "toxic", "count")))]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus tox_score (a column of that name is replaced). Whole texts, however long; null and empty texts get the
    score of no words; repeated rows score alike; a text without any language's frequent words counts as the first
    language. No rows: none. One pass, no shuffle; other columns pass through as they are."""
    docs = docs.drop("tox_score")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "tox_score double"])
    shared = docs.sparkSession.sparkContext.broadcast(asdict(model))  # plain arrays: workers need no package for them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, vocabulary = Model(**shared.value), Vocabulary()
        for b in slices(batches):
            scores = m.scores(b["text"].to_pylist(), vocabulary)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "tox_score"])

    return docs.mapInArrow(run, schema)

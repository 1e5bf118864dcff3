"""Language-model scores by stupid backoff over n-gram count tables that are partitioned by hash."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, in_slices

#: Longest n-gram, and the factor of each step back.
ORDER, BACKOFF = 3, 0.4
#: Words of a chunk of documents, and n-grams of one part of a count table, about.
CHUNK_WORDS, PART_KEYS = 2_000_000, 2_000_000


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; null: none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def ngram_keys(w: np.ndarray, starts: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For each n from 1: keys of the n-grams that end at each word (only those inside one document are meaningful;
    see :func:`depth`)."""
    keys = [w]
    for _ in range(1, order):
        keys.append(_mix(np.r_[np.zeros(1, np.uint64), keys[-1][:-1]], w) if len(w) else w)
    return keys


def depth(lengths: np.ndarray) -> np.ndarray:
    """Place of each word in its document, from 0."""
    starts = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(starts, lengths)


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers as byte planes, squeezed: small numbers cost little."""
    return zlib.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes(), 1)


def _unpacked(raw: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1).T).view(dtype).ravel()


def chunks(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(chunk, ids, lengths, vocabulary, tokens, n): documents in chunks of about so many words, as numbered words. It is
    written once, so the chunks stay as they are whatever is run again, and in buckets of the chunk, so that the totals
    come to where the chunks are and the chunks are not shuffled."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, lengths, tokens, known, total = [], [], [], {}, 0

        def flush():
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
            numbers = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
            return pd.DataFrame({"chunk": [uuid.uuid4().hex], "ids": [ids], "lengths": [lengths], "vocabulary": [hashes.tobytes()], "tokens": [_packed(numbers)], "n": [total]})

        for b in batches:
            for doc_id, text in zip(b["doc_id"].astype(object), b["text"]):
                own = words(text if isinstance(text, str) else None)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                lengths.append(len(own))
                tokens.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.uint32, len(own)))
                total += len(own)
                if total >= chunk_words:
                    yield flush()
                    ids, lengths, tokens, known, total = [], [], [], {}, 0
        if ids:
            yield flush()

    schema = "chunk string, ids array<bigint>, lengths array<bigint>, vocabulary binary, tokens binary, n bigint"
    return bucketed(in_slices(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema), "chunk", "chunks")


def _distinct(vocabulary: bytes, tokens: bytes, lengths, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: where n-grams end, the sorted distinct keys, and the number of the key at each end."""
    w = np.frombuffer(vocabulary, np.uint64)[_unpacked(tokens, "<u4")]
    at = depth(np.asarray(lengths, np.int64))
    for n, keys in enumerate(ngram_keys(w, at, order)):
        ends = np.flatnonzero(at >= n)
        distinct, which = np.unique(keys[ends], return_inverse=True)
        yield ends, distinct, which


def ngrams(chunked: DataFrame, parts: int, order: int = ORDER, counted: bool = True, asks: bool = True) -> DataFrame:
    """The exploded n-grams: (n, part, chunk, keys, counts, asks), the distinct n-grams of a chunk in each part of the
    hash space, with how often it has them. A frequent n-gram comes once from each chunk, so it is summed before it is
    shuffled and no part grows with it."""
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                for n, (_, keys, which) in enumerate(_distinct(r.vocabulary, r.tokens, r.lengths, order), 1):
                    if not len(keys):
                        continue
                    counts = np.bincount(which, minlength=len(keys)).astype(np.uint32) * np.uint32(counted)
                    part = (keys >> shift).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)
                    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                    yield pd.DataFrame([
                        (n, int(part[s]), r.chunk, _packed(np.diff(keys[s:t], prepend=np.uint64(0))), _packed(counts[s:t]), asks)
                        for s, t in zip(cuts, np.r_[cuts[1:], len(keys)])], columns=["n", "part", "chunk", "keys", "counts", "asks"])

    return chunked.select("chunk", "lengths", "vocabulary", "tokens").mapInPandas(run, "n int, part int, chunk string, keys binary, counts binary, asks boolean")


def _answer(part: pd.DataFrame) -> pd.DataFrame:
    """One part of the count table of n-grams: sums the counts and gives each chunk the totals of the keys it sent."""
    keys = [np.cumsum(_unpacked(k, "<u8"), dtype=np.uint64) for k in part["keys"]]
    counts = np.concatenate([_unpacked(c, "<u4") for c in part["counts"]])
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, which, counts.astype(np.int64))
    ends = np.cumsum([len(k) for k in keys])
    rows = [(int(n), int(p), c, _packed(totals[which[e - len(k) : e]]))
            for n, p, c, a, k, e in zip(part["n"], part["part"], part["chunk"], part["asks"], keys, ends) if a]
    return pd.DataFrame(rows, columns=["n", "part", "chunk", "totals"])


def _scorer(total_words: int, order: int, backoff: float, leave_own: bool):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in chunk.itertuples():
            lengths = np.asarray(r.lengths, np.int64)
            total, doc = int(lengths.sum()), np.repeat(np.arange(len(lengths)), lengths)
            count = np.zeros((order + 1, total))  # of the n-gram that ends at each word
            for n, (ends, keys, which) in enumerate(_distinct(r.vocabulary, r.tokens, r.lengths, order), 1):
                if not len(keys):
                    continue
                own = answers[answers["n"] == n].sort_values("part")
                got = np.concatenate([_unpacked(t, "<i8") for t in own["totals"]])[which].astype(float)
                if leave_own:
                    pair, at, mine = np.unique(doc[ends] * np.int64(len(keys)) + which, return_inverse=True, return_counts=True)
                    got -= mine[at]
                count[n, ends] = got
            at = depth(lengths)
            left = total_words - (lengths[doc] if leave_own else 0)
            score = np.full(total, np.nan)
            level = np.zeros(total, int)
            for n in range(order, 0, -1):
                context = np.r_[0.0, count[n - 1, :-1]] if n > 1 else np.asarray(left, float) * np.ones(total)
                hit = np.isnan(score) & (at >= n - 1) & (count[n] > 0) & (context > 0)
                steps = np.minimum(at, order - 1) - (n - 1)
                score[hit] = np.log(np.minimum(count[n][hit] / context[hit], 1.0)) + steps[hit] * np.log(backoff)
                level[hit] = n
            new = np.isnan(score)  # a word that is nowhere else: as if seen half a time
            score[new] = np.minimum(at[new], order - 1) * np.log(backoff) + np.log(0.5 / (np.asarray(left, float) * np.ones(total) + 1)[new])
            sums = np.bincount(doc, score, len(lengths))
            seen = [np.bincount(doc, level == n, len(lengths)).astype(np.int64) for n in range(1, order + 1)]
            ids = pd.array([None if i is None or i != i else int(i) for i in r.ids], "Int64")
            out.append(pd.DataFrame({"doc_id": ids, "n_words": lengths, "log_score": sums,
                                     "score": np.where(lengths > 0, sums / np.maximum(lengths, 1), np.nan), "backed_off": lengths - seen[order - 1]}))
        return pd.concat(out)

    return run


def score_corpus(docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, backoff: float = BACKOFF,
                 leave_own: bool = True, chunk_words: int = CHUNK_WORDS, part_keys: int = PART_KEYS) -> DataFrame:
    """(doc_id, n_words, log_score, score, backed_off) of every document under the counts of all of ``corpus``.

    corpus is docs unless given. A word's score is c(ngram) / c(context) for the longest n-gram that the corpus has,
    times ``backoff`` for each step back; log_score is the sum of logs over the document, score the mean for a word and
    backed_off the number of words that were not scored by an n-gram of full length. Where docs is the corpus,
    ``leave_own`` subtracts a document's own counts first, so that it is scored by all other documents (a copy of it
    is another document). A word met nowhere else counts half a time.

    The counts are a table of n-grams partitioned by hash. Documents come in chunks; a chunk's distinct n-grams go to
    their part, are summed there, and the totals go back to the chunk, which is a join of the count table with the
    exploded n-grams in which each n-gram of a chunk moves once, however often it occurs. Keys are 64-bit hashes.

    Null and empty texts and texts without words have n_words 0, log_score 0 and a null score. Repeated rows are documents
    each. Empty input: no rows.
    """
    mine = chunks(docs, chunk_words)
    base = mine if corpus is None else chunks(corpus, chunk_words)
    total = int(base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    keys = total if corpus is None else total + int(mine.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    parts = 1 << max(0, (max(1, -(-keys // part_keys)) - 1).bit_length())
    sent = ngrams(base, parts, order, True, corpus is None)
    if corpus is not None:
        sent = sent.unionByName(ngrams(mine, parts, order, False, True))
    answers = sent.groupBy("n", "part").applyInPandas(_answer, "n int, part int, chunk string, totals binary")
    scored = mine.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        _scorer(total, order, backoff, leave_own and corpus is None), "doc_id bigint, n_words bigint, log_score double, score double, backed_off bigint")
    return scored.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))

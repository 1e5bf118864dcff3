"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from failscope.llm import runs


def brute(t):
    """(start, length, period) of all runs, by trying every period."""
    found = {}
    for q in range(1, len(t) // 4 + 1):
        i = 0
        while i < len(t) - q:
            s = i
            while i < len(t) - q and t[i] == t[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q - s), q)
            i += s == i
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(t, found):
    return " ".join(w for i, w in enumerate(t) if not any(s + q <= i < s + n for s, n, q in found))


def repetitive(rng, n, letters):
    t = []
    while len(t) < n:
        t += [rng.choice("abcde"[:letters]) for _ in range(rng.randrange(1, 8))] * rng.randrange(1, 9) if rng.random() < 0.5 else [rng.choice("abcdefgh")]
    return t[:n]


@pytest.mark.parametrize("seed", range(3))
def test_scan_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(300):
        texts = [repetitive(rng, rng.choice([0, 1, 5, 6, 7, 20, 60, 200]), rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(1, 6))]
        for t, found, kept in zip(texts, *runs.scan(texts)):
            assert [tuple(r) for r in found.tolist()] == brute(t)
            assert kept == collapsed(t, brute(t))


def test_runs_of_words_without_repeats_and_of_one_word():
    assert [len(r) for r in runs.scan([[str(i) for i in range(5000)], []])[0]] == [0, 0]
    assert runs.scan([["a"] * 30000])[0][0].tolist() == [[0, 30000, 1]]
    assert runs.scan([["a", "b", "c"] * 9000 + ["a"]])[0][0].tolist() == [[0, 27001, 3]]


def test_equal_texts_beside_each_other_make_no_run():
    assert [len(r) for r in runs.scan([["x", "y", "z"]] * 50)[0]] == [0] * 50


def test_wavelet_tree_finds_the_nearest_on_both_sides():
    rng = np.random.default_rng(3)
    order = rng.permutation(500).astype(np.int32)
    tree = runs.WaveletTree(order)
    lo = rng.integers(0, 450, 200).astype(np.int32)
    hi = (lo + rng.integers(1, 50, 200)).astype(np.int32)
    x = order[(lo + hi) // 2]
    before, left, after, right = tree.beside(lo, hi, x)
    for q, v in zip(before, left):
        assert v == max(y for y in order[lo[q] : hi[q]] if y < x[q])
    for q, v in zip(after, right):
        assert v == min(y for y in order[lo[q] : hi[q]] if y > x[q])
    assert len(before) == sum(order[a:b].min() < y for a, b, y in zip(lo, hi, x))


def test_query_rows_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(repetitive(rng, rng.randrange(0, 120), 3)), "k", "own") for i in range(80)]
    rows += [(100, None, None, None), (101, "", "", ""), (None, "a a a a a a b", "n", "n"), (7, "x y " * 6, "s", "s"), (7, "x y " * 6, "s", "s"), (103, "w " * 40000, "long", "l"), (104, "a\x0bb\x1fc\r" * 9, "t", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, Collapsed string")
    found = runs.find_runs(docs, runs.looped_words)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(runs.digest(found).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_runs))
    want = []
    for d, text, *_ in rows:
        t = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and t:
            a = h // 10 % len(t)
            p = 1 + (len(t) - a) // (3 + h // 10 % 8)
            t = [t[i] if i < a else t[a + (i - a) % p] for i in range(len(t))]
        all_ = [(0, 40000, 1)] if d == 103 and h % 10 else brute(t)
        best = min(all_, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        kept = "w" if d == 103 else collapsed(t, all_)
        want.append((d, len(all_), *best, 1000 * best[1] // best[2] if all_ else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in all_).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert sum(r.n_runs > 0 for r in got) > 30
    assert runs.digest(runs.find_runs(docs.limit(0))).count() == 0
    assert runs.find_runs(docs.withColumn("n_words", F.lit("x"))).dtypes[1] == ("n_words", "bigint")

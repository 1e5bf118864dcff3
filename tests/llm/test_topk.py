"""Exact top-k products against all products."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from failscope.llm import topk

EMB = "vec_id bigint, embedding array<float>, label string"


def brute(rows, every, k=5):
    """Sorted (query_id, rank, vec_id, score) by all products."""
    fine = [(v, [math.floor(256 * x) for x in e]) for v, e, *_ in rows if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (q, x) in enumerate(fine):
        if q % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(x, y)), v) for j, (v, y) in enumerate(fine) if j != i and len(y) == len(x)))[:k]
            out += [(q, r, v, -s) for r, (s, v) in enumerate(scores, 1)]
    return sorted(out)


def vectors(seed, n=400, dim=8, kind="mixed"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if kind == "clusters":  # high cosines: coordinates prune
        x = np.repeat(rng.normal(size=(n // 20, dim)), 20, axis=0) + 0.05 * x
        x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "lengths":  # very different lengths: buckets prune
        x *= np.exp(rng.normal(0, 2, n))[:, None]
    x = x.astype(np.float32).astype(float)
    x[50:90] = x[40]
    return [(i, [float(v) for v in row], "x") for i, row in enumerate(x)]


ODD = [(1000, None, None), (1001, [0.0] * 8, "z"), (1002, [float("inf")] + [0.0] * 7, "z"), (None, [1.0] * 8, "n"), (1010, [1.0, None], "n"), (1020, [], "e"), (1030, [0.5, 2.0], "two"),
       (1040, [1.0, -1.0], "two"), (1050, [float("nan")] * 8, "n"), (1060, [0.0] * 8, "z"), (20, [3.0] * 8, "again"), (20, [3.0] * 8, "again"), (1080, [], "e")]


@pytest.mark.parametrize("kind", ["mixed", "clusters", "lengths"])
def test_equals_all_products(spark, kind):
    rows = vectors(1, kind=kind) + ODD
    df = spark.createDataFrame(rows, EMB)
    got = sorted(tuple(r) for r in topk.top_products(df, F.col("vec_id") % 10 == 0, candidates=64, queries=16, first=30).collect())
    assert got == brute(rows, 10)


def test_equal_vectors_few_rows_and_none(spark):
    rows = [(i, [1.0, 2.0], "x") for i in range(60)]
    got = sorted(tuple(r) for r in topk.top_products(spark.createDataFrame(rows, EMB), F.col("vec_id") % 2 == 0, candidates=8, queries=4, first=4).collect())
    assert got == brute(rows, 2)
    few = [(0, [-1.0], "x"), (1, [2.0], "x"), (2, [1.0], "x")]
    got = sorted(tuple(r) for r in topk.top_products(spark.createDataFrame(few, EMB), F.col("vec_id") % 1 == 0).collect())
    assert got == brute(few, 1)
    assert topk.top_products(spark.createDataFrame([], EMB), F.col("vec_id") % 1 == 0).count() == 0


def test_coordinates_lose_no_vector_of_the_cosine():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = rng.normal(size=(300, 6)) * 100
        x[:100] = x[0] + rng.normal(size=(100, 6)) * rng.choice([1, 10, 40])
        b = topk.Bucket(np.rint(x).astype(np.int64), np.arange(300))
        q = b.unit[rng.integers(300)]
        for cosine in (0.0, 0.5, 0.9, 0.99, 1.0):
            assert set(np.flatnonzero(b.unit @ q >= cosine)) <= set(b.by_coordinates(q, max(0.0, cosine - 1e-9)).tolist())


def test_pruning_leaves_most_vectors_alone(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(50, 32)), 40, axis=0) + 0.05 * rng.normal(size=(2000, 32))
    rows = np.rint(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    seen, plain = [0], topk.products
    monkeypatch.setattr(topk, "products", lambda r, q: (seen.__setitem__(0, seen[0] + len(r) * len(q)), plain(r, q))[1])
    scores = rows @ rows[:20].T
    found = topk.retrieve(topk.Bucket(rows, np.arange(2000)), rows[:20], np.sort(scores, axis=0)[-6].astype(float), 6)
    by = defaultdict(list)
    for q, i, s, _ in found:
        by[q].append((-s, i))
    assert all(sorted(by[q]) == sorted((-int(s), i) for i, s in enumerate(scores[:, q]))[:6] for q in range(20))
    assert seen[0] < 0.2 * 20 * 2000


def test_products_stay_exact_and_overflow_is_an_error():
    big = np.array([[1 << 30, 1], [1 << 30, 2]], np.int64)
    assert topk.products(big, big).tolist() == [[(1 << 60) + 1, (1 << 60) + 2], [(1 << 60) + 2, (1 << 60) + 4]]
    with pytest.raises(OverflowError):
        topk.products(big << 3, big << 3)

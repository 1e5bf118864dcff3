"""Filter interactions against running every order over every document."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from failscope.llm import interactions


def brute(docs, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and x(q, t) == 1} for x in (lambda q, t: q, lambda q, t: t))
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    fails, out = [], {}
    for d, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and least[t] < d]
        fails.append((lang or "", {c for c, b in zip("ABCDE", bad) if b}, d in good, d in toxic))
    shapley = Counter()
    for part in {p for p, *_ in fails}:
        own = [f[1:] for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                failing = sum(c in x[0] for x in own)
                shapley[part, c] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(x[0] == {c} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def documents(seed, n=250):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 30, 99, 100, 150]))]
        if rng.random() < 0.3:
            words += words[: len(words) // 2]
        if rng.random() < 0.2:
            words = [w.upper() + "QWERTY" for w in words]
        if rng.random() < 0.2:
            words.append(rng.choice(["#", "a$b", "|"]))
        rows.append((i, rng.choice([" ", "\n", " \x0b", "\r\n"]).join(words), rng.choice(["en", "en", "de", None, ""])))
    rows += [(n + i, rows[rng.randrange(n)][1], rng.choice(["en", "fr"])) for i in range(n // 3)]
    return rows + [(None, rows[0][1], "en"), (None, None, None), (5, rows[5][1], "xx"), (9000, None, "en"), (9001, "", "de"), (9002, "  É" * 200, "en"), (9003, "A b" * 20000, "en"), (-4, "", "en")]


@pytest.mark.parametrize("seed", [0, 1])
def test_audit_equals_running_every_order(spark, seed):
    rng, docs = random.Random(seed), documents(seed)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for d, *_ in docs if rng.random() < 0.6] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*r, "x", 1, "y") for r in docs], "doc_id bigint, text string, lang string, part string, n int, digest string")
    got = interactions.audit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r["step"]): tuple(r)[3:] for r in got} == brute(docs, labels)
    assert len(got) == 600 * len({r[2] or "" for r in docs})


def test_audit_of_nothing(spark):
    docs, labels = "doc_id bigint, text string, lang string", "doc_id bigint, quality int, toxic int"
    assert interactions.audit(spark.createDataFrame([], docs), spark.createDataFrame([], labels)).count() == 0
    only = interactions.audit(spark.createDataFrame([(1, None, None)], docs), spark.createDataFrame([], labels)).collect()
    assert len(only) == 600 and {r.part for r in only} == {""} and sum(r.removed for r in only) == 120


def test_popcounts_equal_plain_counts():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 5, 1000):
        words, times = rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.choice([1, 1, 2, 3, 1 << 33], n)
        want = Counter()
        for w, k in zip(words.tolist(), times.tolist()):
            for b in range(32):
                want[b] += (w >> b & 1) * k
        assert interactions.positional_popcounts(words, times.astype(np.int64)).tolist() == [want[b] for b in range(32)]


def test_words_are_truth_tables():
    words = interactions.survival_words(np.arange(32))
    seen = defaultdict(set)
    for f, w in enumerate(words.tolist()):
        for s in range(32):
            assert bool(w >> s & 1) == (s & f == 0)
            seen[s].add(w >> s & 1)
    assert seen[0] == {1}

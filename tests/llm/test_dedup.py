"""Near-duplicate operators against brute force, and their defined results on odd rows."""

import random
import re

import numpy as np
import xxhash

from failscope.llm import lattice, lines, simhash
from failscope.llm.common import components

DOCS = "doc_id bigint, text string, source string"


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def text(rng, n, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_fingerprint(t, k=3):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(1)
    base = [text(rng, 200) for _ in range(40)]
    rows = [(i, t, "a") for i, t in enumerate(base)]
    for i in range(60):
        w = base[i % 20].split()
        w[rng.randrange(200)] = "new"
        rows.append((100 + i, " ".join(w), "b"))
    rows += [(300, None, None), (301, "", "x"), (302, " \t\n", None), (303, "One two", "x"), (304, "one  TWO", "x"), (5, base[5], "a"), (None, base[6], "a"), (305, "z" * 50000, None)]
    got = simhash.simhash_components(spark.createDataFrame(rows, DOCS), tile=16).collect()
    fp = [brute_fingerprint(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    root, least = roots(range(len(rows)), links), {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    want = sorted((d if d is not None else -1, fp[i], least.get(root[i])) for i, (d, _, _) in enumerate(rows))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp % (1 << 64), r.component_id) for r in got) == want
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS), k=3).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least.values()))
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).count() == 0


def test_linked_tiles_equal_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (300, 2)).astype(np.uint64)
    a, b = np.unique(base), np.unique(base ^ flips[:, 0] ^ flips[:, 1])
    pairs = simhash.linked(a, b, 3, False)
    every = np.stack(np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 3), 1) + [0, len(a)]
    nodes = range(len(a) + len(b))
    assert roots(nodes, pairs.tolist()) == roots(nodes, every.tolist())


def test_e8_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(200, 8)) * 2
    p = lattice.decode(y) / 2
    near = ((y - p) ** 2).sum(1)
    others = ((y[:, None] - p[:, None] - lattice.ROOTS[None] / 2) ** 2).sum(2).min(1)
    assert len(lattice.ROOTS) == 240 and (near <= others + 1e-9).all() and (near <= 1 + 1e-9).all()
    assert (np.rint(p.sum(1) * 2) % 4 == 0).all()


def test_lattice_near_duplicates(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = []
    for i in range(30):
        for _ in range(8):
            v = centres[i] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], int(i % 3)))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, rows[0][1], rows[0][2]), (906, rows[0][1], rows[0][2]), (907, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    n = len(rows)
    fine = [r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) and r[2] is not None for r in rows]
    links = []
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links.append((i, j))
    degree = np.bincount(np.array(links).ravel(), minlength=n)
    root = roots(range(n), links)
    for tile in (4096, 5):
        got = {r.vec_id: r for r in lattice.near_duplicates(df, tile=tile).collect()}
        assert len(got) == n
        found = sum(got[r[0]].n_links for r in rows)
        assert all(got[r[0]].n_links <= degree[i] for i, r in enumerate(rows)) and found >= 0.98 * degree.sum()
        assert np.mean([got[r[0]].component_id == rows[root[i]][0] for i, r in enumerate(rows)]) > 0.98
        assert all(got[v].n_links == 0 and got[v].component_id == v and got[v].kept for v in (900, 901, 902, 903, 904, 907))
        assert got[905].n_links == got[906].n_links and not got[905].kept
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def shingle_set(t, k=8):
    return {t[i : i + k] for i in range(len(t) - k + 1)} or {t}


def test_fuzzy_lines(spark):
    rng = random.Random(4)
    base = [text(rng, rng.choice([3, 12, 40]), 5000) for _ in range(60)]
    docs = []
    for d in range(40):
        own = []
        for _ in range(6):
            t = rng.choice(base)
            if rng.random() < 0.4:
                w = t.split()
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
                t = " ".join(w)
            own.append(t + rng.choice(["", " ", "\r"]))
        docs.append((d, "\n".join(own + [""] * (d % 2)), "s"))
    docs += [(100, None, "s"), (101, "", None), (102, "abc", "s"), (103, "abc\nabc", "s"), (None, "null id line here", "s"), (104, "y" * 30000, "s")]
    got = lines.line_components(spark.createDataFrame(docs, DOCS)).collect()
    big = (1 << 63) - 1
    places = {}
    for d, t, _ in docs:
        for n, line in enumerate(t.split("\n") if t is not None else []):
            places[(big if d is None else d, n)] = line.strip(" \t\r")
    full = sorted(p for p, t in places.items() if t)
    sets = {t: shingle_set(t) for t in places.values()}
    links = [(p, q) for i, p in enumerate(full) for q in full[:i]
             if len(a := sets[places[p]]) and len(a & (b := sets[places[q]])) >= 0.8 * len(a | b)]
    root = roots(full, links)
    assert len(got) == len(places)
    right = 0
    for r in got:
        p = (big if r.doc_id is None else r.doc_id, r.line_no)
        assert r.blank == (places[p] == "")
        if r.blank:
            assert r.kept and r.component_line is None
        else:
            right += ((big if r.component_doc is None else r.component_doc), r.component_line) == root[p] and r.kept == (root[p] == p)
    assert right >= 0.99 * len(full)
    kept = {r.doc_id: r.text for r in lines.drop_repeated_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert len(kept) == len(docs) and kept[100] is None and kept[101] == "" and kept[103] == "" and kept[102] == "abc"
    assert lines.line_components(spark.createDataFrame([], DOCS)).count() == 0


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(5)
    base = "".join(chr(97 + c) for c in rng.integers(0, 26, 300))
    texts = [base]
    for n in (0, 1, 2, 5, 10, 40):
        own = list(base)
        for i in rng.integers(0, 300, n):
            own[i] = "#"
        texts.append("".join(own)[: 300 - n])
    texts += ["ab", "abc", "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaa"]
    n, words = lines.sketches(texts)
    may = np.array([lines.may_be_similar(words[i], n[i], words, n, 0.8) for i in range(len(texts))])
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            assert may[i, j] or not lines.similar(x, y, 0.8)
    assert not may[0, 6]


def test_short_lines_have_their_own_shingle_wherever_they_stand():
    alone = [lines.band_keys([t])[0] for t in ("ab", "abcdefgh", "x", "abcdefghij")]
    assert (lines.band_keys(["ab", "abcdefgh", "x", "abcdefghij"]) == np.array(alone)).all()


def test_joining_links_are_few_and_join_all_that_similar_pairs_join():
    rng = np.random.default_rng(6)
    bases = ["".join(chr(97 + c) for c in rng.integers(0, 26, 80)) for _ in range(3)]
    texts = [b[: 80 - int(n)] for b in bases for n in rng.integers(0, 12, 15)]
    n, words = lines.sketches(texts)
    every, label = np.arange(len(texts)), np.arange(len(texts))
    links = lines.joining_links(every, every, label, texts, words, n, 0.8)
    groups = len({frozenset(np.flatnonzero(label == k)) for k in label})
    assert len(links) == len(texts) - groups and all(lines.similar(texts[i], texts[j], 0.8) for i, j in links)
    assert all(label[i] == label[j] for i, x in enumerate(texts) for j, y in enumerate(texts) if lines.similar(x, y, 0.8))


def test_shingle_sets_that_are_kept_ready_are_bounded():
    lines._READY.clear()
    for i in range(20):
        t = " ".join(str(7 * n + i) for n in range(5000))
        assert lines.similar(t, t + "x", 0.8)
        assert sum(len(t) for t, _ in lines._READY) <= lines.HELD_CHARS


def test_lattices_find_pairs_at_the_threshold():
    """Of pairs at a cosine just over the threshold at most one in a few hundred shares no cell in any lattice."""
    rng = np.random.default_rng(9)
    for dim in (16, 64, 128):
        x, y = rng.normal(size=(2, 3000, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y -= (x * y).sum(axis=1)[:, None] * x
        y /= np.linalg.norm(y, axis=1)[:, None]
        z = 0.9301 * x + np.sqrt(1 - 0.9301**2) * y
        a, b = lattice.cells(x), lattice.cells(z)
        met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
        assert (~met).sum() <= 9

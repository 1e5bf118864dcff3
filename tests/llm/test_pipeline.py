"""Stages of the pipeline against brute force."""

import random
import tempfile

import numpy as np

import corpus_pipeline
from failscope.llm import lines, simhash
from test_dedup import DOCS, roots, text

PIPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(x, y):
    return x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9


def test_simhash_stage_keeps_one_of_each_group_of_similar_documents(spark):
    rng = random.Random(11)
    base = [text(rng, rng.choice([8, 60, 120, 400]), 3000) for _ in range(40)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(base)]
    for i in range(240):  # similarities on both sides of 0.8
        w = base[i % 40].split()
        for _ in range(rng.randrange(1, 2 + len(w) // 40)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        rows.append((100 + i, " ".join(w), "en", "b", 1))
    rows += [(900, None, None, None, None), (901, "", "x", "x", 0), (902, " \n", "x", "x", 2), (903, "One two", "x", "x", 7), (904, "one  TWO", "x", "x", 8), (None, base[3], "x", "x", 1), (5, base[5], "en", "a", 1)]
    sets = [words(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    assert sum(0.8 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.9 for i, j in links if sets[i]) > 100
    root, least = roots(range(len(rows)), links), {}
    for i, r in enumerate(rows):
        d = r[0] if r[0] is not None else simhash.LAST
        least[root[i]] = min(d, least.get(root[i], d))
    df = spark.createDataFrame(rows, PIPE)
    got = corpus_pipeline.simhash_stage(spark, df, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(least.values())
    tiled = simhash.similar_components(df, 5, 0.8, tile=16).select("keeper._id").distinct().collect()
    assert sorted(r._id for r in tiled) == sorted(least.values())
    assert corpus_pipeline.simhash_stage(spark, df.limit(0), "").count() == 0


def test_sets_at_the_least_similarity_are_near():
    rng = np.random.default_rng(7)
    for small, large, common in ((4, 5, 4), (9, 9, 8), (80, 100, 80), (900, 900, 800)):
        far = 0
        for _ in range(1500):
            h = rng.integers(0, 1 << 64, small + large - common, dtype=np.uint64)
            x, y = simhash.wide_fingerprint(h[:small]), simhash.wide_fingerprint(h[small - common :])
            far += sum((a ^ b).bit_count() for a, b in zip(x, y)) > simhash.WIDE_RADIUS
        assert far <= 5


def test_lines_at_the_least_similarity_share_a_band():
    rng = np.random.default_rng(8)
    drawn = ["".join(map(chr, rng.integers(97, 123, 107))) for _ in range(4000)]  # 90 shingles each, 80 of them in both
    x, y = lines.band_keys([t[:97] for t in drawn]), lines.band_keys([t[10:] for t in drawn])
    assert (~(x == y).any(axis=1)).sum() <= 5


def test_lines_stage_drops_each_rows_own_lines(spark):
    rng = random.Random(12)
    a, b, c, d, e, f = (text(rng, 12, 9000) for _ in range(6))
    rows = [(1, f"{a}\n{b}"), (2, f"{c}\n{d}"), (2, f"{a}\n{e}"), (None, f"{b}\n{f}"), (None, f"{f}\n{d}")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], PIPE)
    seen, want = {}, []
    places = sorted((simhash.LAST if i is None else i, n, line) for i, t in rows for n, line in enumerate(t.split("\n")))
    for i, n, line in places:
        seen.setdefault(line, (i, n))
    for i, t in rows:
        own = "\n".join(line for n, line in enumerate(t.split("\n")) if seen[line] == (simhash.LAST if i is None else i, n))
        want.append((str(i), own, len(own)))
    got = corpus_pipeline.lines_stage(spark, df, "").collect()
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in got) == sorted(want)


def test_all_stages_on_odd_rows_and_on_none(spark):
    rng = random.Random(21)
    good = [text(rng, 40, 4000) for _ in range(30)]
    rows = [(i, t, "en", "ab"[i % 2], len(t), "x", 7) for i, t in enumerate(good)]
    rows += [(100, None, "en", "a", None, "x", 7), (101, "", None, None, 0, "x", 7), (102, " \n\t", "en", "a", 3, "x", 7), (5, good[5], "en", "b", 9, "x", 7), (5, text(rng, 50, 4000), "en", "b", 9, "x", 7),
             (None, text(rng, 50, 4000), None, None, None, "x", 7), (103, "word " * 40000, "en", "a", 1, "x", 7), (104, "z" * 100000, "en", "a", 1, "x", 7)]
    docs = spark.createDataFrame(rows, PIPE + ", _id string, tox_score int")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(i, 0, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for start in (docs, docs.limit(0)):
        now, counts = start, []
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, folder).cache()
            counts.append(now.count())
            if name != "packing":
                assert now.columns == corpus_pipeline.COLUMNS
        assert counts == [0] * 5 or counts[0] == counts[1] == len(rows)
        if counts[0]:
            # copies of document 5 lost all but one text, the documents without words are one
            assert counts[2] < len(rows) and now.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
            ids = {r.doc_id for r in now.select("doc_id").distinct().collect()}
            assert len(ids & {100, 101, 102}) <= 1

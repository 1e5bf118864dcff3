"""Extra columns of clashing names, repeated rows and very long texts change no result of any operator."""

import random

import public_tokenizers as tok
import pytest
from pyspark.sql import functions as F

from failscope.llm import interactions, lattice, lines, packing, runs, scoring, search, secrets, simhash, topk

CLASHES = ["node", "place", "fp", "size", "piece", "start", "length", "row", "_q", "dim", "n", "secrets", "band", "bucket", "doc", "line", "tile", "part", "words", "digest", "h1", "cell", "component_id", "score", "fingerprint", "text_hash", "offset", "chunk", "grams", "failed"]


def documents(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    rows = [(i, "\n".join(text(rng.randrange(1, 12)) for _ in range(rng.randrange(1, 5))), "en") for i in range(40)]
    rows += [(100, text(40_000), "de"), (101, "x" * 300_000, None), (102, None, "en"), (103, "", "en"), (7, rows[7][1], "en"), (104, rows[3][1], "fr"), (None, rows[4][1], "en")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


OPERATORS = {
    "packing": lambda d: packing.pack_documents(d, tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "simhash": lambda d: simhash.simhash_components(d).select("doc_id", "fp", "component_id"),
    "secrets": lambda d: secrets.digest(secrets.find_secrets(d)),
    "lines": lambda d: lines.line_components(d),
    "scoring": lambda d: scoring.score_corpus(d).select("doc_id", "n_words", F.round("score", 6).alias("s")),
    "runs": lambda d: runs.digest(runs.find_runs(d)),
    "interactions": lambda d: interactions.audit(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_that_clash_are_no_matter(spark, name):
    docs = documents(spark).cache()
    plain = sorted(map(str, OPERATORS[name](docs).collect()))
    more = docs.withColumns({c: F.lit("x") for c in CLASHES})
    assert sorted(map(str, OPERATORS[name](more.repartition(3)).collect())) == plain and plain


def test_vectors_with_columns_that_clash(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(80)] + [(900, None, 1), (901, [0.0] * 6, 1), (5, [1.0] * 6, None)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(5)]
    emb = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    more = emb.withColumns({c: F.lit("x") for c in CLASHES})
    for f in (lattice.near_duplicates, lambda e: search.neighbours(e, F.col("vec_id") % 20 == 0, 5), lambda e: topk.top_products(e, F.col("vec_id") % 20 == 0)):
        plain = sorted(map(str, f(emb).collect()))
        assert plain and sorted(map(str, f(more).collect())) == plain


def test_both_encoders_agree_on_a_very_long_text(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice(["naïve", "don't", "x" * 40, "日本語", "1234567", "  ", "\t\n", "A.B", "…"]) for _ in range(20_000))
    docs = spark.createDataFrame([(1, long), (2, "a" * 200_000)], "doc_id bigint, text string")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    got = packing.pieces(docs, tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN, with_ids=True).collect()
    for d, text in ((1, long), (2, "a" * 200_000)):
        ids = sum((p.ids for p in sorted((p for p in got if p.doc_id == d), key=lambda p: p.start)), [])
        assert ids == t.encode(text, add_special_tokens=False).ids + [0]

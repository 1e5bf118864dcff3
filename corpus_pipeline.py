"""A corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; columns beside those are left out, whatever their names.

Odd rows: a null or empty text is a document without words. It is not toxic, has no line to lose, is one with all other
documents without words in the near-duplicate stage (one of them stays), takes no words in the mix and packs as one token.
Rows of one doc_id are documents each; a null doc_id comes last in every order, and stays null. Very long texts go whole
through every stage. Ties are broken by doc_id, then the text's hash. An empty table gives an empty result of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.llm import lines, mixing, packing, simhash, toxicity
from failscope.llm.common import cut
from failscope.llm.queries import tokenizer_paths

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold. The model learns from the labels of those that are not held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("tox_score") < toxicity.CUT).select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without lines that are near copies of a line at an earlier place."""
    return lines.drop_repeated_lines(docs.select(*COLUMNS))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    return simhash.keep_one_similar(docs.select(*COLUMNS), k=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a sequence; copies of a document are packed each."""
    return packing.pack_documents(docs.select("doc_id", "text"), *tokenizer_paths())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", lines_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Model scores and token ids cannot be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs

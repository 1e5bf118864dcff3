"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import interactions, lattice, lines, mixing, packing, runs, scoring, search, secrets, sharding, simhash, topk, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_read(spark, sf_dir, "embeddings")).drop("label")


def op2_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def tokenizer_paths() -> tuple[str, str, str]:
    """The vocabulary, the same vocabulary as ranks, and the pattern of its words."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack_documents(docs, *tokenizer_paths())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.simhash_components(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find_secrets(docs))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_components(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_block_matrix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_corpus(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.shard(_read(spark, sf_dir, "documents").select("doc_id", "text"), 24).drop("text")
    out = sharding.with_slots(docs).withColumn("law", F.lit("key"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    score = F.col("tox_score")
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), score.alias("score"), (score >= toxicity.CUT).cast("int").alias("predicted"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.digest(runs.find_runs(docs, runs.looped_words))


def op12_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return interactions.audit(docs, _read(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_lattice_near_dedup, op2_systematic_mixing, op3_complement_packing, op4_simhash_tiles, op5_secret_scan, op6_fuzzy_lines,
        op7_block_matrix_search, op8_stupid_backoff, op9_hash_tree_sharding, op10_toxicity_cnn, op11_periodic_runs,
        op12_norm_bucket_search, op13_filter_interactions)}


#: Links by brute force over all pairs of a label, components by reachability.
_OP1 = """with recursive e as (select vec_id, label, cast(embedding as double[]) v from embeddings where embedding is not null and label is not null),
ok as (select * from e where len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (select a.vec_id a, b.vec_id b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.93),
reach(root, node) as (select vec_id, vec_id from embeddings union select root, b from reach join links on a = node)
select vec_id, (select count(*) from links where a = vec_id) n_links, c component_id, vec_id = c kept from embeddings join (select node, min(root) c from reach group by node) on node = vec_id"""

#: All products of each query, exact in doubles, and the five first.
_OP12 = """with e as (select vec_id, list_transform(cast(embedding as double[]), lambda x: floor(256 * x)) v, row_number() over () n from embeddings
 where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id query_id, q.n qn, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) score from e q join e c on q.n <> c.n and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by qn order by score desc, vec_id) rank, vec_id, score from p)
select query_id, cast(rank as int) rank, vec_id, score from r where rank <= 5"""

#: Every order and step over counts of documents by part, failures and labels.
_OP13 = r"""with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') w from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels where doc_id is not null group by doc_id),
f as (select part, coalesce(good, 0) good, coalesce(l.toxic, 0) toxic, case when len(w) < 100 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
 + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
 + case when d.doc_id > min(d.doc_id) over (partition by t) then 16 else 0 end fails from d left join l on d.doc_id = l.doc_id),
n as (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from f group by part, fails),
x as (select unnest(range(5)) i),
o as (select [a.i, b.i, c.i, d.i, e.i] s from x a join x b on b.i <> a.i join x c on c.i not in (a.i, b.i) join x d on d.i not in (a.i, b.i, c.i) join x e on e.i not in (a.i, b.i, c.i, d.i)),
s as (select array_to_string(list_transform(s, lambda k: substr('ABCDE', cast(k + 1 as int), 1)), '') filter_order, i + 1 step, cast(1 << s[i + 1] as int) own, cast(list_sum(list_transform(s[1:i], lambda k: 1 << k)) as int) before from o join x on true),
r as (select part, filter_order, step, own, sum(case when fails & (coalesce(before, 0) | own) = 0 then n else 0 end) kept, sum(case when fails & coalesce(before, 0) = 0 and fails & own <> 0 then n else 0 end) removed,
 sum(case when fails & coalesce(before, 0) <> 0 and fails & own <> 0 then n else 0 end) redundant, sum(case when fails = own then n else 0 end) unique_fails,
 sum(case when fails & coalesce(before, 0) = 0 and fails & own <> 0 then good else 0 end) good_lost, sum(case when fails & coalesce(before, 0) = 0 and fails & own <> 0 then toxic else 0 end) toxic_lost
 from n join s on true group by part, filter_order, step, own)
select part, filter_order, cast(step as int) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails,
 cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) shapley from r"""


def oracle_sql() -> dict[str, str]:
    """The others hash, tokenize, learn or sample in ways that SQL has no words for; tests hold them against brute force."""
    return {"op1_lattice_near_dedup": _OP1, "op12_norm_bucket_search": _OP12, "op13_filter_interactions": _OP13}

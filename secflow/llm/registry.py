"""Registered queries of the text operators, each beside the SQL that checks it where SQL can express it."""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.llm import (anchor_lists, bag_search, byte_bpe, minhash, packing, piece_bpe, quality_model, quality_rules,
                         secret_scan, sharding, simhash, toxicity, url_rules)
from secflow.llm.common import documents, held_out, labels
from secflow.queries.registry import Section

section = Section()

#: The rules that the page query applies (host, path, verdict).
PAGE_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
              ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(PAGE_RULES, "host string, path string, verdict string")
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP5_SQL = """
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), part as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw_host, rest from cut
), page as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from part
), rule(rule_host, rule_path, rule_verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fit as (
  select page_id, rule_host || rule_path as rule, rule_verdict,
         row_number() over (partition by page_id order by length(rule_host || rule_path) desc) as place
  from page join rule on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page.page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict
from page left join fit on page.page_id = fit.page_id and place = 1
"""
section.add("op5_url_rules", op5_url_rules, OP5_SQL)


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.shard_by_bytes(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


section.add("op8_histogram_shards", op8_histogram_shards)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.judge(docs, quality_rules.fit(docs, labels(spark, sf_dir)))


section.add("op6_quality_rules", op6_quality_rules)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.classify(documents(spark, sf_dir), labels(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


section.add("op2_quality_classifier", op2_quality_classifier)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


section.add("op10_simhash", op10_simhash)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabularies.path("byte_bpe_50k.json"),
                        vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)


section.add("op9_packing", op9_packing)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(documents(spark, sf_dir), vocabularies.path("byte_bpe_multi_50k.tiktoken"), digest=True)


section.add("op3_byte_bpe", op3_byte_bpe)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(documents(spark, sf_dir))


section.add("op7_secret_scan", op7_secret_scan)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.rate(docs, toxicity.fit(docs, labels(spark, sf_dir)))


section.add("op1_toxicity", op1_toxicity)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_twins(documents(spark, sf_dir))


section.add("op4_minhash", op4_minhash)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode(documents(spark, sf_dir), vocabularies.path("piece_bpe_32k.model"), digest=True)


section.add("op12_sentencepiece", op12_sentencepiece)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
with word as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
), held as (
  select doc_id, term, count(*) as tf from word group by doc_id, term
), size as (
  select doc_id, cast(sum(tf) as bigint) as n from held group by doc_id
), stat as (
  select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from size
), asked as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), item as (
  select item_id, term, count(*) as times from asked group by item_id, term
), weight as (
  select term, cast(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w
  from held cross join stat where term in (select term from item) group by term
), part as (
  select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) as points
  from held join weight using (term) join size using (doc_id) cross join stat
), scored as (
  select item_id, doc_id, cast(sum(times * points) as bigint) as score
  from item join part using (term) group by item_id, doc_id having sum(times * points) > 0
), ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank,
         doc_id, score from scored
)
select * from ranked where rank <= 20
"""
section.add("op13_lexical_search", op13_lexical_search, OP13_SQL)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", shifted.alias("label"), "embedding")
    return anchor_lists.mine(rows, "vec_id % 100 = 0")


OP11_SQL = """
with valid as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pair as (
  select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as same,
         cast(list_dot_product(a.v, r.v) as bigint) as score
  from valid a join valid r on a.vec_id <> r.vec_id and len(a.v) = len(r.v) where a.vec_id % 100 = 0
), positive as (
  select * from pair where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
), hard as (
  select p.anchor_id, p.other_id as positive_id, n.other_id as negative_id, p.score as positive_score,
         n.score as negative_score, cast(row_number() over (
           partition by p.anchor_id, p.other_id order by n.score desc, n.other_id) as integer) as rank
  from positive p join pair n on n.anchor_id = p.anchor_id and not n.same
    and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from hard where rank <= 5
"""
section.add("op11_hard_negatives", op11_hard_negatives, OP11_SQL)

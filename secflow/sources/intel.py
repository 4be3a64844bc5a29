"""Threat-intelligence tables: from a bundle of objects, and as views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT = ("struct<type:string,id:string,name:string,aliases:array<string>,pattern:string,labels:array<string>,"
          "revoked:boolean,x_mitre_deprecated:boolean,valid_from:string,valid_until:string,source_ref:string,"
          "target_ref:string,relationship_type:string,x_mitre_is_subtechnique:boolean,x_mitre_shortname:string,"
          "tactic_refs:array<string>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,"
          "external_references:array<struct<source_name:string,external_id:string>>>")


def bundle_objects(raw: DataFrame, column: str = "value") -> DataFrame:
    """Objects of a JSON bundle held in one text column, one row each."""
    parsed = raw.select(F.from_json(column, f"struct<objects:array<{OBJECT}>>").alias("b"))
    return parsed.select(F.posexplode("b.objects").alias("pos", "o")).select("pos", "o.*")


def indicators(objects: DataFrame) -> DataFrame:
    return objects.where("type = 'indicator'").selectExpr(
        "id as indicator_id", "pattern", "coalesce(labels, array()) as labels", "coalesce(revoked, false) as revoked",
        "try_to_timestamp(valid_until) as valid_until")


def actors(objects: DataFrame) -> DataFrame:
    return objects.where("type = 'threat-actor'").selectExpr("id as actor_id", "name as actor")


def patterns(objects: DataFrame) -> DataFrame:
    return objects.where("type = 'attack-pattern'").selectExpr(
        "id as pattern_id", "name as pattern_name", "transform(kill_chain_phases, p -> p.phase_name) as tactics")


def relationships(objects: DataFrame) -> DataFrame:
    return objects.where("type = 'relationship'").select("source_ref", "target_ref")


def techniques(objects: DataFrame) -> DataFrame:
    """Active techniques with their tactics."""
    live = objects.where("type = 'attack-pattern' and not coalesce(revoked, false) "
                         "and not coalesce(x_mitre_deprecated, false)")
    return live.selectExpr(
        "filter(external_references, r -> r.source_name = 'mitre-attack')[0].external_id as technique", "name",
        "transform(filter(kill_chain_phases, p -> p.kill_chain_name = 'mitre-attack'), p -> p.phase_name) as tactics",
        "coalesce(x_mitre_is_subtechnique, false) as is_subtechnique").where("technique is not null").withColumn(
        "parent", F.expr("if(is_subtechnique, substring_index(technique, '.', 1), null)"))


def tactic_order(objects: DataFrame) -> DataFrame:
    """Tactics in the order of the matrix object."""
    matrix = objects.where("type = 'x-mitre-matrix'").selectExpr("posexplode(tactic_refs) as (position, id)")
    return matrix.join(objects.where("type = 'x-mitre-tactic'").selectExpr(
        "id", "x_mitre_shortname as tactic", "name"), "id").select("position", "tactic", "name")


def technique_pages(texts: DataFrame) -> DataFrame:
    """Knowledge pages (``# T1001: Name`` and ``- Label: a, b`` lines) in ``value`` as a dimension."""
    return texts.selectExpr(
        "regexp_extract(value, '(?m)^# (T[0-9.]+): (.*)$', 1) as technique",
        "trim(regexp_extract(value, '(?m)^# (T[0-9.]+): (.*)$', 2)) as name",
        "split(trim(regexp_extract(value, '(?m)^- Tacticas: (.*)$', 1)), ', *') as tactics",
        "split(trim(regexp_extract(value, '(?m)^- Plataformas: (.*)$', 1)), ', *') as platforms",
    ).where("technique <> ''")


def technique_documents(spark: SparkSession, path: str) -> DataFrame:
    return technique_pages(spark.read.text(path, wholetext=True))


# --- views of the star-schema tables in the same shapes ---------------------------------------------
def supplier_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as indicators, nations as actors, and the relationships between them, as raw JSON."""
    supplier = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_nationkey")
    pattern = ("if(s_suppkey % 4 = 0, concat('[file:hashes.MD5 = \\'', md5(cast(concat('f', s_suppkey % 25) as binary)), '\\']'), "
               "concat('[ipv4-addr:value = \\'203.0.113.', s_suppkey * 10 % 100, '\\' OR ipv4-addr:value = \\'198.51.100.', "
               "s_suppkey * 9 % 100, '\\']'))")
    return supplier.selectExpr(
        f"to_json(named_struct('type', 'indicator', 'id', concat('ind-', s_suppkey), 'pattern', {pattern}, 'labels', "
        "array(element_at(array('c2', 'malicious', 'anomalous-activity', 'spam', 'malicious-activity', 'nation-state'), "
        "cast(s_suppkey % 6 + 1 as int))), 'revoked', s_suppkey % 7 = 0, 'valid_until', "
        "if(s_suppkey % 5 = 0, '2024-01-15T00:00:00Z', null))) as indicator",
        "to_json(named_struct('type', 'relationship', 'source_ref', concat('ind-', s_suppkey), 'target_ref', "
        "if(s_suppkey % 3 = 0, concat('pat-', s_suppkey % 5), concat('actor-', s_nationkey)))) as relationship")


def supplier_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The objects above parsed back, with the nations as actors and the regions as attack patterns."""
    raw = supplier_objects(spark, sf).selectExpr("explode(array(indicator, relationship)) as value")
    nation = spark.read.parquet(f"{sf}/nation.parquet").selectExpr(
        "to_json(named_struct('type', 'threat-actor', 'id', concat('actor-', n_nationkey), 'name', "
        "if(n_nationkey = 3, 'APT28', n_name))) as value")
    region = spark.read.parquet(f"{sf}/region.parquet").selectExpr(
        "to_json(named_struct('type', 'attack-pattern', 'id', concat('pat-', r_regionkey), 'name', r_name)) as value")
    every = raw.unionByName(nation).unionByName(region)
    return every.select(F.from_json("value", OBJECT).alias("o")).select("o.*")


def reputation(spark: SparkSession, sf: str, ttl_seconds: int) -> DataFrame:
    """Customers as reputation snapshots of two feeds."""
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "concat('8.8.8.', c_custkey * 10 % 100) as observable", "if(c_custkey % 2 = 0, 'report', 'pulse') as feed",
        "cast(c_custkey * 7 % 101 as double) as score", "c_custkey * 7 % 101 >= 25 as malicious",
        "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, c_custkey * 7919 % 2592000) as queried_at",
    ).withColumn("expires_at", F.expr(f"queried_at + interval {ttl_seconds} seconds"))


def executions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as an execution log: technique, time and host (empty for some)."""
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey as exec_no", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, c_custkey * 104729 % 2592000) as ts",
        "concat('T', 1000 + c_custkey % 40) as technique",
        "if(c_custkey % 9 = 0, '', concat(element_at(array('SRV-', 'DB-', 'WKS-', 'PC-'), "
        "cast(c_custkey % 4 + 1 as int)), c_custkey % 20)) as host")


def part_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as technique objects, some revoked, deprecated or sub-techniques; raw JSON parsed back."""
    raw = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "to_json(named_struct('type', 'attack-pattern', 'id', concat('attack-pattern--', p_partkey), 'name', p_name, "
        "'revoked', p_partkey % 9 = 0, 'x_mitre_deprecated', p_partkey % 11 = 0, 'x_mitre_is_subtechnique', p_partkey % 4 = 0, "
        "'kill_chain_phases', array(named_struct('kill_chain_name', 'mitre-attack', 'phase_name', concat('phase-', p_size % 15)), "
        "named_struct('kill_chain_name', 'other', 'phase_name', 'x')), "
        "'external_references', array(named_struct('source_name', 'web', 'external_id', 'W1'), named_struct('source_name', 'mitre-attack', "
        "'external_id', if(p_partkey % 13 = 0, null, concat('T', 1000 + p_partkey, if(p_partkey % 4 = 0, '.001', ''))))))) as value")
    return raw.select(F.from_json("value", OBJECT).alias("o")).select("o.*")


def part_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as knowledge pages; every tenth text is no technique page."""
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "if(p_partkey % 10 = 0, concat('Notes on ', p_name), concat('# T', 1000 + p_partkey, ': ', p_name, '\\n\\n- Tacticas: ', p_brand, "
        "', phase-', p_size % 15, '\\n- Plataformas: Linux, ', p_type, '\\n\\ntext')) as value")

"""Technique coverage and layer documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.plans.detection import techniques_table

COLORS = "case when score >= 70 then '#d62728' when score >= 40 then '#ff7f0e' else '#ffdd57' end"


def incident_layer(incidents: DataFrame) -> DataFrame:
    """Highest risk and number of incidents per technique."""
    rows = incidents.select("incident_id", "risk", F.explode("techniques").alias("technique"))
    return rows.groupBy("technique").agg(F.max("risk").alias("score"), F.count("*").alias("n_incidents"),
                                         F.max_by("incident_id", F.struct("risk", "incident_id")).alias("worst")
                                         ).withColumn("color", F.expr(COLORS))


def layer_document(layer: DataFrame, name: str) -> DataFrame:
    """The layer as one JSON text. It has one entry per technique, which bounds the array."""
    entry = F.struct(F.col("technique").alias("techniqueID"), "score", "color",
                     F.concat(F.col("n_incidents").cast("string"), F.lit(" incident(s), worst "), "worst").alias("comment"))
    return layer.agg(F.sort_array(F.collect_list(entry)).alias("techniques")).select(
        F.to_json(F.struct(F.lit(name).alias("name"), F.lit("enterprise-attack").alias("domain"), "techniques")).alias("layer"))


def rule_layer(rules: DataFrame) -> DataFrame:
    """Techniques with at least one rule (rule_id, technique)."""
    return rules.groupBy("technique").agg(F.count_distinct("rule_id").alias("n_rules"),
                                          F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"))


def coverage(rules: DataFrame) -> DataFrame:
    """Covered and known techniques per tactic; a sub-technique covers its parent."""
    covered = rules.select(F.substring_index("technique", ".", 1).alias("technique")).distinct().withColumn("hit", F.lit(1))
    return (techniques_table(rules.sparkSession).join(covered, "technique", "left").groupBy("tactic")
            .agg(F.count("*").alias("total"), F.count("hit").alias("covered"))
            .withColumn("ratio", F.expr("round(covered / total, 4)")))

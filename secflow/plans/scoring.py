"""Evidence per event and the combined score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.schema import ALERT_THRESHOLD, ANOMALY_THRESHOLD

STATUS = (f"case when n_rules > 0 and anomaly_score >= {ANOMALY_THRESHOLD} then 'RULE_AND_ANOMALY' "
          f"when n_rules > 0 then 'RULE_MATCH' when anomaly_score >= {ANOMALY_THRESHOLD} then 'ANOMALY_ONLY' "
          "when behaviour_score is not null then 'BEHAVIORAL_ANOMALY' else 'NO_DETECTION' end")
SCORE = ("least(100D, if(n_rules > 0, 50D, 0D) "
         f"+ greatest(0D, (anomaly_score - {ANOMALY_THRESHOLD}D) * 40D) + if(sequences <> '', 30D, 0D) "
         "+ coalesce(behaviour_score, 0D) * 0.6D + coalesce(cti_points, 0D) + coalesce(reputation_points, 0D))")


def rule_evidence(hits: DataFrame) -> DataFrame:
    """Rules of an event: at most one entry per rule, so the arrays stay short."""
    return hits.groupBy("event_id").agg(
        F.count("*").alias("n_rules"), F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"),
        F.array_join(F.sort_array(F.collect_set("technique")), ",").alias("techniques"),
        F.array_join(F.sort_array(F.collect_set("tactic")), ",").alias("tactics"),
        F.min("title").alias("rule_title"))


def sequence_evidence(sequences: DataFrame) -> DataFrame:
    return (sequences.select("sequence", F.explode("members").alias("event_id")).groupBy("event_id")
            .agg(F.array_join(F.sort_array(F.collect_set("sequence")), ",").alias("sequences")))


def evidence(events: DataFrame, rules: DataFrame, sequences: DataFrame, behaviour: DataFrame,
             cti: DataFrame, reputation: DataFrame) -> DataFrame:
    """One row per event. Every side is aggregated by event first, so each join is one to one."""
    joined = (events.select("event_id", "ts", "host", "user", "src_ip", "dst_ip", "category", "action", "command_line",
                            "process_name", "dst_port", "anomaly_score", "label", "attack_cat")
              .join(rules, "event_id", "left").join(sequences, "event_id", "left")
              .join(behaviour, "event_id", "left").join(cti, "event_id", "left")
              .join(reputation, "event_id", "left"))
    filled = joined.fillna(0, ["n_rules", "n_cti"]).fillna("", ["rules", "sequences", "techniques", "tactics"])
    return rated(filled.withColumn("entity", F.expr("coalesce(host, user, src_ip, 'unknown')")))


def rated(rows: DataFrame) -> DataFrame:
    """Status and combined score from the signals of each row."""
    return rows.withColumns({"detection_status": F.expr(STATUS), "hybrid_score": F.expr(SCORE)})


def reported(rows: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    return rows.where(F.col("hybrid_score") >= threshold)


def confirmed_entities(rows: DataFrame) -> DataFrame:
    """Entities with campaign infrastructure in the evidence of any of their events."""
    return rows.groupBy("entity").agg(
        F.bool_or(F.expr("coalesce(cti_campaign, false) or coalesce(reputation_campaign, false)")).alias("cti_confirmed"))

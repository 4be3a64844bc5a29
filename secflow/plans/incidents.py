"""Findings, incident clusters and their derived scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.functions import scalars as s
from secflow.operators.timeline import sessions
from secflow.schema import ANOMALY_THRESHOLD, TACTICS, normal_tactic, severity_score, tactic_index

FINDING = ["kind", "event_id", "ts", "entity", "rule_id", "severity", "confidence", "technique", "tactic", "title"]


def findings(hits: DataFrame, events: DataFrame, threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """Rule findings plus the anomalies that reach the threshold."""
    rules = hits.selectExpr("'rule' as kind", "event_id", "ts", "coalesce(host, 'unknown') as entity", "rule_id",
                            "severity", "confidence", "technique", "tactic", "title")
    odd = events.where(f"anomaly_score >= {threshold}").selectExpr(
        "'anomaly' as kind", "event_id", "ts", f"{s.entity()} as entity", "'anomaly' as rule_id",
        f"{s.anomaly_severity('anomaly_score')} as severity", "anomaly_score as confidence",
        "'unknown' as technique", "'unknown' as tactic", "'Anomalous behaviour' as title")
    return rules.unionByName(odd)


def clustered(found: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Findings of an entity, cut where the gap is longer than ``gap_seconds``."""
    return sessions(found, ["entity"], gap_seconds, tie=("event_id", "rule_id"))


def rollup(clusters: DataFrame) -> DataFrame:
    """One row per incident.

    Findings are first reduced to one row per (incident, technique, tactic), on the map side too, so
    the arrays below hold at most one entry per kind of rule, however many findings an incident has.
    """
    keys = ["entity", "session"]
    kinds = clusters.groupBy(*keys, "technique", "tactic").agg(
        F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"),
        F.max(severity_score("severity")).alias("sev"), F.sum("confidence").alias("conf"),
        F.min(F.struct("ts", "event_id", "rule_id")).alias("at"))
    ordered = "filter(array_distinct(transform(sort_array(collect_list(struct(at, {0}))), x -> x.{0})), v -> v not in ('unknown', ''))"
    lists = kinds.groupBy(*keys).agg(
        F.min("a").alias("start_ts"), F.max("b").alias("end_ts"), F.sum("n").alias("n_findings"),
        F.max("sev").alias("max_severity"), (F.sum("conf") / F.sum("n")).alias("mean_confidence"),
        F.expr(ordered.format("technique")).alias("techniques"), F.expr(ordered.format("tactic")).alias("tactics"))
    deepest = F.array_max(F.transform("tactics", lambda x: tactic_index(x)))
    ready = lists.withColumns({
        "incident_id": F.expr("concat(entity, '#', session)"),
        "deepest": F.coalesce(deepest, F.lit(-1)).cast("bigint"),
    }).withColumn("progress", F.expr(f"if(deepest >= 0, cast(deepest / {len(TACTICS)} * 100 as int), 0)"))
    return ready.withColumns({
        "risk": F.expr("cast(least(cast(0.5D * max_severity + 0.35D * progress + 0.15D * least(5 * n_findings, 30) "
                       "as int), 100) as bigint)"),
        "velocity": F.expr("case when end_ts = start_ts then 0D else n_findings / "
                           "((unix_micros(end_ts) - unix_micros(start_ts)) / 60e6D) end"),
    }).drop("progress")


def incidents(hits: DataFrame, events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    return rollup(clustered(findings(hits, events), gap_seconds))


def known_tactics(column: str = "tactics"):
    return F.transform(column, lambda x: normal_tactic(x))

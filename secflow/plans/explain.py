"""Texts built only from the evidence columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_TEXT = (
    "concat_ws(' ', "
    "if(n_rules > 0, concat('Rules matched: ', rules, '.'), 'No rule matched this event.'), "
    "if(anomaly_score >= 0.5, format_string('The anomaly model scores %.3f, above its boundary of 0.500.', anomaly_score), "
    "format_string('The anomaly model scores %.3f, below its boundary.', anomaly_score)), "
    "if(techniques <> '', concat('Techniques: ', techniques, ' (tactics: ', tactics, ').'), 'No technique is attached.'), "
    "if(sequences <> '', concat('Ordered pattern: ', sequences, '.'), null), "
    "if(n_cti > 0, concat('Threat intelligence matches: ', n_cti, '.'), 'No threat intelligence match.'), "
    "format_string('Combined score %.1f/100 (%s).', hybrid_score, detection_status))")


def explain_events(evidence: DataFrame) -> DataFrame:
    return evidence.selectExpr("event_id", f"{EVENT_TEXT} as explanation")


def explain_incidents(clusters: DataFrame, incidents: DataFrame, predictions: DataFrame) -> DataFrame:
    """Summary, reasoning and confidence per incident.

    Lines of evidence stay one row each (``evidence_lines``); gathering them into one cell would put
    an incident of any size into one row.
    """
    joined = incidents.join(predictions.select("incident_id", F.col("confidence").alias("_p"), "rationale"),
                            "incident_id", "left")
    return joined.selectExpr(
        "incident_id",
        "format_string('Incident on %s with %d finding(s), risk %d/100', entity, n_findings, risk) as summary",
        "concat(n_findings, ' findings between ', date_format(start_ts, 'yyyy-MM-dd HH:mm'), ' and ', "
        "date_format(end_ts, 'HH:mm'), ' UTC. Techniques: ', if(size(techniques) = 0, 'none', array_join(techniques, ', ')), '.') as reasoning",
        "coalesce(rationale, 'Not enough progression for a prediction.') as prediction",
        # Sums of the same findings in another order differ in their last digits.
        "round(0.6D * mean_confidence + 0.4D * coalesce(_p, 0.4D), 10) as confidence")


def evidence_lines(clusters: DataFrame, events: DataFrame) -> DataFrame:
    detail = events.select("event_id", "source", "command_line", "src_ip")
    return clusters.join(detail, "event_id").selectExpr(
        "concat(entity, '#', session) as incident_id", "event_id", "rule_id",
        "concat('[', date_format(ts, 'HH:mm:ss'), '] (', source, ') ', title, ' - conf. ', format_string('%.0f%%', bround(confidence * 100, 0)), "
        "case when command_line is not null then concat(' | cmd: ', left(command_line, 120)) "
        "when src_ip is not null then concat(' | src_ip: ', src_ip) else '' end) as line")

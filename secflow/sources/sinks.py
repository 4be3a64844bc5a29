"""Written tables: processed events, reports, models and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINGERPRINT_TIME = ("concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), if(unix_micros(ts) % 1000000 = 0, '', "
                    "concat('.', date_format(ts, 'SSSSSS'))), '+00:00')")
FINGERPRINT = (f"left(sha2(concat_ws('|', {FINGERPRINT_TIME}, coalesce(source, 'None'), coalesce(action, 'None'), "
               "coalesce(host, 'None'), coalesce(user, 'None'), coalesce(command_line, 'None')), 256), 16)")


def with_fingerprint(events: DataFrame) -> DataFrame:
    return events.withColumn("fingerprint", F.expr(FINGERPRINT))


def deduplicated(events: DataFrame) -> DataFrame:
    """The earliest event of each fingerprint; the smallest id decides among equals."""
    keep = with_fingerprint(events).groupBy("fingerprint").agg(F.min(F.struct("ts", "event_id")).alias("k"),
                                                              F.count("*").alias("copies"))
    return keep.select("fingerprint", F.col("k.event_id").alias("event_id"), "copies")


def processed_rows(evidence: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Summary row per event; only a reported one has an incident id."""
    return evidence.selectExpr(
        "event_id", "ts as event_time", "to_date(ts) as day", "entity", "detection_status as result",
        "hybrid_score as score", "anomaly_score", "rules", "techniques", "tactics", "n_cti as cti_matches",
        f"if(hybrid_score >= {threshold}, concat('E', event_id), null) as incident_id")


def write_processed(rows: DataFrame, path: str) -> None:
    """Partitioned by day, rows of a day together, so that a day is read without the others."""
    rows.repartition("day").write.mode("append").partitionBy("day").parquet(path)


def report_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def append_incidents(existing: DataFrame, delivered: DataFrame, key: str = "incident_id") -> DataFrame:
    """Delivered rows that are not stored yet, once each however often they were delivered."""
    return delivered.dropDuplicates([key]).join(existing.select(key), key, "left_anti")

"""Analyst decisions: consensus per detection and a leak-free training split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VALID = ("detection_id is not null and detection_id <> '' and analyst_id is not null and analyst_id <> '' "
         "and confidence between 0 and 1")


def consensus(decisions: DataFrame) -> DataFrame:
    """Latest decision per (detection, analyst); unanimous label, CONFLICT, or UNCERTAIN."""
    last = decisions.where(VALID).groupBy("detection_id", "analyst_id").agg(
        F.max(F.struct("created_at", "decision_id", "decision", "event_id", "ts")).alias("d"))
    votes = last.groupBy("detection_id").agg(
        F.count("*").alias("n_analysts"), F.max("d.event_id").alias("event_id"), F.max("d.ts").alias("ts"),
        F.min(F.expr("nullif(d.decision, 'UNCERTAIN')")).alias("_low"),
        F.max(F.expr("nullif(d.decision, 'UNCERTAIN')")).alias("_high"))
    return votes.withColumn("label", F.expr(
        "case when _low is null then 'UNCERTAIN' when _low = _high then _low else 'CONFLICT' end")).drop("_low", "_high")


def dataset(agreed: DataFrame, cutoff: str) -> DataFrame:
    """One decision per event, split by the time of the event against the cutoff."""
    clear = agreed.where("label not in ('CONFLICT', 'UNCERTAIN')").groupBy("event_id").agg(
        F.min(F.struct("detection_id", "label", "ts")).alias("d"))
    return clear.selectExpr(
        "event_id", "d.detection_id as detection_id", "d.label as label",
        f"case when d.ts < timestamp'{cutoff}' then 'train' when d.ts = timestamp'{cutoff}' then 'cutoff' else 'holdout' end as split")


def line_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as decisions: the order is the detection, the supplier picks the analyst."""
    return spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "concat(l_orderkey, '-', l_linenumber) as decision_id",
        "if(l_partkey % 50 = 0, '', concat('D', l_orderkey)) as detection_id", "l_orderkey div 3 as event_id",
        "cast(trunc(l_shipdate, 'MM') as timestamp) as ts",
        "case l_returnflag when 'A' then 'TRUE_POSITIVE' when 'R' then 'FALSE_POSITIVE' else 'UNCERTAIN' end as decision",
        "if(l_quantity > 48, 1.5D, l_discount * 10D) as confidence", "concat('A', l_suppkey % 3) as analyst_id",
        "cast(l_shipdate as timestamp) as created_at")

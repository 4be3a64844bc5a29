"""Entity risk that grows with each event and decays with time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.operators.blocks import block_scan
from secflow.operators.timeline import over_rows, timed_index
from secflow.plans.detection import first_rows

# Fixed values.
DECAY_PER_HOUR = 5.0
CEILING = 100.0
ALERT_AT = 70.0
INCREMENT = "greatest(hybrid_score / 3D, if(cti_confirmed, 60D, 0D))"


def _clamp(value: float, low: float, high: float) -> float:
    return min(high, max(low, value))


def risk_history(scored: DataFrame, block: int | None = None) -> DataFrame:
    """Score of the entity after each event (columns event_id, ts, entity, hybrid_score, cti_confirmed).

    Only events with a score above 0 are part of the history; the decay over the time between them is the same.

    One event turns a score s into ``clamp(s - decay + increment, increment, 100)``. Functions of
    that form compose into one of the same form, so a block is described by three numbers.
    """
    ranked = timed_index(scored.where("hybrid_score > 0").selectExpr("event_id", "ts", "entity", f"{INCREMENT} as increment"), ["entity"])
    spaced = over_rows(ranked, ["entity"], 1, {
        "hours": lambda w: F.coalesce(F.greatest(F.lit(0.0), (
            F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 3.6e9), F.lit(0.0))}, block=block)

    def describe(pdf: pd.DataFrame) -> list:
        shift, low, high = 0.0, 0.0, CEILING
        for add, hours in zip(pdf["increment"], pdf["hours"]):
            move = add - DECAY_PER_HOUR * hours
            shift, low, high = shift + move, _clamp(low + move, add, CEILING), _clamp(high + move, add, CEILING)
        return [shift, low, high]

    def advance(state: float, effect: list) -> float:
        return _clamp(state + effect[0], effect[1], effect[2])

    def compose(first: list, then: list) -> list:
        return [first[0] + then[0], *(_clamp(x + then[0], then[1], then[2]) for x in first[1:])]

    def step(score: float, add: float, hours: float):
        after = min(CEILING, max(0.0, score - DECAY_PER_HOUR * hours) + add)
        return after, (score, after)

    return block_scan(spaced, ["entity"], inputs=["increment", "hours"], step=step, start=0.0,
                      keep=["event_id", "ts", "entity"], outputs={"previous": "double", "score": "double"},
                      describe=describe, advance=advance, compose=compose, block=block)


def alerts(history: DataFrame) -> DataFrame:
    """Crossings from below to at least the alert level; a score that stays up does not alert again."""
    return history.where(f"previous < {ALERT_AT} and score >= {ALERT_AT}")


def latest(history: DataFrame) -> DataFrame:
    return history.groupBy("entity").agg(F.max(F.struct("ts", "event_id", "score")).alias("s")).select(
        "entity", F.col("s.ts").alias("ts"), F.col("s.score").alias("score"))


def risk_at(history: DataFrame, moment: str) -> DataFrame:
    """Last score of each entity, decayed to ``moment``."""
    return latest(history.where(f"ts <= timestamp'{moment}'")).withColumn("score_at", F.expr(
        f"greatest(0D, score - {DECAY_PER_HOUR}D * (unix_micros(timestamp'{moment}') - unix_micros(ts)) / 3.6e9D)"))


def recent_changes(history: DataFrame, limit: int = 20) -> DataFrame:
    return first_rows(history, ["entity"], [F.col("ts").desc(), F.col("event_id").desc()], limit)

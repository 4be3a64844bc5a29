"""Threat-intelligence joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.functions import predicates as p
from secflow.functions import scalars as s
from secflow.operators.lookups import as_of
from secflow.settings import small_side

FEEDS = ("report", "pulse")


def observables(events: DataFrame) -> DataFrame:
    """Addresses and hashes of each event, lower-cased, one row each."""
    hashes = "transform(coalesce(map_values(hashes), array()), h -> lower(h))" if "hashes" in events.columns else "array(lower(md5))"
    return events.selectExpr("event_id", "explode(array_distinct(array_compact(concat("
                             f"array(lower(src_ip), lower(dst_ip)), {hashes})))) as observable")


def live_values(indicators: DataFrame, as_of_ts: str) -> DataFrame:
    """Quoted values of the indicator patterns that are neither revoked nor expired."""
    return (indicators.where(f"not revoked and (valid_until is null or valid_until >= timestamp'{as_of_ts}')")
            .selectExpr("indicator_id", "labels", f"explode(array_distinct({s.ioc_values('pattern')})) as observable"))


def cti_hits(events: DataFrame, indicators: DataFrame, as_of_ts: str, counted: bool = False) -> DataFrame:
    """One row per (event, observable, indicator).

    ``counted``: one per (observable, indicator) with the number ``n`` of the events. Events are then counted per
    observable before they meet the indicators, so no pair of an event and an indicator is formed.
    """
    seen = observables(events)
    if counted:
        seen = seen.groupBy("observable").agg(F.count("*").alias("n"))
    return seen.join(small_side(live_values(indicators, as_of_ts)), "observable")


def related(relationships: DataFrame, targets: DataFrame, target_id: str, value: str, name: str) -> DataFrame:
    return (relationships.join(targets, F.col("target_ref") == F.col(target_id))
            .groupBy(F.col("source_ref").alias("indicator_id"))
            .agg(F.array_sort(F.collect_set(value)).alias(name)))


def indicator_context(indicators: DataFrame, relationships: DataFrame, actors: DataFrame,
                      patterns: DataFrame) -> DataFrame:
    """Actors and attack patterns per indicator; joined before the events, so once per indicator."""
    return (indicators
            .join(related(relationships, actors, "actor_id", "actor", "actors"), "indicator_id", "left")
            .join(related(relationships, patterns, "pattern_id", "pattern_name", "patterns"), "indicator_id", "left")
            .withColumn("actors", F.expr("coalesce(actors, array())"))
            .withColumn("patterns", F.expr("coalesce(patterns, array())")))


# Points per label group.
POINTS = ("case when arrays_overlap(labels, array('nation-state', 'c2')) "
          "or array_contains(transform(actors, a -> lower(a)), 'apt28') then 50D "
          "when arrays_overlap(labels, array('malicious', 'malware')) then 30D "
          "when array_contains(labels, 'anomalous-activity') then 15D "
          "when arrays_overlap(labels, array('benign_but_watched', 'spam')) then 5D else 10D end")


def observable_points(context: DataFrame, as_of_ts: str) -> DataFrame:
    """Points, number of indicators and campaign flag per observable value."""
    live = context.where(f"not revoked and (valid_until is null or valid_until >= timestamp'{as_of_ts}')")
    return (live.selectExpr(f"{POINTS} as points", "arrays_overlap(labels, array('nation-state', 'c2')) as campaign",
                            f"explode(array_distinct({s.ioc_values('pattern')})) as observable")
            .groupBy("observable").agg(F.sum("points").alias("points"), F.count("*").alias("n_indicators"),
                                       F.bool_or("campaign").alias("campaign")))


def event_points(events: DataFrame, context: DataFrame, as_of_ts: str) -> DataFrame:
    """CTI contribution per event. Indicators are added up per value first, so an event meets one row
    per observable however many indicators name it."""
    return (observables(events).join(small_side(observable_points(context, as_of_ts)), "observable")
            .groupBy("event_id").agg(F.sum("points").alias("cti_points"), F.sum("n_indicators").alias("n_cti"),
                                     F.bool_or("campaign").alias("cti_campaign")))


def live_reputation(events: DataFrame, signals: DataFrame, snapshots: DataFrame,
                    feeds: Sequence[str] = FEEDS) -> DataFrame:
    """Newest unexpired reputation per feed, for public sources of events that already show a signal."""
    asked = (events.join(signals.select("event_id").distinct(), "event_id", "left_semi")
             .where(p.public_ip("src_ip")).selectExpr("event_id", "ts", "host", "src_ip as observable"))
    found = as_of(asked, snapshots, "observable", "queried_at", feeds, "feed",
                  ["expires_at", "score", "malicious"])
    pairs = ", ".join(f"named_struct('feed', '{f}', 'hit', asof_{f})" for f in feeds)
    return (found.selectExpr("event_id", "ts", "host", "observable", f"explode(array({pairs})) as f")
            .where("f.hit.expires_at > ts")
            .selectExpr("event_id", "host", "observable", "f.feed as feed", "f.hit.score as score",
                        "f.hit.malicious as malicious"))


def reputation_points(live: DataFrame) -> DataFrame:
    return live.where("malicious").groupBy("event_id").agg(
        F.sum(F.expr("score / 100D * 40D")).alias("reputation_points"),
        F.bool_or(F.col("score") >= 75).alias("reputation_campaign"))


def reputation_text(live: DataFrame) -> DataFrame:
    """One sentence per malicious answer, joined with a bar."""
    return live.where("malicious").groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(F.expr(
        "format_string('%s reported by %s (score %.0f/100)', observable, feed, score)"))), " | ").alias("narrative"))

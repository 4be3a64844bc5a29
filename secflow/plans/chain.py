"""From normalised events to scored events and incidents, all joined by the events' own references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.plans import anomaly, cti
from secflow.plans import behaviour as b
from secflow.plans import detection as det
from secflow.plans import incidents as inc
from secflow.plans import scoring as sc
from secflow.settings import checkpointed


@dataclass
class Options:
    """Times of the rules and of an incident's gap, and the moment that indicators are judged at."""

    as_of: str
    volume: dict[str, tuple[int, int]] = field(default_factory=dict)
    windows: dict[str, int] = field(default_factory=dict)
    gap_seconds: int = 1800


def scored(events: DataFrame, model: dict, context: DataFrame, reputation: DataFrame,
           options: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence and score of every event, incidents, rule hits).

    ``events`` are referenced events (``sources/prepared``); the anomaly score comes from the stored ``model``.
    Records that are equal in every field are one event. Those without a time keep their score and stand for
    themselves in incidents.
    """
    once = checkpointed(events.dropDuplicates(["event_id"]))
    rated = checkpointed(anomaly.with_scores(once, model))
    hits = checkpointed(det.all_hits(rated, options.volume))
    behaviour = checkpointed(b.behaviour_scores(rated))
    signals = (hits.select("event_id").unionByName(behaviour.select("event_id"))
               .unionByName(rated.where(f"anomaly_score >= {sc.ANOMALY_THRESHOLD}").select("event_id")))
    live = cti.live_reputation(rated, signals, reputation)
    sequences = det.all_sequences(hits, options.windows)
    labels = {c: F.lit(None).cast(kind) for c, kind in (("label", "int"), ("attack_cat", "string")) if c not in rated.columns}
    evidence = sc.evidence(rated.withColumns(labels) if labels else rated, sc.rule_evidence(hits),
                           sc.sequence_evidence(sequences), behaviour,
                           cti.event_points(rated, context, options.as_of), cti.reputation_points(live))
    return evidence, inc.incidents(hits, rated, options.gap_seconds), hits

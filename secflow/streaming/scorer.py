"""The whole scoring of a micro-batch against stored state, so that batches in time order score as one run would.

State that a batch leaves for the next: counts and samples of the behaviour baselines, known values (each batch writes
its new ones only), the matches that a volume rule may still use, and the hits of ordered patterns that are still
open. A batch reads the state of the batch before and writes its own under its number, so a repeated batch
writes the same again.

Scored events and incidents are stores keyed by event: a batch writes rows under its number and the newest row of a
key counts. A pattern that completes in a later batch raises events of earlier ones, which are written again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.plans import behaviour as b
from secflow.plans import catalogue as cat
from secflow.plans import cti
from secflow.plans import detection as det
from secflow.plans import scoring as sc
from secflow.schema import ALERT_THRESHOLD
from secflow.settings import MICROS, checkpointed

HITS = ["event_id", "ts", "host", "rule_id", "title", "severity", "technique", "tactic", "confidence"]


def newest(spark, path: str, key: str = "event_id", before: int | None = None) -> DataFrame:  # noqa: ANN001
    """The newest row of each key of a store, of batches below ``before`` where that is given."""
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    kept = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), "batch").alias("r")).select("r.*")


@dataclass
class Scorer:
    """Handles micro-batches of events; ``folder`` holds the stores ``events`` and ``incidents`` and the state.

    ``context`` and ``reputation`` are read again for each batch. ``volume`` and ``windows`` override the times of
    the catalogue's volume and sequence rules.
    """

    folder: str
    context: Callable[[], DataFrame]
    reputation: Callable[[], DataFrame]
    as_of: str
    volume: dict[str, tuple[int, int]] = field(default_factory=dict)
    windows: dict[str, int] = field(default_factory=dict)
    view: Callable[[DataFrame], DataFrame] = lambda events: events
    threshold: float = ALERT_THRESHOLD

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _write(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        at = f"{self.path(name)}/batch={number}"
        rows.write.mode("overwrite").parquet(at)
        return rows.sparkSession.read.schema(rows.schema).parquet(at)

    def _before(self, batch: DataFrame, name: str, number: int, schema: str, every: bool = False) -> DataFrame:
        """State of the batch before (of ``every`` one before, for what only grows); empty at the start."""
        spark = batch.sparkSession
        if number == 0:
            return spark.createDataFrame([], schema)
        if every:
            return spark.read.parquet(self.path(name)).where(F.col("batch") < number).drop("batch")
        return spark.read.schema(schema).parquet(f"{self.path(name)}/batch={number - 1}")

    def _known(self, batch: DataFrame, number: int) -> b.Known:
        return b.Known(
            self._before(batch, "counts", number, "kind string, entity string, hour bigint, n bigint"),
            self._before(batch, "values", number, "kind string, entity string, value string", every=True),
            self._before(batch, "samples", number, "event_id bigint, ts timestamp, host string, bytes_out double"))

    def _volume_hits(self, batch: DataFrame, rule: cat.Rule, number: int) -> DataFrame:
        """Hits of a volume rule; the matches behind a group's last hit, a window's worth at most, stay open."""
        count, seconds = self.volume.get(rule.rule_id, (rule.count, rule.minutes * 60))
        fresh = det.volume_matches(batch, rule)
        name, groups = f"open_{rule.rule_id}", list(rule.group_by)
        matches = checkpointed(fresh.unionByName(self._before(
            batch, name, number, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fresh.schema))))
        hits = checkpointed(det.volume_rule_hits(batch, rule, count, seconds, matches))
        key = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})
        at = F.struct(F.col("ts"), F.col("event_id"))
        last = hits.join(matches.select("event_id", key.alias("_g")), "event_id").groupBy("_g").agg(F.max(at).alias("_last"))
        waiting = (matches.where("ts is not null").withColumn("_g", key).join(last, "_g", "left")
                   .where(F.col("_last").isNull() | (at > F.col("_last"))))
        left = det.first_rows(waiting, ["_g"], [F.desc("ts"), F.desc("event_id")], count - 1)
        self._write(left.select(*fresh.columns), name, number)
        return hits

    def _sequences(self, hits: DataFrame, number: int) -> DataFrame:
        """Completed patterns; the hits from an open start on stay, as long as its window may still be filled."""
        patterns = det.sequence_patterns(self.windows)
        fresh = det.sequence_parts(hits, patterns)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fresh.schema)
        rows, picked = det.sequence_scan(fresh.unionByName(self._before(hits, "open_hits", number, schema)), patterns)
        picked = checkpointed(picked)
        spans = hits.sparkSession.createDataFrame(
            [(name, seconds * MICROS) for name, (_, seconds) in patterns.items()], "sequence string, span bigint")
        opened = det.with_scalar(picked.where("not complete").join(F.broadcast(spans), "sequence"),
                                 hits.agg(F.max(F.unix_micros("ts")).alias("_now"))).where(
            "unix_micros(start_ts) + span >= _now").select("sequence", "_key", F.col("_idx").alias("_from"))
        left = rows.join(opened, ["sequence", "_key"]).where("_idx >= _from").select(*fresh.columns)
        self._write(left, "open_hits", number)
        return det.completed(picked)

    def __call__(self, batch: DataFrame, number: int) -> None:
        events = checkpointed(batch)
        known = self._known(events, number)
        hits = det.rule_matches(events).select(HITS)
        for rule in cat.VOLUME:
            hits = hits.unionByName(self._volume_hits(events, rule, number).select(HITS))
        hits = checkpointed(hits)
        behaviour = checkpointed(b.behaviour_scores(events, known))
        learnt = b.learnt(events, known)
        for name, rows in (("counts", learnt.counts), ("values", learnt.values), ("samples", learnt.samples)):
            self._write(rows, name, number)
        signals = (hits.select("event_id").unionByName(behaviour.select("event_id"))
                   .unionByName(events.where(f"anomaly_score >= {sc.ANOMALY_THRESHOLD}").select("event_id")))
        live = cti.live_reputation(self.view(events), signals, self.reputation())
        members = checkpointed(sc.sequence_evidence(self._sequences(hits, number)))
        rated = sc.evidence(events, sc.rule_evidence(hits), members, behaviour,
                            cti.event_points(events, self.context(), self.as_of), cti.reputation_points(live))
        if number:
            rated = rated.unionByName(self._raised(events, members, number))
        rows = self._write(rated, "events", number)
        self._write(sc.reported(rows, self.threshold), "incidents", number)

    def _raised(self, events: DataFrame, members: DataFrame, number: int) -> DataFrame:
        """Events of earlier batches that a pattern completed now has as members, rated again."""
        earlier = members.join(events.select("event_id"), "event_id", "left_anti").withColumnRenamed("sequences", "_more")
        stored = newest(events.sparkSession, self.path("events"), before=number).join(earlier, "event_id")
        both = "array_join(array_sort(array_distinct(filter(concat(split(sequences, ','), split(_more, ',')), x -> x <> ''))), ',')"
        return sc.rated(stored.withColumn("sequences", F.expr(both)).drop("_more"))

"""Streaming jobs run to the end over files made from the telemetry, and checked like batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from secflow.plans import catalogue as cat
from secflow.plans import cti
from secflow.plans.risk import INCREMENT
from secflow.queries import tables as t
from secflow.queries.campaigns import light
from secflow.queries.registry import Section
from secflow.queries.scoring import context, intel_tables, public_view
from secflow.queries.sources import _ANY, raw_json
from secflow.settings import checkpointed, work_path
from secflow.sources import intel
from secflow.sources.sinks import append_incidents
from secflow.sources.telemetry import telemetry
from secflow.streaming import jobs
from secflow.streaming.scorer import Scorer, newest

section = Section()
_TEL = t.with_(t.TEL)
#: Deliveries of the rows of a stream.
PARTS = 3
REFUSED = ("2024-01-11", "2024-01-21")


def cuts_of(rows, parts: int = PARTS) -> list[str]:
    """Times that cut the rows into parts of about the same size; any times give the same results."""
    at = rows.agg(F.percentile_approx(F.unix_micros("ts"), [i / parts for i in range(1, parts)]).alias("at")).first()["at"]
    return [f"timestamp_micros({x})" for x in sorted(set(at or []))]


def delivered(spark, rows, name: str, start, cuts: list[str] | None = None) -> None:
    """Deliver a table in time order and call ``start`` with the stream after each delivery.

    A delivery is a folder that keeps its partitions; ``start`` drains what is there and goes on from its
    checkpoint the next time, so each delivery is one micro-batch and a restart. Rows without a time come last.
    """
    rows, path = checkpointed(rows), work_path(spark, name)
    bounds = cuts_of(rows) if cuts is None else cuts
    for number, (low, high) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):
        tests = [f"ts >= {low}" if low else "true", f"ts < {high}" if high else "true"]
        missing = "" if high else " or ts is null"
        rows.where(f"({' and '.join(tests)}){missing}").write.parquet(f"{path}/{number:03d}")
        start(jobs.read_events(spark, path, rows.schema))


def stream_normalise(spark, sf):
    source, out, bad, mark = (work_path(spark, n) for n in ("raw", "documents", "quarantine", "mark"))
    raw_json(spark, sf, "true", _ANY).selectExpr("if(_keep_id % 30 = 0, concat('{broken', _keep_id), value) as value").repartition(3).write.text(source)
    jobs.run_batches(jobs.read_lines(spark, source), jobs.normalise(out, bad), mark)
    good = spark.read.parquet(out).groupBy("source", "class_uid").agg(F.count("*").alias("n"))
    return good.unionByName(spark.read.parquet(bad).groupBy("reason").agg(F.count("*").alias("n")).selectExpr(
        "reason as source", "cast(null as int) as class_uid", "n"))


section.add("stream_normalise", stream_normalise, f"""{_TEL} SELECT CASE WHEN k % 25 = 0 THEN 'sysmon' ELSE source END AS source, (CASE WHEN k % 25 = 0 THEN 1007 ELSE CASE category WHEN 'process' THEN 1007 WHEN 'authentication' THEN 3002 WHEN 'network' THEN 4001 ELSE 0 END END)::INT AS class_uid, count(*) AS n
FROM tel WHERE event_id % 30 <> 0 GROUP BY ALL UNION ALL SELECT 'invalid JSON', NULL, count(*) FROM tel WHERE event_id % 30 = 0""")


def stream_microbatch(spark, sf):
    rows = telemetry(spark, sf)
    events, found, mark = (work_path(spark, n) for n in ("events", "incidents", "mark"))
    delivered(spark, rows, "tel", lambda stream: jobs.run_batches(stream, jobs.detect(events, found), mark))
    return spark.read.parquet(events).join(spark.read.parquet(found).select("event_id", "confidence"), "event_id", "left").select(
        "event_id", "host", "n_rules", "confidence")


section.add("stream_microbatch", stream_microbatch, f"""{t.with_(t.TEL, f"h AS ({t.hits_sql(cat.PER_EVENT)})")}
SELECT event_id, tel.host, count(h.rule_id) AS n_rules, max(confidence) AS confidence FROM tel LEFT JOIN h USING (event_id) GROUP BY ALL""")


def stream_scores(spark, sf):
    """Every signal and the combined score, delivery by delivery against stored state."""
    folder, mark = work_path(spark, "scores"), work_path(spark, "mark")
    scorer = Scorer(folder, lambda: context(spark, sf), lambda: intel.reputation(spark, sf, t.REPUTATION_TTL), t.AS_OF,
                    t.VOLUME_WINDOWS, t.SEQUENCE_WINDOWS, public_view)
    delivered(spark, telemetry(spark, sf), "tel", lambda stream: jobs.run_batches(stream, scorer, mark))
    reported = newest(spark, scorer.path("incidents")).select("event_id", F.lit(True).alias("reported"))
    return newest(spark, scorer.path("events")).join(reported, "event_id", "left").selectExpr(
        "event_id", "entity", "detection_status", "rules", "sequences", "n_cti", "round(behaviour_score, 3) as behaviour_score",
        "round(hybrid_score, 3) as hybrid_score", "coalesce(reported, false) as reported")


section.add("stream_scores", stream_scores, f"""{t.evidence_base()} SELECT event_id, entity, detection_status, rules, sequences, n_cti,
round(behaviour_score, 3) AS behaviour_score, round(hybrid_score, 3) AS hybrid_score, hybrid_score >= 50 AS reported FROM ev""")


def stream_dead_letter(spark, sf):
    """The handler refuses every delivery that holds an event of the days REFUSED; deliveries are cut at those."""
    rows = telemetry(spark, sf).select("event_id", "ts", "host")
    good, dead, mark = (work_path(spark, n) for n in ("good", "dead", "mark"))

    def handle(batch, number):
        if not batch.where(f"ts >= timestamp'{REFUSED[0]}' and ts < timestamp'{REFUSED[1]}'").isEmpty():
            raise ValueError("delivery refused")
        jobs.written(batch, good, number)

    delivered(spark, rows, "tel", lambda stream: jobs.run_batches(stream, jobs.guarded(handle, dead), mark),
              [f"timestamp'{day}'" for day in REFUSED])
    return spark.read.parquet(good).selectExpr("event_id", "'stored' as state").unionByName(
        spark.read.parquet(dead).selectExpr("cast(get_json_object(record, '$.event_id') as bigint) as event_id", "reason as state"))


section.add("stream_dead_letter", stream_dead_letter, f"""{_TEL} SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21' THEN 'delivery refused' ELSE 'stored' END AS state FROM tel""")


def stream_baseline(spark, sf):
    events = telemetry(spark, sf)
    rows = events.selectExpr(
        "event_id", "ts", "cast(hour(ts) as int) as hour", "explode(array(named_struct('kind', 'user', 'entity', user, 'value', src_ip, 'volume', cast(null as double)), "
        "named_struct('kind', 'host', 'entity', host, 'value', process_name, 'volume', cast(bytes_out as double)))) as e").selectExpr(
        "event_id", "ts", "hour", "e.*").where("entity is not null")
    out, mark = work_path(spark, "deviations"), work_path(spark, "mark")
    delivered(spark, rows, "profile", lambda stream: jobs.run_to_table(jobs.baselines(stream), out, mark))
    return spark.read.parquet(out).selectExpr("event_id", "entity", "kind", "round(score, 3) as score", "round(confidence, 4) as confidence")


section.add("stream_baseline", stream_baseline, f"""{t.with_(t.TEL, t.USERS, t.HOSTS, t.DEVIATIONS)} SELECT event_id, entity, kind, round(score, 3) AS score, round(confidence, 4) AS confidence FROM dev""")


def stream_risk(spark, sf):
    rows = light(spark, sf).where("hybrid_score > 0").selectExpr("event_id", "ts", "entity", f"{INCREMENT} as increment")
    out, mark = work_path(spark, "risk"), work_path(spark, "mark")
    delivered(spark, rows, "scored", lambda stream: jobs.run_to_table(jobs.risk(stream), out, mark))
    return spark.read.parquet(out).selectExpr("event_id", "entity", "round(previous, 3) as previous", "round(score, 3) as score")


section.add("stream_risk", stream_risk, f"{t.light_base(t.RISK, recursive=True)} SELECT event_id, entity, round(previous, 3) AS previous, round(score, 3) AS score FROM rk")


def stream_volume_rule(spark, sf):
    rule = cat.VOLUME[0]
    rows = telemetry(spark, sf).where(cat.predicate(rule)).selectExpr("event_id", "ts", "to_json(struct(src_ip, user), map('ignoreNullFields', 'false')) as group")
    out, mark = work_path(spark, "volume"), work_path(spark, "mark")
    delivered(spark, rows, "matches", lambda stream: jobs.run_to_table(
        jobs.volume_rule(stream, *t.VOLUME_WINDOWS[rule.rule_id]), out, mark))
    return spark.read.parquet(out).select("event_id", "kind", "related")


section.add("stream_volume_rule", stream_volume_rule, f"{t.with_(t.TEL, t.volume_sql(cat.VOLUME[0], 'vol'), recursive=True)} SELECT event_id, 'hit' AS kind, related FROM vol")


def stream_dedup(spark, sf):
    """Every event is delivered twice within its delivery; the store also sees the same batch again."""
    rows = telemetry(spark, sf).select("event_id", "ts", "host")
    store, mark = work_path(spark, "store"), work_path(spark, "mark")
    delivered(spark, rows.unionByName(rows), "twice", lambda stream: jobs.run_to_table(
        jobs.deduplicated(stream), store, mark))
    stored = spark.read.parquet(store)
    again = append_incidents(stored, rows, "event_id")
    return stored.groupBy("host").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids")).unionByName(
        again.agg(F.lit("repeated").alias("host"), F.count("*").alias("n"), F.count_distinct("event_id").alias("ids")))


section.add("stream_dedup", stream_dedup, f"{_TEL} SELECT host, count(*) AS n, count(DISTINCT event_id) AS ids FROM tel GROUP BY 1 UNION ALL SELECT 'repeated', 0, 0")


def stream_cti(spark, sf):
    rows = telemetry(spark, sf).select("event_id", "ts", "src_ip", "dst_ip", "md5")
    out, mark = work_path(spark, "matches"), work_path(spark, "mark")
    handle = jobs.with_intel(lambda: cti.live_values(intel_tables(spark, sf)[0], t.AS_OF), out)
    delivered(spark, rows, "tel", lambda stream: jobs.run_batches(stream, handle, mark))
    return jobs.matches(spark, out).select("event_id", "observable", "indicator_id")


section.add("stream_cti", stream_cti, f"{t.with_(t.TEL, t.IOC)} SELECT event_id, observable, indicator_id FROM obs JOIN live USING (observable)")

"""Joins with threat intelligence, evidence per event and the combined score."""

from __future__ import annotations

from pyspark.sql import functions as F

from secflow.functions import scalars as s
from secflow.operators.lookups import first_in_window
from secflow.plans import anomaly
from secflow.plans import behaviour as b
from secflow.plans import catalogue as cat
from secflow.plans import cti
from secflow.plans import detection as det
from secflow.plans import scoring as sc
from secflow.queries import tables as t
from secflow.queries.detection import TECH, hits
from secflow.queries.registry import Section
from secflow.settings import checkpointed, work_path
from secflow.sources import intel
from secflow.sources.telemetry import telemetry

section = Section()
#: Events that the anomaly model is fitted on.
TRAIN = "label = 0 and event_id % 2 = 0"


def intel_tables(spark, sf):
    objects = intel.supplier_bundle(spark, sf)
    return (intel.indicators(objects), intel.relationships(objects), intel.actors(objects), intel.patterns(objects))


def context(spark, sf):
    return cti.indicator_context(*intel_tables(spark, sf))


def public_view(events):
    """The test tables use documentation addresses; this view makes them look public."""
    return events.withColumn("src_ip", F.expr("replace(src_ip, '203.0.113.', '8.8.8.')"))


def parts(spark, sf, events=None):
    """Signals of every kind, each aggregated by event."""
    events = telemetry(spark, sf) if events is None else events
    found = checkpointed(det.all_hits(events, t.VOLUME_WINDOWS))
    behaviour = checkpointed(b.behaviour_scores(events))
    signals = (found.select("event_id").unionByName(behaviour.select("event_id"))
               .unionByName(events.where("anomaly_score >= 0.602").select("event_id")))
    live = cti.live_reputation(public_view(events), signals, intel.reputation(spark, sf, t.REPUTATION_TTL))
    return events, found, behaviour, live


def evidence(spark, sf, events=None):
    events, found, behaviour, live = parts(spark, sf, events)
    sequences = det.all_sequences(found, t.SEQUENCE_WINDOWS)
    return sc.evidence(events, sc.rule_evidence(found), sc.sequence_evidence(sequences), behaviour,
                       cti.event_points(events, context(spark, sf), t.AS_OF), cti.reputation_points(live))


_EV = t.evidence_base()
section.add("hybrid_score", lambda spark, sf: evidence(spark, sf).selectExpr(
    "event_id", "entity", "detection_status", "rules", "sequences", "n_cti", "round(hybrid_score, 3) as hybrid_score"),
    f"{_EV} SELECT event_id, entity, detection_status, rules, sequences, n_cti, round(hybrid_score, 3) AS hybrid_score FROM ev")


def hybrid_score_model(spark, sf):
    """The combined score with the score of a fitted and stored forest; no SQL form, as the forest has none."""
    events, folder = telemetry(spark, sf), work_path(spark, "model")
    anomaly.fit(events, TRAIN, folder, t.FEATURE_WINDOW)
    scored = checkpointed(anomaly.with_scores(events, anomaly.load(spark, folder)))
    return evidence(spark, sf, scored).selectExpr(
        "event_id", "entity", "detection_status", "rules", "sequences", "n_cti", "round(anomaly_score, 6) as anomaly_score",
        "round(hybrid_score, 3) as hybrid_score")


section.add("hybrid_score_model", hybrid_score_model)
section.add("join_signals", lambda spark, sf: evidence(spark, sf).selectExpr(
    "event_id", "n_rules", "rules", "sequences", "round(behaviour_score, 3) as behaviour_score", "cti_points",
    "round(reputation_points, 3) as reputation_points"),
    f"""{_EV} SELECT event_id, n_rules, rules, sequences, round(behaviour_score, 3) AS behaviour_score, cti_points,
round(reputation_points, 3) AS reputation_points FROM ev""")
section.add("detection_status", lambda spark, sf: evidence(spark, sf).groupBy("detection_status", "category").agg(
    F.count("*").alias("n")), f"{_EV} SELECT detection_status, category, count(*) AS n FROM ev GROUP BY ALL")
section.add("findings_filter", lambda spark, sf: sc.reported(evidence(spark, sf)).selectExpr(
    "event_id", "entity", "round(hybrid_score, 3) as hybrid_score"),
    f"{_EV} SELECT event_id, entity, round(hybrid_score, 3) AS hybrid_score FROM ev WHERE hybrid_score >= 50")
section.add("cti_confirmed", lambda spark, sf: sc.confirmed_entities(evidence(spark, sf)),
            f"{_EV} SELECT entity, bool_or(coalesce(cti_campaign, FALSE) OR coalesce(reputation_campaign, FALSE)) AS cti_confirmed FROM ev GROUP BY 1")


def evidence_techniques(spark, sf):
    resolved = det.resolve_technique(hits(spark, sf)).select("event_id", "technique", "technique_tactic").distinct()
    return resolved.groupBy("event_id").agg(
        F.array_join(F.sort_array(F.collect_set("technique")), ",").alias("techniques"),
        F.array_join(F.sort_array(F.collect_set(F.expr("nullif(technique_tactic, 'unknown')"))), ",").alias("tactics"))


_HITS = t.with_(t.TEL, TECH, t.all_hits_sql(), recursive=True)
section.add("evidence_techniques", evidence_techniques, f"""{_HITS}
SELECT event_id, array_to_string(list_sort(list_distinct(list(technique))), ',') AS techniques,
  coalesce(array_to_string(list_sort(list_distinct(list(coalesce(a.tactic, b.tactic)))), ','), '') AS tactics
FROM hits LEFT JOIN tech a ON a.id = technique LEFT JOIN tech b ON b.id = split_part(technique, '.', 1) GROUP BY event_id""")

# --- joins --------------------------------------------------------------------------------------------
_IOC = t.with_(t.TEL, t.IOC)
section.add("join_cti_ioc", lambda spark, sf: cti.cti_hits(
    telemetry(spark, sf), intel_tables(spark, sf)[0], t.AS_OF).selectExpr(
    "event_id", "observable", "indicator_id", "array_join(labels, ',') as labels"),
    f"{_IOC} SELECT event_id, observable, indicator_id, label AS labels FROM obs JOIN live USING (observable)")


def join_cti_context(spark, sf):
    indicators, relationships, actors, patterns = intel_tables(spark, sf)
    found = cti.cti_hits(telemetry(spark, sf), indicators, t.AS_OF, counted=True).groupBy("indicator_id").agg(
        F.sum("n").alias("n_hits"))
    return found.join(cti.indicator_context(indicators, relationships, actors, patterns), "indicator_id").selectExpr(
        "indicator_id", "n_hits", "array_join(actors, ',') as actors", "array_join(patterns, ',') as patterns")


section.add("join_cti_context", join_cti_context, f"""{_IOC} SELECT indicator_id, count(*) AS n_hits, coalesce(any_value(actor), '') AS actors,
coalesce(any_value(pattern_name), '') AS patterns FROM obs JOIN live USING (observable) JOIN ctx USING (indicator_id) GROUP BY 1""")


section.add("join_reputation_ttl", lambda spark, sf: parts(spark, sf)[3].select("event_id", "observable", "feed", "score", "malicious"),
            f"{t.with_(t.TEL, t.all_hits_sql(), t.USERS, t.HOSTS, t.DEVIATIONS, t.REPUTATION, recursive=True)} SELECT event_id, observable, feed, score, malicious FROM rlive")
section.add("explain_reputation", lambda spark, sf: cti.reputation_text(parts(spark, sf)[3]),
            f"""{t.with_(t.TEL, t.all_hits_sql(), t.USERS, t.HOSTS, t.DEVIATIONS, t.REPUTATION, recursive=True)}
SELECT event_id, string_agg(s, ' | ' ORDER BY s) AS narrative FROM (SELECT event_id,
  observable || ' reported by ' || feed || ' (score ' || score::INT || '/100)' AS s FROM rlive WHERE malicious) GROUP BY 1""")


def semi_kev(spark, sf):
    """Vulnerability ids named in part comments of the catalogue side; part brands stand in for them."""
    catalogue = spark.read.parquet(f"{sf}/part.parquet").where("p_size <= 10").groupBy(
        F.upper("p_brand").alias("cve")).agg(F.count("*").alias("n_notes"), F.min("p_name").alias("detail"))
    seen = spark.read.parquet(f"{sf}/lineitem.parquet").join(
        spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey as l_partkey", "lower(p_brand) as cve_id"), "l_partkey")
    keyed = seen.groupBy("cve_id").agg(F.count("*").alias("n_events")).withColumn("cve", F.upper("cve_id"))
    exploited = keyed.join(catalogue.select("cve"), "cve", "left_semi")
    return exploited.join(catalogue, "cve", "left").select("cve", "cve_id", "n_events", "n_notes", "detail")


section.add("semi_kev", semi_kev, """WITH c AS (SELECT upper(p_brand) AS cve, count(*) AS n_notes, min(p_name) AS detail FROM part WHERE p_size <= 10 GROUP BY 1),
k AS (SELECT lower(p_brand) AS cve_id, count(*) AS n_events FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT cve, cve_id, n_events, n_notes, detail FROM k JOIN c ON cve = upper(cve_id)""")


def anti_unseen(spark, sf):
    events = telemetry(spark, sf)
    signals = hits(spark, sf).select("event_id").unionByName(b.deviations(events).select("event_id"))
    return events.where("anomaly_score < 0.602").join(signals.distinct(), "event_id", "left_anti").select(
        "event_id", "category", "host")


section.add("anti_unseen", anti_unseen, f"""{t.with_(t.TEL, t.all_hits_sql(), t.USERS, t.HOSTS, t.DEVIATIONS, recursive=True)}
SELECT event_id, category, host FROM tel WHERE anomaly_score < 0.602 AND event_id NOT IN (SELECT event_id FROM hits) AND event_id NOT IN (SELECT event_id FROM dev)""")
section.add("join_technique_dim", lambda spark, sf: det.resolve_technique(det.rule_matches(telemetry(spark, sf))).select(
    "event_id", "rule_id", "technique", "technique_name", "technique_tactic"),
    f"""{t.with_(t.TEL, TECH, f"h AS ({t.hits_sql(cat.PER_EVENT)})")} SELECT event_id, rule_id, technique,
coalesce(a.name, b.name, technique) AS technique_name, coalesce(a.tactic, b.tactic, 'unknown') AS technique_tactic
FROM h LEFT JOIN tech a ON a.id = technique LEFT JOIN tech b ON b.id = split_part(technique, '.', 1)""")

_EXEC = """exe AS (SELECT c_custkey AS exec_no, TIMESTAMP '2024-01-01' + to_seconds(c_custkey * 104729 % 2592000) AS ts, 'T' || (1000 + c_custkey % 40) AS technique,
  CASE WHEN c_custkey % 9 = 0 THEN '' ELSE ['SRV-', 'DB-', 'WKS-', 'PC-'][c_custkey % 4 + 1] || (c_custkey % 20) END AS host FROM customer)"""


def labelled(seconds):
    def run(spark, sf):
        events = telemetry(spark, sf).withColumn("host", F.expr("if(k % 11 = 0, null, host)"))
        marks = first_in_window(events, intel.executions(spark, sf), seconds)
        return events.select("event_id", "host").join(marks, "event_id", "left").selectExpr(
            "event_id", "host", "if(technique is null, 0, 1) as is_attack", "coalesce(technique, 'Normal') as technique")
    return run


def _label_sql(seconds):
    return f"""{t.with_(t.TEL, _EXEC, '''e AS (SELECT event_id, ts, CASE WHEN k % 11 = 0 THEN NULL ELSE host END AS host FROM tel)''',
f'''m AS (SELECT e.event_id, min(struct_pack(a := exe.ts, b := exec_no, c := technique)) AS f FROM e JOIN exe ON exe.ts <= e.ts AND e.ts <= exe.ts + to_seconds({seconds})
  AND (e.host IS NULL OR exe.host = '' OR exe.host = e.host) GROUP BY 1)''')}
SELECT event_id, host, CASE WHEN f IS NULL THEN 0 ELSE 1 END AS is_attack, coalesce(f.c, 'Normal') AS technique FROM e LEFT JOIN m USING (event_id)"""


section.add("label_interval_join", labelled(7200), _label_sql(7200))
section.add("range_label", labelled(86400), _label_sql(86400))

# --- intelligence functions -------------------------------------------------------------------------
section.add("fn_ioc_extract", lambda spark, sf: intel_tables(spark, sf)[0].selectExpr(
    "indicator_id", f"explode({s.ioc_values('pattern')}) as observable"),
    f"{_IOC} SELECT indicator_id, unnest(vals) AS observable FROM ind")
section.add("dim_stix_cti", lambda spark, sf: context(spark, sf).selectExpr(
    "indicator_id", "array_join(labels, ',') as labels", "revoked", "valid_until is not null as expires",
    "array_join(actors, ',') as actors", "array_join(patterns, ',') as patterns"),
    f"""{_IOC} SELECT indicator_id, label AS labels, revoked, valid_until IS NOT NULL AS expires, coalesce(actor, '') AS actors, coalesce(pattern_name, '') AS patterns FROM ctx""")


def fn_reputation_score(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey", "c_custkey * 7 % 101 as points", "c_custkey % 13 as pulses")
    report, pulse = s.report_feed("points"), s.pulse_feed("pulses")
    return c.selectExpr("c_custkey", f"{report['malicious']} as reported", f"{report['category']} as category",
                        f"{pulse['malicious']} as pulsed", f"{pulse['score']} as pulse_score")


section.add("fn_reputation_score", fn_reputation_score, """SELECT c_custkey, c_custkey * 7 % 101 >= 25 AS reported,
CASE WHEN c_custkey * 7 % 101 >= 75 THEN 'c2' WHEN c_custkey * 7 % 101 >= 25 THEN 'suspicious' END AS category,
c_custkey % 13 > 0 AS pulsed, least(c_custkey % 13 * 10, 100)::DOUBLE AS pulse_score FROM customer""")

section.add("dim_attack_from_stix", lambda spark, sf: intel.techniques(intel.part_objects(spark, sf)).selectExpr(
    "technique", "name", "array_join(tactics, ',') as tactics", "is_subtechnique", "parent"),
    """SELECT 'T' || (1000 + p_partkey) || CASE WHEN p_partkey % 4 = 0 THEN '.001' ELSE '' END AS technique, p_name AS name, 'phase-' || (p_size % 15) AS tactics, p_partkey % 4 = 0 AS is_subtechnique,
CASE WHEN p_partkey % 4 = 0 THEN 'T' || (1000 + p_partkey) END AS parent FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0""")
section.add("dim_attack_from_docs", lambda spark, sf: intel.technique_pages(intel.part_pages(spark, sf)).selectExpr(
    "technique", "name", "array_join(tactics, '|') as tactics", "array_join(platforms, '|') as platforms"),
    """SELECT 'T' || (1000 + p_partkey) AS technique, trim(p_name) AS name, trim(p_brand) || '|phase-' || (p_size % 15) AS tactics, 'Linux|' || trim(p_type) AS platforms FROM part WHERE p_partkey % 10 <> 0""")

"""Aggregations, store queries, lifecycle, feedback, audit and order-based splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from secflow.functions import scalars as s
from secflow.operators import sampling as sm
from secflow.plans import audit as au
from secflow.plans import detection as det
from secflow.plans import feedback as fb
from secflow.plans import operations as ops
from secflow.queries import tables as t
from secflow.queries.campaigns import light
from secflow.queries.registry import Section
from secflow.sources.telemetry import telemetry

section = Section()
_TEL = t.with_(t.TEL)

# --- aggregations -----------------------------------------------------------------------------------
section.add("agg_store_summary", lambda spark, sf: light(spark, sf).groupBy("outcome").agg(
    F.count("*").alias("total"), F.count_if(F.expr("hybrid_score >= 50")).alias("incidents"),
    F.count_if(F.expr("n_rules > 0")).alias("with_rule"), F.round(F.max("hybrid_score"), 3).alias("max_score")),
    f"""{t.light_base()} SELECT outcome, count(*) AS total, count(*) FILTER (WHERE hybrid_score >= 50) AS incidents,
count(*) FILTER (WHERE n_rules > 0) AS with_rule, round(max(hybrid_score), 3) AS max_score FROM light GROUP BY 1""")


def agg_incident_stats(spark, sf):
    store = ops.order_store(spark, sf)
    grouped = store.groupingSets([["state"], ["severity"], ["resolution"], []], "state", "severity", "resolution").agg(
        F.expr("case grouping_id() when 3 then 'state' when 5 then 'severity' when 6 then 'resolution' else 'all' end").alias("part"),
        F.count("*").alias("total"), F.count_if(F.expr("owner is null")).alias("unassigned"),
        F.count_if(F.expr("state <> 'resolved'")).alias("open"),
        F.count_if(F.expr("state <> 'resolved' and severity = 'critical'")).alias("critical_open"))
    stats = grouped.selectExpr("part", "coalesce(state, severity, resolution, '-') as name", "total", "unassigned", "open", "critical_open")
    top = (store.select(F.explode("techniques").alias("name")).groupBy("name").agg(F.count("*").alias("total"))
           .orderBy(F.col("total").desc(), "name").limit(10)
           .selectExpr("'technique' as part", "name", "total", "0L as unassigned", "0L as open", "0L as critical_open"))
    return stats.unionByName(top)


STORE = """sto AS MATERIALIZED (SELECT 'I' || o_orderkey AS incident_id, ['new', 'triaged', 'confirmed', 'false_positive', 'uncertain', 'resolved'][o_orderkey % 6 + 1] AS state,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN o_custkey % 3 <> 0 THEN 'analyst' || (o_custkey % 7) END AS owner,
  CASE WHEN o_orderkey % 6 = 5 THEN ['true_positive', 'false_positive', 'benign', 'duplicate'][o_custkey % 4 + 1] END AS resolution,
  round(o_totalprice % 100, 2) AS score, 'C' || o_custkey AS entity, ['T' || (1000 + o_custkey % 37), 'T' || (1000 + o_orderkey % 41)] AS techniques,
  o_orderdate::TIMESTAMP AS detected_at, 'Detection ' || o_orderstatus || ' - C' || o_custkey AS title FROM orders)"""
_STO = t.with_(STORE)
_CNT = "count(*) AS total, count(*) FILTER (WHERE owner IS NULL) AS unassigned, count(*) FILTER (WHERE state <> 'resolved') AS open, count(*) FILTER (WHERE state <> 'resolved' AND severity = 'critical') AS critical_open"
section.add("agg_incident_stats", agg_incident_stats, f"""{_STO} SELECT 'all' AS part, '-' AS name, {_CNT} FROM sto
UNION ALL SELECT 'state', state, {_CNT} FROM sto GROUP BY state UNION ALL SELECT 'severity', severity, {_CNT} FROM sto GROUP BY severity
UNION ALL SELECT 'resolution', coalesce(resolution, '-'), {_CNT} FROM sto GROUP BY resolution
UNION ALL (SELECT 'technique', x, count(*) AS c, 0, 0, 0 FROM (SELECT unnest(techniques) AS x FROM sto) GROUP BY x ORDER BY c DESC, x LIMIT 10)""")


def agg_service_metrics(spark, sf):
    rows = telemetry(spark, sf).selectExpr(
        "source", "case when k % 17 = 0 then 'rejected' when k % 23 = 0 then 'failed' else 'processed' end as status",
        "if(k % 17 = 0 or k % 23 = 0, left(concat('error on ', category, ' field ', k % 5, repeat('.', 200)), 120), null) as reason",
        "array_compact(array(if(k % 5 = 0, 'generated_id', null), if(k % 7 = 0, 'no_timestamp', null))) as notes")
    counts = rows.groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n")).selectExpr("'status' as part", "name", "n")
    notes = rows.select(F.explode("notes").alias("name")).groupBy("name").agg(F.count("*").alias("n")).selectExpr("'note' as part", "name", "n")
    reasons = (rows.where("reason is not null").groupBy(F.col("reason").alias("name")).agg(F.count("*").alias("n"))
               .orderBy(F.col("n").desc(), "name").limit(10).selectExpr("'reason' as part", "name", "n"))
    return counts.unionByName(notes).unionByName(reasons)


section.add("agg_service_metrics", agg_service_metrics, f"""{t.with_(t.TEL, '''r AS (SELECT CASE WHEN k % 17 = 0 THEN 'rejected' WHEN k % 23 = 0 THEN 'failed' ELSE 'processed' END AS status, k,
  left('error on ' || category || ' field ' || (k % 5) || repeat('.', 200), 120) AS reason FROM tel)''')}
SELECT 'status' AS part, status AS name, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'note', 'generated_id', count(*) FROM r WHERE k % 5 = 0
UNION ALL SELECT 'note', 'no_timestamp', count(*) FROM r WHERE k % 7 = 0
UNION ALL (SELECT 'reason', reason, count(*) AS n FROM r WHERE status <> 'processed' GROUP BY 2 ORDER BY n DESC, reason LIMIT 10)""")


def agg_percentiles(spark, sf):
    last = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice").orderBy(F.col("o_orderkey").desc()).limit(10000)
    return last.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"),
                    F.expr("percentile(o_totalprice, array(0.5, 0.95, 0.99))").alias("p"), F.max("o_totalprice").alias("max")
                    ).selectExpr("n", "mean", "round(p[0], 4) as p50", "round(p[1], 4) as p95", "round(p[2], 4) as p99", "max")


section.add("agg_percentiles", agg_percentiles, """SELECT count(*) AS n, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.95), 4) AS p95,
round(quantile_cont(x, 0.99), 4) AS p99, max(x) AS max FROM (SELECT o_totalprice::DOUBLE AS x FROM orders ORDER BY o_orderkey DESC LIMIT 10000)""")
section.add("agg_throughput", lambda spark, sf: telemetry(spark, sf).groupBy(F.window("ts", "6 hours")).agg(
    F.count("*").alias("n")).selectExpr("window.start as window_start", "n", "round(n / 21600, 8) as per_second",
                                        "round(n / 90, 6) as achieved", "n / 90 < 0.95 as saturated"),
    f"""{_TEL} SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, round(count(*) / 21600, 8) AS per_second,
round(count(*) / 90, 6) AS achieved, count(*) / 90 < 0.95 AS saturated FROM tel GROUP BY 1""")


def agg_attribution(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    phases = lines.groupBy(F.expr("concat('phase', l_suppkey % 5)").alias("phase")).agg(F.avg("l_quantity").alias("mean_ms"))
    total = lines.agg((F.avg("l_quantity") * 8).alias("service_ms"))
    known = phases.agg(F.sum("mean_ms").alias("known_ms"))
    rest = det.with_scalar(known, total).selectExpr("'unattributed' as phase", "greatest(service_ms - known_ms, 0D) as mean_ms")
    return det.with_scalar(phases.unionByName(rest), total).selectExpr(
        "phase", "round(mean_ms, 6) as mean_ms", "round(mean_ms / service_ms, 6) as share")


section.add("agg_attribution", agg_attribution, """WITH p AS (SELECT 'phase' || (l_suppkey % 5) AS phase, avg(l_quantity) AS m FROM lineitem GROUP BY 1), tt AS (SELECT avg(l_quantity) * 8 AS s FROM lineitem)
SELECT phase, round(m, 6) AS mean_ms, round(m / s, 6) AS share FROM (SELECT * FROM p UNION ALL SELECT 'unattributed', greatest((SELECT s FROM tt) - sum(m), 0) FROM p), tt""")

_STAGES = {"rules": "if(n_rules > 0, 'OK', 'NO_DATA')", "anomaly": "if(k % 29 = 0, 'UNAVAILABLE', 'OK')",
           "cti": "case when k % 31 = 0 then 'ERROR' when n_cti > 0 then 'OK' else 'NO_DATA' end",
           "retrieval": "'DISABLED'", "explain": "if(hybrid_score >= 50, 'OK', 'NO_DATA')"}


def agg_trace_status(spark, sf):
    stages = ", ".join(f"'{n}', {e}" for n, e in _STAGES.items())
    rows = light(spark, sf).selectExpr(f"explode(map({stages})) as (stage, status)")
    return rows.groupBy("stage", "status").agg(F.count("*").alias("n")).withColumn(
        "fallback", F.expr("status in ('UNAVAILABLE', 'ERROR')"))


_UN = " UNION ALL ".join(f"SELECT '{n}' AS stage, {e.replace('if(', 'if(')} AS status FROM light" for n, e in _STAGES.items())
section.add("agg_trace_status", agg_trace_status, f"""{t.light_base()} SELECT stage, status, count(*) AS n, status IN ('UNAVAILABLE', 'ERROR') AS fallback FROM ({_UN}) GROUP BY ALL""")

_SPLIT = "case event_id % 5 when 0 then 'test' when 1 then 'validation' else 'train' end"
section.add("agg_class_distribution", lambda spark, sf: telemetry(spark, sf).groupBy(F.expr(_SPLIT).alias("split")).agg(
    F.count_if(F.expr("label = 0")).alias("benign"), F.count_if(F.expr("label = 1")).alias("attack"), F.count("*").alias("total")),
    f"{_TEL} SELECT {_SPLIT} AS split, count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 1) AS attack, count(*) AS total FROM tel GROUP BY 1")

_PROFILE = ["ts_hour", "user", "src_ip", "dst_port", "command_line", "outcome"]


def agg_dataset_profile(spark, sf):
    rows = telemetry(spark, sf).selectExpr("date_trunc('day', ts) as ts_hour", "user", "src_ip", "dst_port", "command_line", "outcome", "label", "attack_cat")
    distinct = rows.groupBy(*_PROFILE, "label", "attack_cat").agg(F.count("*").alias("n"))
    return distinct.agg(
        F.sum("n").alias("rows"), F.lit(8).cast("bigint").alias("columns"), F.sum(F.expr("n - 1")).alias("duplicate_rows"),
        F.sum(F.expr("if(label = 1, n, 0)")).alias("attacks"), F.count_distinct("attack_cat").alias("categories"),
        F.round(F.sum(F.expr("n * (" + " + ".join(f"if({c} is null, 1, 0)" for c in _PROFILE) + ")")) / (F.sum("n") * 8), 6).alias("empty_ratio"))


section.add("agg_dataset_profile", agg_dataset_profile, f"""{t.with_(t.TEL, '''r AS (SELECT date_trunc('day', ts) AS d, "user", src_ip, dst_port, command_line, outcome, label, attack_cat FROM tel)''')}
SELECT count(*) AS rows, 8::BIGINT AS columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS duplicate_rows, count(*) FILTER (WHERE label = 1) AS attacks,
count(DISTINCT attack_cat) AS categories, round((6 * count(*) - count(d) - count("user") - count(src_ip) - count(dst_port) - count(command_line) - count(outcome)) / (count(*) * 8), 6) AS empty_ratio FROM r""")

_NUM = ["bytes_out", "bytes_in", "dst_port", "k", "label"]


def feature_stats(spark, sf):
    long = telemetry(spark, sf).selectExpr(f"{_SPLIT} as split", "stack(6, " + ", ".join(
        f"'{n}', cast({n} as double)" for n in _NUM) + ", 'constant', 1D) as (feature, x)")
    return long.groupBy("split", "feature").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


_STACK = " UNION ALL ".join([f"SELECT {_SPLIT} AS split, '{n}' AS feature, {n}::DOUBLE AS x FROM tel" for n in _NUM] + [f"SELECT {_SPLIT}, 'constant', 1 FROM tel"])
section.add("agg_feature_stats", lambda spark, sf: feature_stats(spark, sf).selectExpr(
    "split", "feature", "round(mean, 3) as mean", "round(std, 3) as std", "min", "max", "std < 1e-9 as constant"),
    f"{_TEL} SELECT split, feature, round(avg(x), 3) AS mean, round(stddev_pop(x), 3) AS std, min(x) AS min, max(x) AS max, stddev_pop(x) < 1e-9 AS constant FROM ({_STACK}) GROUP BY ALL")


def ml_drift(spark, sf):
    wide = feature_stats(spark, sf).groupBy("feature").pivot("split", ["train", "validation", "test"]).agg(
        F.round(F.max("mean"), 3).alias("mean"), F.round(F.max("std"), 3).alias("std"))
    return wide


section.add("ml_drift", ml_drift, f"""{_TEL} SELECT feature, {', '.join(f"round(avg(x) FILTER (WHERE split = '{p}'), 3) AS {p}_mean, round(stddev_pop(x) FILTER (WHERE split = '{p}'), 3) AS {p}_std" for p in ('train', 'validation', 'test'))}
FROM ({_STACK}) GROUP BY feature""")


def agg_feature_eligibility(spark, sf):
    stds = telemetry(spark, sf).agg(*[F.stddev_pop(F.col(n).cast("double")).alias(n) for n in _NUM], F.stddev_pop(F.lit(1.0)).alias("constant"))
    return stds.selectExpr("stack(6, " + ", ".join(f"'{n}', {n}" for n in [*_NUM, "constant"]) + ") as (feature, std)").selectExpr(
        "feature", "round(std, 3) as std", "coalesce(std > 1e-9, false) as informative")


section.add("agg_feature_eligibility", agg_feature_eligibility, f"""{_TEL}
SELECT feature, round(stddev_pop(x), 3) AS std, coalesce(stddev_pop(x) > 1e-9, FALSE) AS informative FROM (
{' UNION ALL '.join(f"SELECT '{n}' AS feature, {n}::DOUBLE AS x FROM tel" for n in _NUM)} UNION ALL SELECT 'constant', 1 FROM tel) GROUP BY 1""")


def agg_component_eligibility(spark, sf):
    has = telemetry(spark, sf).groupBy("source").agg(
        F.count("ts").alias("with_time"), F.count("dst_port").alias("with_port"), F.count("command_line").alias("with_command"),
        F.count("user").alias("with_user"))
    def status(test: str) -> str:
        return f"if({test}, 'EVALUABLE', 'NOT_EVALUABLE')"
    return has.selectExpr("source", f"stack(4, 'rules', {status('with_command > 0 or with_port > 0')}, 'sequences', {status('with_time > 0')}, "
                          f"'behaviour', {status('with_user > 0 and with_time > 0')}, 'flows', {status('with_port > 0')}) as (component, status)")


section.add("agg_component_eligibility", agg_component_eligibility, f"""{t.with_(t.TEL, 'h AS (SELECT source, count(ts) AS a, count(dst_port) AS b, count(command_line) AS c, count("user") AS d FROM tel GROUP BY 1)')}
SELECT source, component, CASE WHEN ok THEN 'EVALUABLE' ELSE 'NOT_EVALUABLE' END AS status FROM (SELECT source, 'rules' AS component, c > 0 OR b > 0 AS ok FROM h
UNION ALL SELECT source, 'sequences', a > 0 FROM h UNION ALL SELECT source, 'behaviour', d > 0 AND a > 0 FROM h UNION ALL SELECT source, 'flows', b > 0 FROM h)""")

DECISIONS = """dcs AS MATERIALIZED (SELECT l_orderkey || '-' || l_linenumber AS decision_id, CASE WHEN l_partkey % 50 = 0 THEN '' ELSE 'D' || l_orderkey END AS detection_id, l_orderkey // 3 AS event_id, date_trunc('month', l_shipdate)::TIMESTAMP AS ts,
  CASE l_returnflag WHEN 'A' THEN 'TRUE_POSITIVE' WHEN 'R' THEN 'FALSE_POSITIVE' ELSE 'UNCERTAIN' END AS decision, CASE WHEN l_quantity > 48 THEN 1.5 ELSE l_discount * 10 END::DOUBLE AS confidence,
  'A' || (l_suppkey % 3) AS analyst_id, l_shipdate::TIMESTAMP AS created_at FROM lineitem),
dl AS (SELECT detection_id, analyst_id, max(struct_pack(a := created_at, b := decision_id, c := decision, d := event_id, e := ts)) AS x FROM dcs WHERE detection_id <> '' AND confidence BETWEEN 0 AND 1 GROUP BY ALL),
cons AS MATERIALIZED (SELECT detection_id, count(*) AS n_analysts, max(x.d) AS event_id, max(x.e) AS ts,
  CASE WHEN count(*) FILTER (WHERE x.c <> 'UNCERTAIN') = 0 THEN 'UNCERTAIN' WHEN count(DISTINCT CASE WHEN x.c <> 'UNCERTAIN' THEN x.c END) > 1 THEN 'CONFLICT' ELSE max(CASE WHEN x.c <> 'UNCERTAIN' THEN x.c END) END AS label FROM dl GROUP BY 1)"""
_DCS = t.with_(DECISIONS)
section.add("agg_decisions", lambda spark, sf: fb.consensus(fb.line_decisions(spark, sf)).groupBy("label").agg(
    F.count("*").alias("n_detections"), F.count_distinct("event_id").alias("n_events"), F.sum("n_analysts").alias("n_votes")),
    f"{_DCS} SELECT label, count(*) AS n_detections, count(DISTINCT event_id) AS n_events, sum(n_analysts)::BIGINT AS n_votes FROM cons GROUP BY 1")
section.add("fb_consensus", lambda spark, sf: fb.consensus(fb.line_decisions(spark, sf)).select(
    "detection_id", "n_analysts", "event_id", "label"), f"{_DCS} SELECT detection_id, n_analysts, event_id, label FROM cons")
_CUT = "1995-06-01 00:00:00"
section.add("fb_dataset", lambda spark, sf: fb.dataset(fb.consensus(fb.line_decisions(spark, sf)), _CUT),
            f"""{_DCS} SELECT event_id, x.a AS detection_id, x.b AS label, CASE WHEN x.c < TIMESTAMP '{_CUT}' THEN 'train' WHEN x.c = TIMESTAMP '{_CUT}' THEN 'cutoff' ELSE 'holdout' END AS split
FROM (SELECT event_id, min(struct_pack(a := detection_id, b := label, c := ts)) AS x FROM cons WHERE label NOT IN ('CONFLICT', 'UNCERTAIN') GROUP BY 1)""")


def _digest_sql(fields):
    text = " || '|' || ".join(f"""coalesce("{f}"::VARCHAR, 'None')""" for f in fields)
    sums = " || '-' || ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4))
    return f"SELECT count(*) AS rows, sha256({sums}) AS digest FROM (SELECT sha256({text}) AS h FROM tel)"


_F1, _F2 = ["event_id", "source", "action", "host", "user", "command_line"], ["event_id", "src_ip", "dst_ip", "dst_port", "label"]


def agg_dataset_digest(spark, sf):
    events = telemetry(spark, sf)
    return au.table_digest(events, _F1).withColumn("fields", F.lit("who")).unionByName(
        au.table_digest(events, _F2).withColumn("fields", F.lit("flow")))


section.add("agg_dataset_digest", agg_dataset_digest, f"{_TEL} SELECT *, 'who' AS fields FROM ({_digest_sql(_F1)}) UNION ALL SELECT *, 'flow' FROM ({_digest_sql(_F2)})")

# --- store queries ------------------------------------------------------------------------------------
_ORD = "state = 'resolved', CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, detected_at DESC, incident_id"
section.add("sort_incident_queue", lambda spark, sf: ops.queue_page(ops.order_store(spark, sf), 500, 40).select(
    "incident_id", "state", "severity", "detected_at", "total"),
    f"{_STO} SELECT incident_id, state, severity, detected_at, (SELECT count(*) FROM sto) AS total FROM sto ORDER BY {_ORD} LIMIT 200 OFFSET 40")
section.add("filter_incidents", lambda spark, sf: ops.filtered(
    ops.order_store(spark, sf), severity="high", unassigned=True, technique="T1005", since="1993-01-01", text="DETECTION f").unionByName(
    ops.filtered(ops.order_store(spark, sf), state="triaged", owner="analyst2", text="c1")).select("incident_id", "state", "owner", "entity"),
    f"""{_STO} SELECT incident_id, state, owner, entity FROM sto WHERE severity = 'high' AND owner IS NULL AND list_contains(techniques, 'T1005') AND detected_at >= '1993-01-01'
  AND (title ILIKE '%DETECTION f%' OR entity ILIKE '%DETECTION f%' OR incident_id ILIKE '%DETECTION f%' OR state ILIKE '%DETECTION f%')
UNION ALL SELECT incident_id, state, owner, entity FROM sto WHERE state = 'triaged' AND owner = 'analyst2' AND (title ILIKE '%c1%' OR entity ILIKE '%c1%' OR incident_id ILIKE '%c1%' OR owner ILIKE '%c1%' OR state ILIKE '%c1%')""")
section.add("topk_incidents", lambda spark, sf: light(spark, sf).where("hybrid_score >= 50").orderBy(
    F.col("hybrid_score").desc(), "event_id").limit(25).selectExpr("event_id", "entity", "round(hybrid_score, 3) as hybrid_score"),
    f"{t.light_base()} SELECT event_id, entity, round(hybrid_score, 3) AS hybrid_score FROM light WHERE hybrid_score >= 50 ORDER BY light.hybrid_score DESC, event_id LIMIT 25")

CHANGES = """chg AS MATERIALIZED (SELECT l_orderkey AS incident_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS seq,
  CASE WHEN l_suppkey % 8 < 6 THEN ['new', 'triaged', 'confirmed', 'false_positive', 'uncertain', 'resolved'][l_suppkey % 8 + 1] WHEN l_suppkey % 8 = 7 THEN 'archived' END AS state,
  CASE l_partkey // 3 % 5 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'benign' WHEN 2 THEN 'duplicate' WHEN 3 THEN 'because' END AS resolution,
  CASE WHEN l_partkey % 4 = 0 THEN 'analyst' || (l_partkey % 7) END AS owner, CASE l_partkey % 10 WHEN 0 THEN 'high' WHEN 5 THEN 'low' WHEN 7 THEN 'urgent' END AS severity FROM lineitem)"""
_OK = """list_contains(CASE r.st WHEN 'new' THEN ['triaged', 'confirmed', 'false_positive', 'uncertain', 'resolved'] WHEN 'triaged' THEN ['confirmed', 'false_positive', 'uncertain', 'resolved', 'new']
  WHEN 'resolved' THEN ['triaged'] ELSE ['resolved', 'triaged'] END, c.state)"""
LIFE = f"""lif AS (SELECT incident_id, 0 AS seq, 'new' AS before, 'new' AS st, '' AS error, NULL::VARCHAR AS resolution, NULL::VARCHAR AS owner, NULL::VARCHAR AS severity FROM chg WHERE seq = 1
 UNION ALL SELECT c.incident_id, c.seq, r.st, CASE WHEN e.error = '' AND c.state IS NOT NULL THEN c.state ELSE r.st END, e.error,
   CASE WHEN e.error = '' AND (c.state = 'resolved' OR (c.state IS NULL AND r.st = 'resolved')) THEN c.resolution END, c.owner, c.severity
 FROM lif r JOIN chg c ON c.incident_id = r.incident_id AND c.seq = r.seq + 1,
 LATERAL (SELECT CASE WHEN c.state = 'archived' THEN 'unknown state' WHEN c.state IS NOT NULL AND c.state <> r.st AND NOT {_OK} THEN 'transition not allowed'
   WHEN c.state = 'resolved' AND r.st <> 'resolved' AND NOT coalesce(c.resolution IN ('true_positive', 'false_positive', 'benign', 'duplicate'), FALSE) THEN 'resolution needed'
   WHEN c.severity = 'urgent' THEN 'unknown severity' ELSE '' END AS error) e)"""
_LIF = t.with_(CHANGES, LIFE, recursive=True)
section.add("timeline", lambda spark, sf: ops.lifecycle(ops.line_changes(spark, sf)).where("error = ''").select(
    "incident_id", "seq", "state_before", "state_after"),
    f"{_LIF} SELECT incident_id, seq, before AS state_before, st AS state_after FROM lif WHERE seq > 0 AND error = ''")
section.add("incident_lifecycle", lambda spark, sf: ops.final_states(ops.lifecycle(ops.line_changes(spark, sf))),
            f"""{_LIF} SELECT incident_id, max_by(st, seq) AS state, max_by(owner, seq) FILTER (WHERE error = '' AND owner IS NOT NULL) AS owner,
max_by(severity, seq) FILTER (WHERE error = '' AND severity IS NOT NULL) AS severity,
CASE WHEN max_by(st, seq) = 'resolved' THEN max_by(resolution, seq) FILTER (WHERE error = '' AND st = 'resolved' AND before <> 'resolved') END AS resolution,
count(*) FILTER (WHERE error <> '') AS rejected FROM lif WHERE seq > 0 GROUP BY 1""")


def triage_decisions(spark, sf):
    acts = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_linenumber", "case l_partkey % 5 when 0 then 'CONFIRM' when 1 then 'REJECT' when 2 then 'UNCERTAIN' when 3 then 'COMMENT' else 'DELETE' end as action")
    return ops.triage(acts).groupBy("action", "decision", "target_state", "note_only", "rejected").agg(F.count("*").alias("n"))


section.add("triage_decisions", triage_decisions, """SELECT action, d.decision, d.target_state, action = 'COMMENT' AS note_only, action = 'DELETE' AS rejected, count(*) AS n FROM (
SELECT CASE l_partkey % 5 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'UNCERTAIN' WHEN 3 THEN 'COMMENT' ELSE 'DELETE' END AS action FROM lineitem)
LEFT JOIN (VALUES ('CONFIRM', 'TRUE_POSITIVE', 'confirmed'), ('REJECT', 'FALSE_POSITIVE', 'false_positive'), ('UNCERTAIN', 'UNCERTAIN', 'uncertain')) d(a, decision, target_state) ON a = action GROUP BY ALL""")

# --- audit --------------------------------------------------------------------------------------------
from secflow.operators.timeline import row_index  # noqa: E402


def audit_rows(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_custkey as run", "o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') as at", "concat('Clerk', o_custkey % 10) as actor",
        "concat('set_', lower(o_orderstatus)) as action", "o_orderpriority as detail")
    return row_index(orders, ["run"], [F.col("o_orderkey")], F.expr("o_orderkey div 1000000"), "idx")


AUDIT = f"""ar AS MATERIALIZED (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, strftime(o_orderdate, '%Y-%m-%d') AS stamp, 'Clerk' || (o_custkey % 10) AS actor, 'set_' || lower(o_orderstatus) AS action, o_orderpriority AS detail FROM orders),
ch AS (SELECT run, idx, '{au.GENESIS}' AS prev_hash, sha256('{{"action":"' || action || '","actor":"' || actor || '","detail":"' || detail || '","index":' || idx || ',"prev_hash":"{au.GENESIS}","timestamp":"' || stamp || '"}}') AS entry_hash FROM ar WHERE idx = 0
 UNION ALL SELECT ar.run, ar.idx, ch.entry_hash, sha256('{{"action":"' || ar.action || '","actor":"' || ar.actor || '","detail":"' || ar.detail || '","index":' || ar.idx || ',"prev_hash":"' || ch.entry_hash || '","timestamp":"' || ar.stamp || '"}}') FROM ch JOIN ar ON ar.run = ch.run AND ar.idx = ch.idx + 1)"""
_AUD = t.with_(AUDIT, recursive=True)
section.add("win_hash_chain_build", lambda spark, sf: au.build_chain(audit_rows(spark, sf)).select("run", "idx", "prev_hash", "entry_hash"),
            f"{_AUD} SELECT run, idx, prev_hash, entry_hash FROM ch")


def win_hash_chain_verify(spark, sf):
    chained = au.build_chain(audit_rows(spark, sf))
    tampered = chained.where("not (run % 11 = 0 and idx = 3)").withColumns({
        "detail": F.expr("if(run % 7 = 0 and idx = 2, 'edited', detail)"),
        "prev_hash": F.expr("if(run % 13 = 0 and idx = 1, repeat('f', 64), prev_hash)")})
    return au.verify_chain(tampered, au.anchors(chained)).select("run", "bad_index", "reason", "valid")


section.add("win_hash_chain_verify", win_hash_chain_verify, f"""{_AUD[:-1]},
sz AS (SELECT run, count(*) AS n FROM ar GROUP BY 1),
ev AS (SELECT run, n, CASE WHEN run % 7 = 0 AND n > 2 THEN 2 END AS e, CASE WHEN run % 13 = 0 AND n > 1 THEN 1 END AS l, CASE WHEN run % 11 = 0 AND n > 4 THEN 4 END AS g, run % 11 = 0 AND n = 4 AS cut FROM sz)
SELECT run, least(e, l, g)::BIGINT AS bad_index, CASE WHEN least(e, l, g) IS NOT NULL THEN CASE WHEN least(e, l, g) = e THEN 'changed entry' ELSE 'broken link' END WHEN cut THEN 'truncated' END AS reason,
least(e, l, g) IS NULL AND NOT cut AS valid FROM ev""")

def win_hash_chain_seal(spark, sf):
    sealed = au.seal(au.anchors(au.build_chain(audit_rows(spark, sf), 3)))
    ends = sealed.groupBy("run").agg(F.count("*").alias("segments"), F.max_by("link", "segment").alias("link"))
    broken = sealed.where("not (run % 11 = 0 and segment = 1)").withColumn("last_hash", F.expr("if(run % 7 = 0 and segment = 0, repeat('0', 64), last_hash)"))
    return sealed.select("run", "segment", "rows", "link").join(au.verify_seal(broken, ends), "run")


section.add("win_hash_chain_seal", win_hash_chain_seal, f"""{t.with_(AUDIT.replace("|| ch.entry_hash ||", "|| CASE WHEN ar.idx % 3 = 0 THEN '" + au.GENESIS + "' ELSE ch.entry_hash END ||"), "anc AS MATERIALIZED (SELECT run, idx // 3 AS segment, count(*) AS rows, max_by(entry_hash, idx) AS last_hash FROM ch GROUP BY ALL)",
 "sl AS (SELECT run, segment, rows, sha256('" + au.GENESIS + "|0|' || rows || '|' || last_hash) AS link FROM anc WHERE segment = 0 UNION ALL SELECT anc.run, anc.segment, anc.rows, sha256(sl.link || '|' || anc.segment || '|' || anc.rows || '|' || anc.last_hash) FROM sl JOIN anc ON anc.run = sl.run AND anc.segment = sl.segment + 1)", recursive=True)}
SELECT run, segment, rows, link, CASE WHEN run % 7 = 0 THEN 0 WHEN run % 11 = 0 AND n > 2 THEN 2 END::BIGINT AS bad_segment, run % 7 <> 0 AND (run % 11 <> 0 OR n < 2) AS valid FROM sl JOIN (SELECT run, count(*) AS n FROM anc GROUP BY 1) USING (run)""")

# --- splits and samples ---------------------------------------------------------------------------------
section.add("win_time_split", lambda spark, sf: sm.time_split(telemetry(spark, sf)).select("event_id", "split"),
            f"""{_TEL} SELECT event_id, CASE WHEN i < trunc(n * 0.6::DOUBLE) THEN 'train' WHEN i < trunc(n * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM tel)""")
section.add("win_systematic_sample", lambda spark, sf: sm.systematic_sample(telemetry(spark, sf), "source", 300).select("event_id", "source"),
            f"""{_TEL} SELECT event_id, source FROM (SELECT event_id, source, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM tel) WHERE i % greatest(1, n // 300) = 0""")
section.add("win_evaluable_window", lambda spark, sf: sm.evaluable_window(telemetry(spark, sf)).groupBy("kept", "label", "attack_cat").agg(
    F.count("*").alias("n"), F.max("ts").alias("last_ts")),
    f"{_TEL} SELECT ts <= (SELECT max(ts) FROM tel WHERE label = 1) AS kept, label, attack_cat, count(*) AS n, max(ts) AS last_ts FROM tel GROUP BY ALL")

# --- text functions -------------------------------------------------------------------------------------
section.add("fn_title", lambda spark, sf: light(spark, sf).selectExpr("event_id", f"{s.incident_title('nullif(rules, \"\")')} as title"),
            f"""{t.light_base()} SELECT event_id, left(CASE WHEN rules <> '' THEN rules WHEN anomaly_score >= 0.602 THEN 'Anomaly without a rule' ELSE 'Detection' END || ' - ' || entity, 200) AS title FROM light""")
section.add("fn_sanitize", lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
    "doc_id", "concat('</Untrusted >', char(7), text) as text").selectExpr("doc_id", f"md5(cast({s.sanitized('text')} as binary)) as safe"),
    """SELECT doc_id, md5(CASE WHEN length(c) > 500 THEN left(c, 500) || '...[cut]' ELSE c END) AS safe FROM (SELECT doc_id, regexp_replace(regexp_replace('</Untrusted >' || chr(7) || text, '</?\\s*untrusted\\s*>', '[tag removed]', 'gi'), '[\\x00-\\x09\\x0b-\\x1f]', '', 'g') AS c FROM documents)""")
section.add("fn_json_cap", lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
    "doc_id", f"{s.capped_json('text', 4000)} as j", "left(text, 8000) as n", "length(text) as len").selectExpr(
    "doc_id", "coalesce(get_json_object(j, '$.truncated') = 'true', false) and len > 4000 as truncated",
    "if(len > 4000, cast(get_json_object(j, '$.original_length') as bigint), cast(len as bigint)) as original_length",
    "md5(cast(if(len > 4000, get_json_object(j, '$.preview'), j) as binary)) as body", "cast(length(n) as bigint) as narrative"),
    """SELECT doc_id, length(text) > 4000 AS truncated, length(text) AS original_length, md5(left(text, 4000)) AS body, least(length(text), 8000) AS narrative FROM documents""")

"""Predicates, rules, volume rules and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from secflow.functions import predicates as p
from secflow.plans import catalogue as cat
from secflow.plans import detection as det
from secflow.queries import tables as t
from secflow.queries.registry import Section
from secflow.sources.telemetry import telemetry

section = Section()

# --- predicates: (key, column, check text, shown columns) ----------------------------------------
_PREDICATES = [
    ("pred_equals", lambda: p.equals("outcome", "FAILURE"), "lower(outcome) = 'failure'", ["outcome"]),
    ("pred_in", lambda: p.one_of("dst_port", [4444, 443, "22"]), "dst_port IN (4444, 443, 22)", ["dst_port"]),
    ("pred_contains", lambda: p.contains("command_line", "SchTasks"),
     "lower(command_line) LIKE '%schtasks%'", ["command_line"]),
    ("pred_contains_any", lambda: p.contains_any("command_line", ["nmap", "WMIC", "k=9"]),
     "lower(command_line) LIKE '%nmap%' OR lower(command_line) LIKE '%wmic%' OR lower(command_line) LIKE '%k=9%'",
     ["command_line"]),
    ("pred_regex", lambda: p.matches("command_line", cat.POWERSHELL),
     f"regexp_matches(command_line, {t.sql_text(cat.POWERSHELL)}, 'i')", ["command_line"]),
    ("pred_not_regex", lambda: p.not_matches("command_line", "EXE"),
     "command_line IS NULL OR NOT regexp_matches(command_line, 'EXE', 'i')", ["command_line"]),
    ("pred_gt_lt", lambda: p.any_of([p.compare("bytes_out", "gt", 104857600), p.compare("outcome", "lt", 300)]),
     "bytes_out > 104857600 OR TRY_CAST(outcome AS DOUBLE) < 300", ["bytes_out", "outcome"]),
    ("pred_sigma_string", lambda: p.any_of([p.wildcard("process_name", "c:\\bin\\*.EXE"), p.wildcard("dst_ip", "10.1.0.?")]),
     "regexp_full_match(lower(process_name), 'c:\\\\bin\\\\.*\\.exe') OR regexp_full_match(dst_ip, '10\\.1\\.0\\..')",
     ["process_name", "dst_ip"]),
    ("pred_sigma_modifiers", lambda: p.any_of([
        p.contains_all("command_line", ["REG ", "add", "\\run"]), p.starts_with("src_ip", ["203.0.", "172.16."]),
        p.ends_with("process_name", ["hh.exe", "WHOAMI.exe"]), p.one_of("dst_port", [9050, 9051])]),
     "(lower(command_line) LIKE '%reg %' AND lower(command_line) LIKE '%add%' AND contains(lower(command_line), '\\run'))"
     " OR src_ip LIKE '203.0.%' OR src_ip LIKE '172.16.%' OR lower(process_name) LIKE '%hh.exe'"
     " OR lower(process_name) LIKE '%whoami.exe' OR dst_port IN (9050, 9051)",
     ["command_line", "process_name", "src_ip"]),
    ("pred_sigma_numeric", lambda: p.any_of([
        p.compare("dst_port", "eq", 443), p.compare("outcome", "gte", 404), p.compare("bytes_in", "lte", 5),
        p.compare("outcome", "neq", 200)]),
     "dst_port = 443 OR TRY_CAST(outcome AS DOUBLE) >= 404 OR bytes_in <= 5 OR TRY_CAST(outcome AS DOUBLE) <> 200",
     ["dst_port", "bytes_in", "outcome"]),
    ("pred_bool_tree", lambda: p.all_of([
        p.any_of([p.equals("outcome", "failure"), p.contains("command_line", "net ")]),
        p.negate(p.all_of([p.starts_with("user", ["u1"]), p.negate(p.equals("parent_process", "explorer.exe"))]))]),
     """(outcome = 'failure' OR coalesce(lower(command_line) LIKE '%net %', FALSE))
        AND NOT (coalesce("user" LIKE 'u1%', FALSE) AND NOT coalesce(parent_process = 'explorer.exe', FALSE))""",
     ["user", "parent_process", "outcome"]),
    ("pred_category_gate", lambda: p.all_of([p.equals("category", "network"), p.one_of("dst_port", [3389, 9050])]),
     "category = 'network' AND dst_port IN (3389, 9050)", ["category", "dst_port"]),
    ("pred_private_ip", lambda: p.all_of([p.private_ip("src_ip"), p.private_ip("dst_ip")]),
     "src_ip LIKE '10.%' AND dst_ip LIKE '10.%'", ["src_ip", "dst_ip"]),
    ("pred_public_ip", lambda: p.any_of([
        p.public_ip("replace(src_ip, '203.0.113', '8.8.8')"), p.public_ip("dst_ip")]), "src_ip LIKE '203.0.113.%'", ["src_ip", "dst_ip"]),
]
for _key, _column, _where, _shown in _PREDICATES:
    section.add(
        _key,
        lambda spark, sf, column=_column, shown=_shown: (
            telemetry(spark, sf).where(column()).select("event_id", *shown)),
        f"{t.with_(t.TEL)} SELECT event_id, {', '.join(f'{chr(34)}{c}{chr(34)}' for c in _shown)} FROM tel WHERE {_where}")


# --- rules ------------------------------------------------------------------------------------
def rule_match(spark, sf):
    return det.rule_matches(telemetry(spark, sf)).select("event_id", "rule_id", "severity", "technique", "tactic")


section.add("rule_match", rule_match, f"""{t.with_(t.TEL, f"h AS ({t.hits_sql(cat.PER_EVENT)})")}
SELECT event_id, rule_id, severity, technique, tactic FROM h""")

section.add(
    "rule_confidence",
    lambda spark, sf: det.rule_matches(telemetry(spark, sf)).groupBy("rule_id", "severity", "confidence").agg(
        F.count("*").alias("n")),
    f"""{t.with_(t.TEL, f"h AS ({t.hits_sql(cat.PER_EVENT)})")}
SELECT rule_id, severity, least(0.5 + CASE severity WHEN 'low' THEN 25 WHEN 'medium' THEN 50 WHEN 'high' THEN 75
  WHEN 'critical' THEN 100 ELSE 0 END / 200.0, 0.99)::DOUBLE AS confidence, count(*) AS n FROM h GROUP BY ALL""")


def _as_text(hits):
    return hits.withColumn("related", F.array_join(F.col("related").cast("array<string>"), ","))


def rule_volume(spark, sf):
    rule = cat.VOLUME[0]
    hits = det.volume_rule_hits(telemetry(spark, sf), rule, *t.VOLUME_WINDOWS[rule.rule_id])
    return _as_text(hits).select("event_id", "ts", "host", "rule_id", "confidence", "match_count", "related")


_HITS = t.with_(t.TEL, t.all_hits_sql(), recursive=True)
section.add("rule_volume", rule_volume, f"""{t.with_(t.TEL, t.volume_sql(cat.VOLUME[0], 'vol'), recursive=True)}
SELECT event_id, ts, host, rule_id, confidence, match_count, related FROM vol""")


def hits(spark, sf):
    return det.all_hits(telemetry(spark, sf), t.VOLUME_WINDOWS)


section.add("rule_hits_union",
            lambda spark, sf: _as_text(hits(spark, sf)).select("event_id", "rule_id", "match_count", "related"),
            f"{_HITS} SELECT event_id, rule_id, match_count, related FROM hits")

_DIM = ", ".join(f"('{i}', {t.sql_text(n)}, '{c}')" for i, n, c in det.TECHNIQUES)
TECH = f"tech(id, name, tactic) AS (VALUES {_DIM})"


def rule_tactic_resolve(spark, sf):
    found = det.resolve_technique(det.rule_matches(telemetry(spark, sf)))
    return found.groupBy("rule_id", "technique", "tactic", "technique_tactic").agg(
        F.count("*").alias("n")).withColumn(
        "mismatch", (F.col("technique_tactic") != "unknown") & (F.col("technique_tactic") != F.col("tactic")))


section.add("rule_tactic_resolve", rule_tactic_resolve,
            f"""{t.with_(t.TEL, TECH, f"h AS ({t.hits_sql(cat.PER_EVENT)})")}
SELECT rule_id, technique, h.tactic AS tactic, coalesce(a.tactic, b.tactic, 'unknown') AS technique_tactic, count(*) AS n,
  coalesce(a.tactic, b.tactic, 'unknown') <> 'unknown' AND coalesce(a.tactic, b.tactic, 'unknown') <> h.tactic AS mismatch
FROM h LEFT JOIN tech a ON a.id = technique LEFT JOIN tech b ON b.id = split_part(technique, '.', 1)
GROUP BY ALL""")

_RULE_LIST = ", ".join(f"('{r.rule_id}')" for r in cat.PER_EVENT)
section.add("rule_metrics", lambda spark, sf: det.rule_quality(telemetry(spark, sf)),
            f"""{t.with_(t.TEL, f"h AS ({t.hits_sql(cat.PER_EVENT)})", f"rules(rule_id) AS (VALUES {_RULE_LIST})",
"c AS (SELECT r.rule_id, count(*) FILTER (WHERE label = 1 AND h.event_id IS NOT NULL) AS tp, count(*) FILTER (WHERE label = 0 AND h.event_id IS NOT NULL) AS fp FROM rules r LEFT JOIN h USING (rule_id) LEFT JOIN tel USING (event_id) GROUP BY 1)",
"m AS (SELECT *, (SELECT count(*) FROM tel WHERE label = 1) - tp AS fn, (SELECT count(*) FROM tel WHERE label = 0) - fp AS tn FROM c)",
"q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END::DOUBLE AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END::DOUBLE AS r FROM m)")}
SELECT rule_id, tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END::DOUBLE, 4) AS fpr,
  round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END::DOUBLE, 4) AS f1 FROM q""")


def rule_fp_sample(spark, sf):
    events = telemetry(spark, sf)
    false = det.rule_matches(events.where("label = 0"), keep=["event_id", "ts", "host", "command_line", "dst_port"])
    top = det.first_rows(false, ["rule_id"], [F.col("ts"), F.col("event_id")], 10)
    return top.groupBy("rule_id").agg(
        F.count("*").alias("n_samples"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("event_id").cast("string").alias("e")))),
                                 lambda s: s["e"]), ",").alias("events"),
        F.count_distinct("host").alias("hosts"), F.count_distinct("command_line").alias("commands"),
        F.count_distinct("dst_port").alias("ports"))


section.add("rule_fp_sample", rule_fp_sample, f"""{t.with_(t.TEL, f"h AS ({t.hits_sql(cat.PER_EVENT)})",
"r AS (SELECT h.rule_id, tel.*, row_number() OVER (PARTITION BY rule_id ORDER BY tel.ts, tel.event_id) AS rank FROM h JOIN tel USING (event_id) WHERE label = 0)")}
SELECT rule_id, count(*) AS n_samples, string_agg(event_id::VARCHAR, ',' ORDER BY rank) AS events, count(DISTINCT host) AS hosts,
  count(DISTINCT command_line) AS commands, count(DISTINCT dst_port) AS ports FROM r WHERE rank <= 10 GROUP BY rule_id""")

_NEEDS = ", ".join(f"('{r.rule_id}', '{r.category}', '{f}')" for r in cat.PER_EVENT for f in sorted(cat.fields_of(r.when)))
section.add("rule_evaluability", lambda spark, sf: det.rule_evaluability(telemetry(spark, sf)),
            f"""{t.with_(t.TEL, f"needs(rule_id, category, field) AS (VALUES {_NEEDS})",
"f AS (SELECT category, unnest(['bytes_out', 'command_line', 'dst_ip', 'dst_port', 'outcome', 'process_name', 'query_name', 'src_ip']) AS field, unnest([count(bytes_out), count(command_line), count(dst_ip), count(dst_port), count(outcome), count(process_name), 0, count(src_ip)]) AS filled FROM tel GROUP BY category)")}
SELECT rule_id, bool_and(f.category IS NOT NULL) AS category_present, bool_and(coalesce(filled > 0, FALSE)) AS evaluable,
  coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE coalesce(filled, 0) = 0), '') AS missing
FROM needs LEFT JOIN f USING (category, field) GROUP BY rule_id""")


def win_sequence_match(spark, sf):
    found = det.all_sequences(hits(spark, sf), t.SEQUENCE_WINDOWS)
    return found.select("sequence", "host", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"),
                        "start_ts", "end_ts", F.round("confidence", 4).alias("confidence"))


section.add("win_sequence_match", win_sequence_match,
            f"""{t.with_(t.TEL, t.all_hits_sql(), t.sequences_sql(), recursive=True)}
SELECT sequence, host, array_to_string(members, ',') AS members, start_ts, end_ts, round(confidence, 4) AS confidence FROM seqs""")

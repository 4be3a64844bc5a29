"""Ordered history, baselines, deviations, features and incident clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from secflow.functions import scalars as s
from secflow.plans import behaviour as b
from secflow.plans import features as ft
from secflow.plans import incidents as inc
from secflow.queries import tables as t
from secflow.queries.detection import hits
from secflow.queries.registry import Section
from secflow.sources.telemetry import telemetry

section = Section()
W = t.FEATURE_WINDOW

_FEAT = t.with_(t.TEL, t.features_sql())
section.add("win_burst", lambda spark, sf: b.burst(telemetry(spark, sf), W).selectExpr(
    "event_id", "host", "events_in_window", "round(log1p(events_in_window), 6) as burst_log"),
    f"{t.with_(t.TEL, t.features_sql())} SELECT event_id, host, burst AS events_in_window, round(ln(1 + burst), 6) AS burst_log FROM tmp")
section.add("win_since_prev", lambda spark, sf: b.since_previous(telemetry(spark, sf), W).selectExpr(
    "event_id", "host", "round(since_prev, 6) as since_prev", "round(log1p(since_prev), 6) as since_log"),
    f"{_FEAT} SELECT event_id, host, round(since_prev, 6) AS since_prev, round(ln(1 + since_prev), 6) AS since_log FROM tmp")

section.add("win_baseline_hours", lambda spark, sf: b.user_history(telemetry(spark, sf)).select(
    "event_id", "user", "hour", "n_prior", "n_hour", "typical"),
    f"""{t.with_(t.TEL, t.USERS)} SELECT event_id, "user", hour, n_prior, n_hour, typical FROM usr""")


def win_first_seen(spark, sf):
    events = telemetry(spark, sf)
    users = b.first_seen(events.where("user is not null"), "user", "src_ip").selectExpr(
        "event_id", "'ip' as kind", "src_ip as value")
    return users.unionByName(b.first_seen(events, "host", "process_name").selectExpr(
        "event_id", "'process' as kind", "process_name as value"))


section.add("win_first_seen", win_first_seen, f"""{t.with_(t.TEL, t.USERS, t.HOSTS)}
SELECT event_id, 'ip' AS kind, src_ip AS value FROM usr WHERE ip_no = 1 AND src_ip IS NOT NULL
UNION ALL SELECT event_id, 'process', process_name FROM hst WHERE proc_no = 1 AND process_name IS NOT NULL""")
section.add("win_volume_z", lambda spark, sf: b.volume_z(telemetry(spark, sf)).selectExpr(
    "event_id", "host", "round(z, 4) as z"),
    f"{t.with_(t.TEL, t.HOSTS)} SELECT event_id, host, round(z, 4) AS z FROM hst WHERE bytes_out IS NOT NULL")
section.add("win_baseline_conf", lambda spark, sf: b.host_history(telemetry(spark, sf)).selectExpr(
    "event_id", "host", "n_prior", f"round({b.confidence('n_prior')}, 4) as confidence", "n_prior >= 10 as may_alert"),
    f"{t.with_(t.TEL, t.HOSTS)} SELECT event_id, host, n_prior, round(least(n_prior / 50, 1)::DOUBLE, 4) AS confidence, n_prior >= 10 AS may_alert FROM hst")

_DEV = t.with_(t.TEL, t.USERS, t.HOSTS, t.DEVIATIONS)
_KINDS = {"dev_unusual_hour": ("unusual_hour", b.unusual_hour),
          "dev_unknown_ip": ("unknown_ip", b.unknown_ip),
          "dev_unknown_process": ("unknown_process", b.unknown_process),
          "dev_unusual_volume": ("unusual_volume", b.unusual_volume)}
for _key, (_kind, _plan) in _KINDS.items():
    section.add(_key, lambda spark, sf, plan=_plan: plan(telemetry(spark, sf)).selectExpr(
        "event_id", "entity", "kind", "round(score, 3) as score", "round(confidence, 4) as confidence"),
        f"""{_DEV} SELECT event_id, entity, kind, round(score, 3) AS score, round(confidence, 4) AS confidence
FROM dev WHERE kind = '{_kind}'""")
section.add("behaviour_score", lambda spark, sf: b.behaviour_scores(telemetry(spark, sf)).selectExpr(
    "event_id", "deviation_kinds", "round(behaviour_score, 3) as behaviour_score"),
    f"""{_DEV} SELECT event_id, string_agg(kind, ',' ORDER BY kind) AS deviation_kinds,
round(sum(score * confidence), 3) AS behaviour_score FROM dev GROUP BY event_id""")


def _flat_profile(df):
    return df.selectExpr(
        "type", "entity", "n_events", "first_seen", "last_seen",
        "array_join(transform(map_entries(hours), x -> concat(x.key, ':', x.value)), ',') as hours",
        "n_ips", "n_processes", "array_join(coalesce(ips, array()), ',') as ips",
        "array_join(coalesce(processes, array()), ',') as processes")


_PROFILE = t.with_(
    t.TEL, """e AS (SELECT 'user' AS type, "user" AS entity, ts, src_ip AS ip, process_name FROM tel WHERE "user" IS NOT NULL
  UNION ALL SELECT 'host', host, ts, dst_ip, process_name FROM tel WHERE host IS NOT NULL)""",
    "hrs AS (SELECT type, entity, hour(ts) AS h, count(*) AS n FROM e GROUP BY ALL)",
    "hs AS (SELECT type, entity, string_agg(h || ':' || n, ',' ORDER BY h) AS hours FROM hrs GROUP BY ALL)",
    """vals AS MATERIALIZED (SELECT type, entity, kind, value, min(ts) AS first_seen, count(*) AS n FROM (
  SELECT type, entity, ts, 'ip' AS kind, ip AS value FROM e UNION ALL SELECT type, entity, ts, 'process', process_name FROM e) WHERE value IS NOT NULL GROUP BY ALL)""",
    """lists AS MATERIALIZED (SELECT type, entity, kind, count(*) AS n_values, string_agg(value, ',' ORDER BY first_seen, value) AS shown
  FROM vals GROUP BY ALL)""")
section.add("baseline_profile", lambda spark, sf: _flat_profile(b.profiles(telemetry(spark, sf))),
            f"""{_PROFILE} SELECT s.*, coalesce(i.n_values, 0) AS n_ips, coalesce(p.n_values, 0) AS n_processes, coalesce(i.shown, '') AS ips, coalesce(p.shown, '') AS processes
FROM (SELECT type, entity, count(*) AS n_events, min(ts) AS first_seen, max(ts) AS last_seen, any_value(hours) AS hours FROM e JOIN hs USING (type, entity) GROUP BY type, entity) s
LEFT JOIN lists i ON i.type = s.type AND i.entity = s.entity AND i.kind = 'ip' LEFT JOIN lists p ON p.type = s.type AND p.entity = s.entity AND p.kind = 'process'""")
section.add("baseline_values", lambda spark, sf: b.profile_values(telemetry(spark, sf)),
            f"{_PROFILE} SELECT type, entity, kind, value, first_seen, n FROM vals")


# --- features -----------------------------------------------------------------------------------
def train_rows(events):
    return events.where("label = 0 and event_id % 2 = 0")


section.add("ml_rarity", lambda spark, sf: ft.with_rarity(
    telemetry(spark, sf), train_rows(telemetry(spark, sf))).selectExpr(
    "event_id", "round(user_rarity, 6) as user_rarity", "round(src_ip_rarity, 6) as src_ip_rarity",
    "round(port_rarity, 6) as port_rarity"),
    f"{_FEAT} SELECT event_id, round(user_rarity, 6) AS user_rarity, round(src_ip_rarity, 6) AS src_ip_rarity, round(port_rarity, 6) AS port_rarity FROM feat")


def features(spark, sf):
    events = telemetry(spark, sf)
    return ft.features(events, train_rows(events), W)


def _r(x: str, digits: int) -> str:
    """Rounded, with a plain zero instead of a negative one."""
    return f"CASE WHEN round({x}, {digits}) = 0 THEN cast(0 AS double) ELSE round({x}, {digits}) END"


def _plain(x: str, digits: int) -> str:
    """The same as ``_r``, but rounded once: adding zero makes a negative zero a plain one."""
    return f"round({x}, {digits}) + 0D"


_R4 = ", ".join(f"{_r(n, 4)} AS {n}" for n in ft.FEATURES)
section.add("ml_features", lambda spark, sf: features(spark, sf).selectExpr(
    "event_id", *[f"{_plain(n, 4)} as {n}" for n in ft.FEATURES]), f"{_FEAT} SELECT event_id, {_R4} FROM feat")


def standardized(spark, sf):
    rows = features(spark, sf)
    return ft.standardized(rows, train_rows(rows))


_STATS = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in ft.FEATURES)
_NORM = ", ".join(f"(f.{n} - m_{n}) / CASE WHEN s_{n} < 1e-5 THEN 1 ELSE s_{n} END AS {n}" for n in ft.FEATURES)
NORMED = f"""st AS (SELECT {_STATS} FROM feat WHERE label = 0 AND event_id % 2 = 0),
normed AS MATERIALIZED (SELECT event_id, ts, label, attack_cat, {_NORM} FROM feat f CROSS JOIN st)"""
section.add("ml_standardize", lambda spark, sf: standardized(spark, sf).selectExpr(
    "event_id", *[f"{_plain(n, 3)} as {n}" for n in ft.FEATURES]),
    f"{t.with_(t.TEL, t.features_sql(), NORMED)} SELECT event_id, {', '.join(f'{_r(n, 3)} AS {n}' for n in ft.FEATURES)} FROM normed")
_PAIRS = ", ".join(f"{{'d': round(abs({n}), 6), 'n': '{n}'}}" for n in ft.FEATURES)


def topk_features(spark, sf):
    rounded = standardized(spark, sf).selectExpr("event_id", *[f"round({n}, 6) as {n}" for n in ft.FEATURES])
    return rounded.selectExpr("event_id", f"array_join(transform({ft.top_features()}, x -> x.name), ',') as top3")


section.add("topk_features", topk_features, f"""{t.with_(t.TEL, t.features_sql(), NORMED)}
SELECT event_id, array_to_string(list_transform(list_reverse_sort([{_PAIRS}])[1:3], lambda x: x.n), ',') AS top3 FROM normed""")

# --- clusters and incidents ------------------------------------------------------------------------
def found(spark, sf):
    return inc.findings(hits(spark, sf), telemetry(spark, sf))


def incidents(spark, sf):
    return inc.incidents(hits(spark, sf), telemetry(spark, sf), t.GAP)


section.add("union_findings", lambda spark, sf: found(spark, sf).select(
    "kind", "event_id", "entity", "rule_id", "severity", F.round("confidence", 4).alias("confidence")),
    f"{t.with_(t.TEL, t.all_hits_sql(), t.FINDINGS, recursive=True)} SELECT kind, event_id, entity, rule_id, severity, round(confidence, 4) AS confidence FROM found")
section.add("win_sessions", lambda spark, sf: inc.clustered(found(spark, sf), t.GAP).select(
    "entity", "event_id", "rule_id", "session"),
    f"{t.with_(t.TEL, t.all_hits_sql(), t.FINDINGS, t.CLUSTERS, recursive=True)} SELECT entity, event_id, rule_id, session FROM clus")
section.add("win_ordered_distinct", lambda spark, sf: incidents(spark, sf).selectExpr(
    "incident_id", "array_join(techniques, ',') as techniques", "array_join(tactics, ',') as tactics"),
    f"""{t.incident_base()} SELECT incident_id, coalesce(array_to_string(techniques, ','), '') AS techniques, coalesce(array_to_string(tactics, ','), '') AS tactics FROM inc""")
section.add("incident_rollup", lambda spark, sf: incidents(spark, sf).selectExpr(
    "incident_id", "entity", "start_ts", "end_ts", "n_findings", "max_severity", "size(techniques) as n_techniques"),
    f"""{t.incident_base()} SELECT incident_id, entity, start_ts, end_ts, n_findings, max_severity, len(techniques)::INT AS n_techniques FROM inc""")
section.add("incident_risk", lambda spark, sf: incidents(spark, sf).select(
    "incident_id", "risk", "deepest"), f"{t.incident_base()} SELECT incident_id, risk, deepest FROM inc")
section.add("incident_velocity", lambda spark, sf: incidents(spark, sf).selectExpr(
    "incident_id", "round(velocity, 6) as velocity"),
    f"{t.incident_base()} SELECT incident_id, round(velocity, 6) AS velocity FROM inc")

# --- scalar functions over the telemetry ---------------------------------------------------------
_SCALARS = {
    "fn_entropy": (["command_line"], [f"round({s.entropy('command_line')}, 6) as entropy"],
                   f"round({t.entropy_sql('command_line')}, 6) AS entropy"),
    "fn_bytes_ratio": ([], [f"round({s.bytes_ratio()}, 6) as ratio"],
                       "round(CASE WHEN coalesce(bytes_out, 0) + coalesce(bytes_in, 0) = 0 THEN 0.5 ELSE coalesce(bytes_out, 0) / (coalesce(bytes_out, 0) + coalesce(bytes_in, 0)) END::DOUBLE, 6) AS ratio"),
    "fn_special_chars": ([], [f"cast({s.special_chars('command_line')} as bigint) as special"],
                         "length(coalesce(command_line, '')) - length(regexp_replace(coalesce(command_line, ''), '[^\\p{L}\\p{N}\\s]', '', 'g')) AS special"),
    "fn_cyclic_hour": ([], [f"{_r(f'sin({s.hour_angle()})', 6)} as hour_sin", f"{_r(f'cos({s.hour_angle()})', 6)} as hour_cos",
                            f"{s.is_night()} as night"],
                       f"{_r('sin(hour(ts) * pi() / 12)', 6)} AS hour_sin, {_r('cos(hour(ts) * pi() / 12)', 6)} AS hour_cos, hour(ts) NOT BETWEEN 6 AND 22 AS night"),
    "fn_rare_port": ([], ["dst_port", f"{s.rare_port()} as rare"],
                     "dst_port, coalesce(dst_port NOT IN (80, 443, 22, 53, 25, 3389, 445, 139, 21, 23, 3306, 8080), FALSE) AS rare"),
    "fn_log_volume": ([], [f"round({s.log_volume('bytes_out')}, 6) as out_log", f"round({s.log_volume('bytes_in')}, 6) as in_log"],
                      "round(ln(1 + coalesce(bytes_out, 0)), 6) AS out_log, round(ln(1 + coalesce(bytes_in, 0)), 6) AS in_log"),
    "fn_severity_bands": ([], [f"{s.anomaly_severity('anomaly_score')} as anomaly_band", f"{s.score_severity('v')} as score_band"],
                          "CASE WHEN anomaly_score >= 0.6 THEN 'medium' WHEN anomaly_score >= 0.5 THEN 'low' ELSE 'info' END AS anomaly_band, CASE WHEN v < 55 THEN 'low' WHEN v < 70 THEN 'medium' WHEN v < 85 THEN 'high' ELSE 'critical' END AS score_band"),
    "fn_pct_format": ([], [f"{s.percent_text('(k / 1000D + 0.0003D)')} as pct"],
                      "CASE WHEN k >= 100 THEN printf('%.0f%%', k / 10.0 + 0.03) WHEN k >= 10 THEN printf('%.1f%%', k / 10.0::DOUBLE + 0.03::DOUBLE) ELSE printf('%.2f%%', k / 10.0::DOUBLE + 0.03::DOUBLE) END AS pct"),
}
for _key, (_extra, _cols, _sql) in _SCALARS.items():
    section.add(_key, lambda spark, sf, extra=_extra, cols=_cols: telemetry(spark, sf).selectExpr("event_id", *extra, *cols),
                f"{t.with_(t.TEL)} SELECT event_id, {''.join(c + ', ' for c in _extra)}{_sql} FROM tel")


def fn_entity(spark, sf):
    events = telemetry(spark, sf).withColumn("host", F.expr("if(k % 3 = 0, null, host)"))
    return events.selectExpr("event_id", f"{s.entity()} as entity")


section.add("fn_entity", fn_entity, f"""{t.with_(t.TEL)} SELECT event_id,
CASE WHEN k % 3 <> 0 THEN host WHEN "user" IS NOT NULL THEN "user" ELSE src_ip END AS entity FROM tel""")


def fn_entity_type(spark, sf):
    names = telemetry(spark, sf).selectExpr("event_id", "element_at(array(host, concat(user, '@corp.test'), src_ip, user), cast(k % 4 + 1 as int)) as name")
    return names.selectExpr("event_id", "name", f"{s.entity_type('name')} as entity_type")


section.add("fn_entity_type", fn_entity_type, f"""{t.with_(t.TEL, '''n AS (SELECT event_id, CASE k % 4 WHEN 0 THEN host WHEN 1 THEN "user" || '@corp.test' WHEN 2 THEN src_ip ELSE "user" END AS name FROM tel)''')}
SELECT event_id, name, CASE WHEN name LIKE 'SRV-%' OR name LIKE 'DB-%' THEN 'server' WHEN name LIKE 'WKS-%' OR name LIKE 'PC-%' THEN 'workstation'
  WHEN name LIKE '%@%' THEN 'user' WHEN len(string_split(name, '.')) = 4 THEN 'network_address' ELSE 'unknown' END AS entity_type FROM n""")


def fn_tactic_index(spark, sf):
    from secflow.plans.detection import rule_matches
    from secflow.schema import normal_tactic, tactic_index
    return rule_matches(telemetry(spark, sf)).groupBy("tactic").agg(F.count("*").alias("n")).select(
        "tactic", "n", normal_tactic("tactic").alias("current_name"), tactic_index("tactic").alias("position"))


from secflow.plans import catalogue as cat  # noqa: E402

section.add("fn_tactic_index", fn_tactic_index, f"""{t.with_(t.TEL, f"h AS ({t.hits_sql(cat.PER_EVENT)})")}
SELECT tactic, count(*) AS n, replace(tactic, 'defense-evasion', 'stealth') AS current_name, {t.tidx('tactic')}::BIGINT AS position FROM h GROUP BY tactic""")

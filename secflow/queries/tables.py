"""DuckDB text of the shared input projections, used by the check queries."""

from __future__ import annotations

from secflow.sources.telemetry import COMMANDS, PORTS, PROCESSES


def sql_text(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def case_of(expr: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN {sql_text(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


TEL = f"""tel AS (SELECT event_id, ts, u, k, v, et AS event_type,
  CASE et WHEN 'error' THEN 'auth' WHEN 'signup' THEN 'sysmon' WHEN 'purchase' THEN 'firewall'
    WHEN 'click' THEN 'netflow' WHEN 'view' THEN 'web' END AS source,
  CASE et WHEN 'error' THEN 'authentication' WHEN 'signup' THEN 'process' WHEN 'purchase' THEN 'network'
    WHEN 'click' THEN 'network' WHEN 'view' THEN 'web' END AS category,
  CASE et WHEN 'error' THEN 'user_login' WHEN 'signup' THEN 'process_create' WHEN 'purchase' THEN 'allow'
    WHEN 'click' THEN 'network_flow' WHEN 'view' THEN 'get' END AS action,
  {case_of('u % 4', ['SRV-', 'DB-', 'WKS-', 'PC-'])} || (u % 20)::VARCHAR AS host,
  CASE WHEN et IN ('purchase', 'click') AND k % 7 = 0 THEN NULL ELSE 'u' || u::VARCHAR END AS "user",
  CASE WHEN k % 10 = 0 THEN '203.0.113.' || k::VARCHAR
    ELSE '10.0.' || (u // 250)::VARCHAR || '.' || (u % 250)::VARCHAR END AS src_ip,
  CASE WHEN k % 9 = 0 THEN '198.51.100.' || k::VARCHAR ELSE '10.1.0.' || (k % 50)::VARCHAR END AS dst_ip,
  CASE et WHEN 'purchase' THEN {case_of('k % 8', PORTS)} WHEN 'click' THEN k + 1 END::INTEGER AS dst_port,
  CASE et WHEN 'purchase' THEN floor(v * 1000000) WHEN 'click' THEN floor(v * 1000) END::BIGINT AS bytes_out,
  CASE et WHEN 'purchase' THEN floor(v * 100) WHEN 'click' THEN k END::BIGINT AS bytes_in,
  CASE et WHEN 'signup' THEN {case_of('k % 12', COMMANDS)} WHEN 'view' THEN '/p?k=' || k::VARCHAR END AS command_line,
  CASE et WHEN 'signup' THEN {case_of('k % 10', PROCESSES)} END AS process_name,
  CASE WHEN et = 'signup' AND k % 3 = 0 THEN 'explorer.exe' WHEN et = 'signup' AND k % 3 = 1 THEN 'winword.exe' END AS parent_process,
  CASE WHEN et = 'signup' THEN md5('f' || (k % 25)::VARCHAR) END AS md5,
  CASE et WHEN 'error' THEN CASE WHEN k < 80 THEN 'failure' ELSE 'success' END
    WHEN 'view' THEN CASE WHEN k % 5 = 0 THEN '404' ELSE '200' END ELSE 'success' END AS outcome,
  (CASE WHEN (et = 'signup' AND k % 12 IN (0, 1, 4, 6) AND v > 20) OR (et = 'purchase' AND k % 8 IN (1, 3) AND v > 50)
    OR (et = 'error' AND k % 10 = 0) THEN 1 ELSE 0 END)::INTEGER AS label,
  CASE et WHEN 'signup' THEN 'Execution' WHEN 'purchase' THEN 'Backdoor' WHEN 'error' THEN 'Credential'
    WHEN 'click' THEN 'Flow' WHEN 'view' THEN 'Web' END AS attack_cat,
  round((k * 37 % 101)::DOUBLE * 0.006::DOUBLE + CASE WHEN v > 120 THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END, 4) AS anomaly_score
  FROM (SELECT event_id, ts, user_id AS u, event_type AS et, value AS v,
    regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events))"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


def rule_sql(tree: tuple, columns: tuple = ()) -> str:
    """A rule condition as DuckDB text."""
    head = tree[0]
    if head in ("and", "or"):
        return "(" + f" {head.upper()} ".join(rule_sql(t) for t in tree[1:]) + ")"
    if head == "not":
        return f"(NOT {rule_sql(tree[1])})"
    name, op, value = tree
    column = "NULL::VARCHAR" if name == "query_name" else f'"{name}"::VARCHAR'
    low = f"lower({column})"
    if op == "in":
        test = f"{low} IN ({', '.join(sql_text(str(v)) for v in value)})"
    elif op == "regex":
        test = f"regexp_matches({column}, {sql_text(value)}, 'i')"
    elif op == "gt":
        test = f"TRY_CAST({column} AS DOUBLE) > {value}"
    else:
        func = {"contains_any": "contains", "contains_all": "contains", "startswith": "starts_with",
                "endswith": "ends_with"}[op]
        glue = " AND " if op == "contains_all" else " OR "
        return "(" + glue.join(f"coalesce({func}({low}, {sql_text(v.lower())}), FALSE)" for v in value) + ")"
    return f"coalesce({test}, FALSE)"


def hits_sql(rules: list, source: str = "tel") -> str:
    return " UNION ALL ".join(
        f"SELECT event_id, ts, host, '{r.rule_id}' AS rule_id, {sql_text(r.title)} AS title, '{r.severity}' AS severity, "
        f"'{r.technique}' AS technique, '{r.tactic}' AS tactic, {r.confidence}::DOUBLE AS confidence "
        f"FROM {source} WHERE category = '{r.category}' AND {rule_sql(r.when)}" for r in rules)


DAY = 86400
# The test tables hold about seventy rows per user a month, so the time constants are stretched.
VOLUME_WINDOWS = {"RULE-0001": (3, 3 * DAY), "RULE-0006": (2, 20 * DAY)}
SEQUENCE_WINDOWS = {
    "brute-force-then-execution": 2 * DAY, "execution-then-persistence": 2 * DAY,
    "discovery-then-lateral": 4 * DAY, "channel-then-exfiltration": 4 * DAY, "full-chain": 8 * DAY,
}


def volume_sql(rule, name: str) -> str:
    """The greedy window rule as a recursive walk (needs WITH RECURSIVE)."""
    count, seconds = VOLUME_WINDOWS[rule.rule_id]
    key = " || '|' || ".join(f"""coalesce("{g}"::VARCHAR, '')""" for g in rule.group_by)
    grow = "list_append(CASE WHEN r.hit THEN [] ELSE r.w END, {'t': epoch_us(m.ts), 'i': m.event_id})"
    return f"""{name}_m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ts, event_id) AS rn FROM (
  SELECT event_id, ts, host, {key} AS g FROM tel WHERE category = '{rule.category}' AND {rule_sql(rule.when)})),
{name}_r AS (SELECT g, rn, event_id, ts, host, [{{'t': epoch_us(ts), 'i': event_id}}] AS w, FALSE AS hit FROM {name}_m WHERE rn = 1
  UNION ALL SELECT g, rn, event_id, ts, host, nw, len(nw) >= {count} FROM (
    SELECT m.g, m.rn, m.event_id, m.ts, m.host,
      list_filter({grow}, lambda x: epoch_us(m.ts) - x.t <= {seconds * 1000000}) AS nw
    FROM {name}_r r JOIN {name}_m m ON m.g = r.g AND m.rn = r.rn + 1)),
{name} AS MATERIALIZED (SELECT event_id, ts, host, '{rule.rule_id}' AS rule_id, {sql_text(rule.title)} AS title, '{rule.severity}' AS severity,
  '{rule.technique}' AS technique, '{rule.tactic}' AS tactic, {rule.confidence}::DOUBLE AS confidence,
  {count}::BIGINT AS match_count, array_to_string(list_transform(w[1:len(w) - 1], lambda x: x.i::VARCHAR), ',') AS related
  FROM {name}_r WHERE hit)"""


def all_hits_sql() -> str:
    from secflow.plans import catalogue as cat
    parts = [f"single AS MATERIALIZED (SELECT *, 1::BIGINT AS match_count, '' AS related FROM ({hits_sql(cat.PER_EVENT)}))"]
    parts += [volume_sql(r, f"vol{i}") for i, r in enumerate(cat.VOLUME)]
    union = " UNION ALL ".join(["SELECT * FROM single"] + [f"SELECT * FROM vol{i}" for i in range(len(cat.VOLUME))])
    return ",\n".join(parts + [f"hits AS MATERIALIZED ({union})"])


def sequences_sql() -> str:
    from secflow.plans import catalogue as cat
    rows = ", ".join(
        f"('{name}', [{', '.join(sql_text(t) for t in pattern)}], {SEQUENCE_WINDOWS[name] * 1000000}::BIGINT)"
        for name, pattern, _ in cat.SEQUENCES)
    return f"""pat(name, steps, span) AS (VALUES {rows}),
sq_m AS MATERIALIZED (SELECT name, steps, span, coalesce(host, '') AS g, event_id, ts, technique, confidence,
  row_number() OVER (PARTITION BY name, coalesce(host, '') ORDER BY ts, event_id, rule_id) AS rn
  FROM hits JOIN pat ON list_contains(steps, technique)),
sq_r AS (SELECT name, g, 0::BIGINT AS rn, 0::BIGINT AS k, NULL::TIMESTAMP AS t0, NULL::TIMESTAMP AS t1, []::BIGINT[] AS ids, 0::DOUBLE AS conf, FALSE AS done
  FROM sq_m WHERE rn = 1
  UNION ALL SELECT name, g, rn, CASE WHEN adv THEN k0 + 1 ELSE k0 END, CASE WHEN adv AND k0 = 0 THEN ts ELSE t0 END, ts,
    CASE WHEN adv THEN list_append(CASE WHEN k0 = 0 THEN [] ELSE ids END, event_id) ELSE ids END,
    CASE WHEN adv THEN confidence + CASE WHEN k0 = 0 THEN 0 ELSE conf END ELSE conf END,
    adv AND k0 + 1 = len(steps)
  FROM (SELECT *, technique = steps[k0 + 1] AS adv FROM (
    SELECT m.*, r.t0, r.ids, r.conf,
      CASE WHEN r.done OR (r.k > 0 AND epoch_us(m.ts) - epoch_us(r.t0) > m.span) THEN 0 ELSE r.k END AS k0
    FROM sq_r r JOIN sq_m m ON m.name = r.name AND m.g = r.g AND m.rn = r.rn + 1))),
seqs AS MATERIALIZED (SELECT name AS sequence, g AS host, ids AS members, t0 AS start_ts, t1 AS end_ts,
  least(1.0, conf / len(ids) + 0.2)::DOUBLE AS confidence FROM sq_r WHERE done)"""


GAP = 6 * 3600
_TACTIC_LIST = "['reconnaissance','resource-development','initial-access','execution','persistence','privilege-escalation','stealth','defense-impairment','credential-access','discovery','lateral-movement','collection','command-and-control','exfiltration','impact']"
SEV = "CASE {0} WHEN 'low' THEN 25 WHEN 'medium' THEN 50 WHEN 'high' THEN 75 WHEN 'critical' THEN 100 ELSE 0 END"


def tidx(c: str) -> str:
    return f"(coalesce(list_position({_TACTIC_LIST}, CASE {c} WHEN 'defense-evasion' THEN 'stealth' ELSE {c} END), 0) - 1)"


FINDINGS = """found AS MATERIALIZED (SELECT 'rule' AS kind, event_id, ts, coalesce(host, 'unknown') AS entity, rule_id, severity, confidence, technique, tactic, title FROM hits
 UNION ALL SELECT 'anomaly', event_id, ts, coalesce(host, "user", src_ip, 'unknown'), 'anomaly', CASE WHEN anomaly_score >= 0.6 THEN 'medium' WHEN anomaly_score >= 0.5 THEN 'low' ELSE 'info' END,
   anomaly_score, 'unknown', 'unknown', 'Anomalous behaviour' FROM tel WHERE anomaly_score >= 0.602)"""
CLUSTERS = f"""clus AS MATERIALIZED (SELECT *, sum(opens) OVER (PARTITION BY entity ORDER BY ts, event_id, rule_id)::BIGINT AS session FROM (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity ORDER BY ts, event_id, rule_id)) <= {GAP * 1000000} THEN 0 ELSE 1 END AS opens FROM found))"""
INCIDENTS = f"""firsts AS (SELECT entity, session, technique, min(struct_pack(a := ts, b := event_id, c := rule_id)) AS f FROM clus WHERE technique NOT IN ('unknown', '') GROUP BY ALL),
firstt AS (SELECT entity, session, tactic, min(struct_pack(a := ts, b := event_id, c := rule_id)) AS f FROM clus WHERE tactic NOT IN ('unknown', '') GROUP BY ALL),
techs AS (SELECT entity, session, list(technique ORDER BY f, technique) AS techniques FROM firsts GROUP BY ALL),
tacts AS (SELECT entity, session, list(tactic ORDER BY f, tactic) AS tactics, max({tidx('tactic')})::BIGINT AS deepest FROM firstt GROUP BY ALL),
inc0 AS (SELECT entity, session, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_findings, max({SEV.format('severity')})::BIGINT AS max_severity, avg(confidence) AS mean_confidence FROM clus GROUP BY ALL),
inc AS MATERIALIZED (SELECT *, trunc(least(trunc(0.5::DOUBLE * max_severity + 0.35::DOUBLE * progress + 0.15::DOUBLE * least(5 * n_findings, 30)), 100))::BIGINT AS risk,
   CASE WHEN end_ts = start_ts THEN 0 ELSE n_findings / ((epoch_us(end_ts) - epoch_us(start_ts)) / 60e6) END::DOUBLE AS velocity FROM (
   SELECT inc0.*, entity || '#' || session AS incident_id, coalesce(techniques, []) AS techniques, coalesce(tactics, []) AS tactics, coalesce(deepest, -1)::BIGINT AS deepest,
     CASE WHEN coalesce(deepest, -1) >= 0 THEN trunc(deepest / 15.0::DOUBLE * 100) ELSE 0 END AS progress
   FROM inc0 LEFT JOIN techs USING (entity, session) LEFT JOIN tacts USING (entity, session)))"""


def incident_base(*more: str) -> str:
    return with_(TEL, all_hits_sql(), FINDINGS, CLUSTERS, INCIDENTS, *more, recursive=True)


USERS = """usr AS MATERIALIZED (SELECT *, n_hour >= greatest(0.02 * n_prior, 1) AS typical FROM (SELECT event_id, ts, "user", src_ip, hour(ts) AS hour,
  count(*) OVER (PARTITION BY "user" ORDER BY ts, event_id) - 1 AS n_prior,
  count(*) OVER (PARTITION BY "user", hour(ts) ORDER BY ts, event_id) - 1 AS n_hour,
  row_number() OVER (PARTITION BY "user", src_ip ORDER BY ts, event_id) AS ip_no FROM tel WHERE "user" IS NOT NULL))"""
HOSTS = """hst0 AS (SELECT event_id, ts, host, process_name, bytes_out, count(*) OVER (PARTITION BY host ORDER BY ts, event_id) - 1 AS n_prior,
  row_number() OVER (PARTITION BY host, process_name ORDER BY ts, event_id) AS proc_no FROM tel WHERE host IS NOT NULL),
vols AS (SELECT *, CASE WHEN n >= 5 AND sd > 0 THEN (bytes_out - mean) / sd END AS z FROM (SELECT event_id, bytes_out,
  count(*) OVER w AS n, avg(bytes_out) OVER w AS mean, stddev_pop(bytes_out::DOUBLE) OVER w AS sd FROM hst0 WHERE bytes_out IS NOT NULL
  WINDOW w AS (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING))),
hst AS MATERIALIZED (SELECT hst0.*, z FROM hst0 LEFT JOIN vols USING (event_id))"""
DEVIATIONS = """dev AS MATERIALIZED (
 SELECT event_id, 'unusual_hour' AS kind, "user" AS entity, 70::DOUBLE AS score, least(n_prior / 50, 1)::DOUBLE AS confidence, 'T1078' AS technique FROM usr WHERE n_prior >= 10 AND NOT typical
 UNION ALL SELECT event_id, 'unknown_ip', "user", 65, least(n_prior / 50, 1), 'T1078' FROM usr WHERE n_prior >= 10 AND src_ip IS NOT NULL AND ip_no = 1
 UNION ALL SELECT event_id, 'unknown_process', host, 55, least(n_prior / 50, 1), NULL FROM hst WHERE n_prior >= 10 AND process_name IS NOT NULL AND proc_no = 1
 UNION ALL SELECT event_id, 'unusual_volume', host, least(50 + 10 * (z - 3), 100), least(n_prior / 50, 1), NULL FROM hst WHERE n_prior >= 10 AND z >= 3)"""
FEATURE_WINDOW = 21600


def features_sql(train_where: str = "label = 0 AND event_id % 2 = 0") -> str:
    """The nineteen features; the training rows are chosen by ``train_where``."""
    h = "coalesce(host, src_ip, 'unknown')"
    return f"""trn AS MATERIALIZED (SELECT * FROM tel WHERE {train_where}), ntr AS (SELECT count(*) AS n FROM trn),
cu AS (SELECT coalesce("user", '') AS v, count(*) AS n FROM trn GROUP BY 1), ci AS (SELECT coalesce(src_ip, '') AS v, count(*) AS n FROM trn GROUP BY 1),
cp AS (SELECT coalesce(dst_port::VARCHAR, '') AS v, count(*) AS n FROM trn GROUP BY 1),
tmp0 AS (SELECT *, row_number() OVER (PARTITION BY {h} ORDER BY ts, event_id) AS rn,
  epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {h} ORDER BY ts, event_id)) AS since, {h} AS hh FROM tel),
tmp AS (SELECT *, rn - min(rn) OVER (PARTITION BY hh ORDER BY epoch_us(ts) RANGE BETWEEN {FEATURE_WINDOW * 1000000 - 1} PRECEDING AND CURRENT ROW) AS burst,
  CASE WHEN since IS NULL THEN {FEATURE_WINDOW} ELSE greatest(since / 1e6, 0) END::DOUBLE AS since_prev FROM tmp0),
feat AS MATERIALIZED (SELECT event_id, ts, label, attack_cat, ln(1 + coalesce(bytes_out, 0)) AS bytes_out_log, ln(1 + coalesce(bytes_in, 0)) AS bytes_in_log,
  CASE WHEN coalesce(bytes_out, 0) + coalesce(bytes_in, 0) = 0 THEN 0.5 ELSE coalesce(bytes_out, 0) / (coalesce(bytes_out, 0) + coalesce(bytes_in, 0)) END::DOUBLE AS bytes_ratio,
  CASE WHEN dst_port IS NULL OR dst_port IN (0, 80, 443, 22, 53, 25, 3389, 445, 139, 21, 23, 3306, 8080) THEN 0 ELSE 1 END::DOUBLE AS is_rare_port,
  1 - coalesce(cp.n, 0) / ntr.n::DOUBLE AS port_rarity, length(coalesce(command_line, ''))::DOUBLE AS cmd_len,
  length(regexp_replace(coalesce(command_line, ''), '[\\p{{L}}\\p{{N}}\\s]', '', 'g'))::DOUBLE AS cmd_special_chars,
  {entropy_sql('command_line')} AS cmd_entropy, 1 - coalesce(cu.n, 0) / ntr.n::DOUBLE AS user_rarity, 1 - coalesce(ci.n, 0) / ntr.n::DOUBLE AS src_ip_rarity,
  (md5 IS NOT NULL)::INT::DOUBLE AS has_hash, (parent_process IS NOT NULL)::INT::DOUBLE AS has_parent_cmd, (category = 'process')::INT::DOUBLE AS is_process, (category = 'network')::INT::DOUBLE AS is_network,
  sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos, (hour(ts) < 6 OR hour(ts) > 22)::INT::DOUBLE AS is_night,
  ln(1 + burst) AS events_in_window, ln(1 + since_prev) AS time_since_prev_log
  FROM tmp CROSS JOIN ntr LEFT JOIN cu ON cu.v = coalesce("user", '') LEFT JOIN ci ON ci.v = coalesce(src_ip, '') LEFT JOIN cp ON cp.v = coalesce(dst_port::VARCHAR, ''))"""


def entropy_sql(c: str) -> str:
    """Entropy through a histogram of the characters."""
    return (f"coalesce((SELECT -sum(n / length({c})::DOUBLE * log2(n / length({c})::DOUBLE)) FROM (SELECT ch, count(*) AS n FROM "
            f"(SELECT unnest(string_split({c}, '')) AS ch) WHERE ch <> '' GROUP BY ch)), 0)::DOUBLE")


AS_OF = "2024-02-01 00:00:00"
REPUTATION_TTL = 43200
IOC = """ind AS MATERIALIZED (SELECT s_suppkey, 'ind-' || s_suppkey AS indicator_id, ['c2', 'malicious', 'anomalous-activity', 'spam', 'malicious-activity', 'nation-state'][s_suppkey % 6 + 1] AS label,
  s_suppkey % 7 = 0 AS revoked, CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2024-01-15' END AS valid_until, s_nationkey,
  CASE WHEN s_suppkey % 4 = 0 THEN [md5('f' || (s_suppkey % 25)::VARCHAR)] ELSE ['203.0.113.' || (s_suppkey * 10 % 100), '198.51.100.' || (s_suppkey * 9 % 100)] END AS vals FROM supplier),
live AS MATERIALIZED (SELECT *, unnest(list_distinct(vals)) AS observable FROM ind WHERE NOT revoked AND valid_until IS NULL),
ctx AS (SELECT ind.*, CASE WHEN s_suppkey % 3 <> 0 THEN CASE WHEN n_nationkey = 3 THEN 'APT28' ELSE n_name END END AS actor,
  CASE WHEN s_suppkey % 3 = 0 THEN r_name END AS pattern_name
  FROM ind LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = s_suppkey % 5),
obs AS MATERIALIZED (SELECT DISTINCT event_id, observable FROM (SELECT event_id, unnest([src_ip, dst_ip, md5]) AS observable FROM tel) WHERE observable IS NOT NULL)"""
POINTS = """pts AS (SELECT live.observable, sum(CASE WHEN live.label IN ('nation-state', 'c2') OR actor = 'APT28' THEN 50 WHEN live.label IN ('malicious', 'malware') THEN 30
    WHEN live.label = 'anomalous-activity' THEN 15 WHEN live.label IN ('benign_but_watched', 'spam') THEN 5 ELSE 10 END)::DOUBLE AS points,
  count(*) AS n_indicators, bool_or(live.label IN ('nation-state', 'c2')) AS campaign FROM live JOIN ctx USING (indicator_id) GROUP BY 1),
cti AS MATERIALIZED (SELECT event_id, sum(points) AS cti_points, sum(n_indicators)::BIGINT AS n_cti, bool_or(campaign) AS cti_campaign FROM obs JOIN pts USING (observable) GROUP BY 1)"""
REPUTATION = f"""rep AS (SELECT '8.8.8.' || (c_custkey * 10 % 100) AS observable, CASE WHEN c_custkey % 2 = 0 THEN 'report' ELSE 'pulse' END AS feed,
  (c_custkey * 7 % 101)::DOUBLE AS score, c_custkey * 7 % 101 >= 25 AS malicious, TIMESTAMP '2024-01-01' + to_seconds(c_custkey * 7919 % 2592000) AS queried_at FROM customer),
sig AS (SELECT event_id FROM hits UNION SELECT event_id FROM dev UNION SELECT event_id FROM tel WHERE anomaly_score >= 0.602),
rlive AS MATERIALIZED (SELECT event_id, host, e.observable, feed, max(score) FILTER (WHERE queried_at = top) AS score, bool_or(malicious) FILTER (WHERE queried_at = top) AS malicious FROM (
  SELECT e.*, rep.*, max(queried_at) OVER (PARTITION BY event_id, feed) AS top FROM
   (SELECT event_id, ts, host, replace(src_ip, '203.0.113.', '8.8.8.') AS observable FROM tel JOIN sig USING (event_id) WHERE src_ip LIKE '203.0.113.%') e
   JOIN rep ON rep.observable = e.observable AND queried_at <= ts AND ts < queried_at + to_seconds({REPUTATION_TTL})) e GROUP BY ALL),
rpts AS (SELECT event_id, sum(score / 100 * 40) AS reputation_points, bool_or(score >= 75) AS reputation_campaign FROM rlive WHERE malicious GROUP BY 1)"""
EVIDENCE = """rev AS (SELECT event_id, count(*) AS n_rules, array_to_string(list_sort(list_distinct(list(rule_id))), ',') AS rules,
  array_to_string(list_sort(list_distinct(list(technique))), ',') AS techniques, array_to_string(list_sort(list_distinct(list(tactic))), ',') AS tactics, min(title) AS rule_title FROM hits GROUP BY 1),
sev AS (SELECT event_id, array_to_string(list_sort(list_distinct(list(sequence))), ',') AS sequences FROM (SELECT sequence, unnest(members) AS event_id FROM seqs) GROUP BY 1),
bev AS (SELECT event_id, sum(score * confidence) AS behaviour_score FROM dev GROUP BY 1),
ev AS MATERIALIZED (SELECT *, CASE WHEN n_rules > 0 AND anomaly_score >= 0.602 THEN 'RULE_AND_ANOMALY' WHEN n_rules > 0 THEN 'RULE_MATCH' WHEN anomaly_score >= 0.602 THEN 'ANOMALY_ONLY'
    WHEN behaviour_score IS NOT NULL THEN 'BEHAVIORAL_ANOMALY' ELSE 'NO_DETECTION' END AS detection_status,
  least(100, (CASE WHEN n_rules > 0 THEN 50 ELSE 0 END + greatest(0, (anomaly_score - 0.602) * 40) + CASE WHEN sequences <> '' THEN 30 ELSE 0 END
    + coalesce(behaviour_score, 0) * 0.6 + coalesce(cti_points, 0) + coalesce(reputation_points, 0))::DOUBLE)::DOUBLE AS hybrid_score FROM (
  SELECT tel.*, coalesce(host, "user", src_ip, 'unknown') AS entity, coalesce(n_rules, 0) AS n_rules, coalesce(rules, '') AS rules, coalesce(techniques, '') AS techniques, coalesce(tactics, '') AS tactics, rule_title,
    coalesce(sequences, '') AS sequences, behaviour_score, cti_points, coalesce(n_cti, 0) AS n_cti, cti_campaign, reputation_points, reputation_campaign
  FROM tel LEFT JOIN rev USING (event_id) LEFT JOIN sev USING (event_id) LEFT JOIN bev USING (event_id) LEFT JOIN cti USING (event_id) LEFT JOIN rpts USING (event_id)))"""


def evidence_base(*more: str) -> str:
    return with_(TEL, all_hits_sql(), sequences_sql(), USERS, HOSTS, DEVIATIONS, IOC, POINTS, REPUTATION, EVIDENCE, *more,
                 recursive=True)


LIGHT = """light AS MATERIALIZED (SELECT tel.*, coalesce(host, "user", src_ip, 'unknown') AS entity, coalesce(n_rules, 0) AS n_rules, coalesce(rules, '') AS rules, coalesce(techniques, '') AS techniques,
  coalesce(tactics, '') AS tactics, coalesce(n_cti, 0) AS n_cti, coalesce(cti_campaign, FALSE) AS cti_confirmed,
  least(100, (CASE WHEN n_rules > 0 THEN 50 ELSE 0 END + greatest(0, (anomaly_score - 0.602) * 40) + coalesce(cti_points, 0))::DOUBLE)::DOUBLE AS hybrid_score
  FROM tel LEFT JOIN (SELECT event_id, count(*) AS n_rules, array_to_string(list_sort(list_distinct(list(rule_id))), ',') AS rules, array_to_string(list_sort(list_distinct(list(technique))), ',') AS techniques,
    array_to_string(list_sort(list_distinct(list(tactic))), ',') AS tactics FROM single GROUP BY 1) USING (event_id) LEFT JOIN cti USING (event_id))"""


def light_base(*more: str, recursive: bool = False) -> str:
    from secflow.plans import catalogue as cat
    return with_(TEL, f"single AS MATERIALIZED ({hits_sql(cat.PER_EVENT)})", IOC, POINTS, LIGHT, *more, recursive=recursive)


RISK = """rk_m AS MATERIALIZED (SELECT event_id, ts, entity, greatest(hybrid_score / 3, CASE WHEN cti_confirmed THEN 60 ELSE 0 END)::DOUBLE AS inc,
  row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS rn FROM light WHERE hybrid_score > 0),
rk AS (SELECT entity, rn, event_id, ts, 0::DOUBLE AS previous, least(100, inc)::DOUBLE AS score FROM rk_m WHERE rn = 1
  UNION ALL SELECT m.entity, m.rn, m.event_id, m.ts, r.score, least(100, greatest(0, r.score - 5 * greatest(0, (epoch_us(m.ts) - epoch_us(r.ts)) / 3.6e9)) + m.inc)::DOUBLE
  FROM rk r JOIN rk_m m ON m.entity = r.entity AND m.rn = r.rn + 1)"""
SEQ_STEPS = f"""steps AS (SELECT l_orderkey AS seq_id, {_TACTIC_LIST}[least(l_linenumber * 2 - 2 + l_suppkey % 4, 14) + 1] AS tactic, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL),
lst AS MATERIALIZED (SELECT seq_id, list(tactic ORDER BY pos, tactic) AS tactics FROM steps GROUP BY 1)"""


def markov_sql(lists: str = "lst") -> str:
    """Counts and probabilities from window functions over unnested lists."""
    return f"""stp AS (SELECT seq_id, unnest(tactics) AS tactic, generate_subscripts(tactics, 1) AS i FROM {lists}),
cnt AS MATERIALIZED (SELECT origin, target, count(*) AS n FROM (SELECT tactic AS origin, coalesce(lead(tactic) OVER (PARTITION BY seq_id ORDER BY i), '<END>') AS target FROM stp) GROUP BY ALL),
names AS (SELECT unnest({_TACTIC_LIST}) AS t), ends AS (SELECT t FROM names UNION ALL SELECT '<END>'),
prob AS MATERIALIZED (SELECT o.t AS origin, e.t AS target, coalesce(n, 0) AS n, (coalesce(n, 0) + 0.5::DOUBLE) / (coalesce(tot, 0) + 0.5::DOUBLE * 16) AS p
  FROM names o CROSS JOIN ends e LEFT JOIN cnt ON cnt.origin = o.t AND cnt.target = e.t LEFT JOIN (SELECT origin AS oo, sum(n) AS tot FROM cnt GROUP BY 1) ON oo = o.t)"""

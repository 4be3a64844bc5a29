"""Risk over time, next-tactic models, incident predictions, response and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from secflow.plans import catalogue as cat
from secflow.plans import coverage as cov
from secflow.plans import cti
from secflow.plans import detection as det
from secflow.plans import explain as ex
from secflow.plans import incidents as inc
from secflow.plans import response as rs
from secflow.plans import risk
from secflow.plans import scoring as sc
from secflow.plans import sequence as sq
from secflow.queries import tables as t
from secflow.queries.behaviour import found, incidents
from secflow.queries.detection import hits
from secflow.queries.registry import Section
from secflow.queries.scoring import context
from secflow.sources.telemetry import telemetry

section = Section()


def light(spark, sf):
    """Events scored by per-event rules, the anomaly column and indicators."""
    events = telemetry(spark, sf)
    rules = sc.rule_evidence(det.rule_matches(events))
    points = cti.event_points(events, context(spark, sf), t.AS_OF)
    empty = "cast(null as double)"
    scored = (events.join(rules, "event_id", "left").join(points, "event_id", "left")
              .fillna(0, ["n_rules", "n_cti"]).fillna("", ["rules", "techniques", "tactics"])
              .withColumns({"sequences": F.lit(""), "behaviour_score": F.expr(empty), "reputation_points": F.expr(empty)}))
    return scored.withColumns({
        "entity": F.expr("coalesce(host, user, src_ip, 'unknown')"),
        "cti_confirmed": F.expr("coalesce(cti_campaign, false)"), "hybrid_score": F.expr(sc.SCORE)})


def flagged(spark, sf):
    return light(spark, sf).groupBy("entity").agg(F.bool_or("cti_confirmed").alias("cti_confirmed"))


# --- risk ---------------------------------------------------------------------------------------------
def history(spark, sf):
    return risk.risk_history(light(spark, sf))


_RISK = t.light_base(t.RISK, recursive=True)
section.add("win_risk_decay", lambda spark, sf: history(spark, sf).selectExpr(
    "event_id", "entity", "round(previous, 3) as previous", "round(score, 3) as score"),
    f"{_RISK} SELECT event_id, entity, round(previous, 3) AS previous, round(score, 3) AS score FROM rk")
section.add("win_proactive_alert", lambda spark, sf: risk.alerts(history(spark, sf)).selectExpr(
    "event_id", "entity", "round(score, 3) as score"),
    f"{_RISK} SELECT event_id, entity, round(score, 3) AS score FROM rk WHERE previous < 70 AND score >= 70")
_MOMENT = "2024-01-20 12:00:00"
section.add("win_risk_at", lambda spark, sf: risk.risk_at(history(spark, sf), _MOMENT).selectExpr(
    "entity", "round(score_at, 3) as score_at"), f"""{_RISK} SELECT entity,
round(greatest(0, max_by(score, rn) - 5 * (epoch_us(TIMESTAMP '{_MOMENT}') - epoch_us(max(ts))) / 3.6e9), 3) AS score_at
FROM rk WHERE ts <= TIMESTAMP '{_MOMENT}' GROUP BY entity""")
section.add("win_risk_history", lambda spark, sf: risk.recent_changes(history(spark, sf)).selectExpr(
    "entity", "rank", "event_id", "round(score, 3) as score"),
    f"""{_RISK} SELECT entity, rank, event_id, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS rank FROM rk) WHERE rank <= 20""")


# --- next-tactic models ---------------------------------------------------------------------------------
def lists(spark, sf):
    return sq.tactic_lists(sq.lineitem_steps(spark, sf))


_SEQ = t.with_(t.SEQ_STEPS, t.markov_sql())
_SPLIT = "CASE WHEN ('0x' || substr(md5(seq_id::VARCHAR), 1, 7))::BIGINT % 1000 < 700 THEN 'train' ELSE 'test' END"
section.add("win_transitions", lambda spark, sf: sq.transition_counts(lists(spark, sf)),
            f"{_SEQ} SELECT origin, target, n FROM cnt")
section.add("markov_fit", lambda spark, sf: sq.transition_counts(lists(spark, sf)).groupBy("origin").agg(
    F.sum("n").alias("n_out"), F.count("*").alias("n_targets"),
    F.sum(F.expr("if(target = '<END>', n, 0)")).alias("n_end")),
    f"{_SEQ} SELECT origin, sum(n)::BIGINT AS n_out, count(*) AS n_targets, coalesce(sum(n) FILTER (WHERE target = '<END>'), 0)::BIGINT AS n_end FROM cnt GROUP BY 1")


def probabilities(spark, sf):
    return sq.transition_probabilities(sq.transition_counts(lists(spark, sf)))


section.add("markov_probs", lambda spark, sf: probabilities(spark, sf).selectExpr(
    "origin", "target", "n", "round(p, 6) as p"), f"{_SEQ} SELECT origin, target, n, round(p, 6) AS p FROM prob")
section.add("markov_p_end", lambda spark, sf: probabilities(spark, sf).where("target = '<END>'").selectExpr(
    "origin", "round(p, 6) as p_end"), f"{_SEQ} SELECT origin, round(p, 6) AS p_end FROM prob WHERE target = '<END>'")

_TEXT = "array_join(transform(predicted, x -> concat(x.tactic, ':', format_string('%.4f', x.p))), ',') as predicted"
_TAC = t._TACTIC_LIST
_DEEP = "hd AS MATERIALIZED (SELECT *, (SELECT max(list_position({0}, x)) FROM (SELECT unnest(tactics) AS x)) - 1 AS deepest FROM {1})"


def _markov_sql(source: str, keys: str, k: int = 3, deep: str = "hd") -> str:
    return f"""{_DEEP.format(_TAC, source)},
{_ranked_sql(keys, k, deep)}"""


def _ranked_sql(keys: str, k: int, deep: str = "hd") -> str:
    return f"""mk AS (SELECT {keys}, target, p, row_number() OVER (PARTITION BY {keys} ORDER BY p DESC, target) AS r FROM {deep} JOIN prob ON prob.origin = {_TAC}[deepest + 1]
  AND list_position({_TAC}, target) - 1 > deepest AND NOT list_contains(tactics, target)),
mkl AS MATERIALIZED (SELECT {keys}, list(struct_pack(tactic := target, p := p) ORDER BY r) AS predicted FROM mk WHERE r <= {k} GROUP BY ALL)"""


def _canon_sql(source: str, keys: str, k: int = 3, name: str = "cn") -> str:
    return f"""{name}0 AS (SELECT {keys}, t, row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS r FROM {source} JOIN (SELECT unnest({_TAC}) AS t, generate_subscripts({_TAC}, 1) - 1 AS i) ON i > deepest AND NOT list_contains(tactics, t)),
{name} AS MATERIALIZED (SELECT {keys}, list(struct_pack(tactic := t, p := pow(0.5, r) / tot) ORDER BY r) AS predicted FROM (SELECT *, sum(pow(0.5, r)) OVER (PARTITION BY {keys}) AS tot FROM {name}0 WHERE r < {k}) GROUP BY {keys})"""


_PTEXT = "coalesce(array_to_string(list_transform(predicted, lambda x: x.tactic || ':' || printf('%.4f', x.p)), ','), '') AS predicted"
section.add("markov_predict", lambda spark, sf: sq.markov_predictions(lists(spark, sf), probabilities(spark, sf)).selectExpr(
    "seq_id", _TEXT, "round(p_end, 6) as p_end"),
    f"""{t.with_(t.SEQ_STEPS, t.markov_sql(), _markov_sql('lst', 'seq_id'))}
SELECT hd.seq_id, {_PTEXT}, round(prob.p, 6) AS p_end FROM hd LEFT JOIN mkl USING (seq_id) JOIN prob ON prob.origin = {_TAC}[deepest + 1] AND prob.target = '<END>'""")
section.add("canonical_predict", lambda spark, sf: sq.canonical_predictions(lists(spark, sf)).selectExpr("seq_id", _TEXT),
            f"""{t.with_(t.SEQ_STEPS, _DEEP.format(_TAC, 'lst'), _canon_sql('hd', 'seq_id'))} SELECT seq_id, {_PTEXT} FROM hd LEFT JOIN cn USING (seq_id)""")
_PRE = "pre AS MATERIALIZED (SELECT seq_id, len, tactics[1:len] AS tactics, tactics[len + 1] AS truth FROM (SELECT *, unnest(range(1, len(tactics))) AS len FROM lst{0}) WHERE len < len(tactics))"
section.add("seq_prefixes", lambda spark, sf: sq.prefixes(lists(spark, sf)).selectExpr(
    "seq_id", "cast(len as bigint) as len", "array_join(tactics, ',') as history", "truth"),
    f"{t.with_(t.SEQ_STEPS, _PRE.format(''))} SELECT seq_id, len, array_to_string(tactics, ',') AS history, truth FROM pre")
section.add("seq_split", lambda spark, sf: sq.train_test(lists(spark, sf)).selectExpr("seq_id", "split"),
            f"{t.with_(t.SEQ_STEPS)} SELECT seq_id, {_SPLIT} AS split FROM lst")


def held_out(spark, sf):
    """Markov fitted on the training sequences, and the prefixes of the test sequences."""
    split = sq.train_test(lists(spark, sf))
    probs = sq.transition_probabilities(sq.transition_counts(split.where("split = 'train'")))
    return sq.prefixes(split.where("split = 'test'")), probs


_EVAL = t.with_(
    t.SEQ_STEPS, f"trl AS (SELECT * FROM lst WHERE {_SPLIT} = 'train')", t.markov_sql("trl"),
    _PRE.format(f" WHERE {_SPLIT} = 'test'"), _markov_sql("pre", "seq_id, len"), _canon_sql("hd", "seq_id, len"),
    """sco AS MATERIALIZED (SELECT 'markov' AS model, truth, predicted FROM hd LEFT JOIN mkl USING (seq_id, len) UNION ALL SELECT 'canonical', truth, predicted FROM hd LEFT JOIN cn USING (seq_id, len))""")
_PK = """model, count(*) AS n, count(*) FILTER (WHERE predicted[1].tactic = truth) AS hits1, count(*) FILTER (WHERE list_contains(list_transform(predicted, lambda x: x.tactic), truth)) AS hits3,
count(*) FILTER (WHERE len(predicted) > 0) AS covered"""
_PR = "round(hits1 / n, 6) AS p1, round(hits3 / n, 6) AS p3"


def seq_precision(spark, sf):
    tests, probs = held_out(spark, sf)
    return sq.precision_at(sq.markov_predictions(tests, probs), "markov")


def _p(df):
    return df.selectExpr("model", "n", "hits1", "hits3", "covered", "round(p1, 6) as p1", "round(p3, 6) as p3")


section.add("seq_precision_at_k", lambda spark, sf: _p(seq_precision(spark, sf)),
            f"{_EVAL} SELECT *, {_PR} FROM (SELECT {_PK} FROM sco WHERE model = 'markov' GROUP BY model)")


def seq_compare(spark, sf):
    tests, probs = held_out(spark, sf)
    return _p(sq.precision_at(sq.markov_predictions(tests, probs), "markov").unionByName(
        sq.precision_at(sq.canonical_predictions(tests), "canonical")))


section.add("seq_compare", seq_compare, f"{_EVAL} SELECT *, {_PR} FROM (SELECT {_PK} FROM sco GROUP BY model)")


def seq_confusion(spark, sf):
    tests, probs = held_out(spark, sf)
    per_class = sq.class_f1(sq.confusion(sq.markov_predictions(tests, probs)))
    return per_class.selectExpr("label", "tp", "support", "guessed", "round(f1, 6) as f1").unionByName(
        sq.f1_summary(per_class).selectExpr("'macro/weighted' as label", "cast(null as bigint) as tp", "classes as support",
                                            "cast(round(weighted_f1 * 1000000) as bigint) as guessed", "round(macro_f1, 6) as f1"))


section.add("seq_confusion", seq_confusion, f"""{_EVAL[:-1]},
cf AS (SELECT truth, coalesce(predicted[1].tactic, 'none') AS guess, count(*) AS n FROM sco WHERE model = 'markov' GROUP BY ALL),
lab AS (SELECT truth AS label FROM cf UNION SELECT guess FROM cf),
cl AS (SELECT label, coalesce((SELECT sum(n) FROM cf WHERE truth = label AND guess = label), 0)::BIGINT AS tp, coalesce((SELECT sum(n) FROM cf WHERE truth = label), 0)::BIGINT AS support,
  coalesce((SELECT sum(n) FROM cf WHERE guess = label), 0)::BIGINT AS guessed FROM lab),
f AS (SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (support + guessed) END::DOUBLE AS f1 FROM cl)
SELECT label, tp, support, guessed, round(f1, 6) AS f1 FROM f UNION ALL
SELECT 'macro/weighted', NULL, count(*), round(sum(f1 * support) / sum(support) * 1000000)::BIGINT, round(avg(f1), 6) FROM f""")
section.add("seq_from_incidents", lambda spark, sf: sq.lists_from_incidents(incidents(spark, sf)).selectExpr(
    "seq_id", "array_join(tactics, ',') as tactics"), f"""{t.incident_base()} SELECT incident_id AS seq_id,
replace(array_to_string(tactics, ','), 'defense-evasion', 'stealth') AS tactics FROM inc WHERE len(tactics) > 0""")


# --- incident predictions -----------------------------------------------------------------------------
def predictions(spark, sf):
    return sq.incident_predictions(incidents(spark, sf), flagged(spark, sf), probabilities(spark, sf))


def _incident_sql():
    single = [t.SEQ_STEPS, t.markov_sql(), t.IOC, t.POINTS, t.LIGHT, "flg AS (SELECT entity, bool_or(cti_confirmed) AS cti FROM light GROUP BY 1)"]
    return t.incident_base(*single, f"""hd AS MATERIALIZED (SELECT * REPLACE (list_transform(tactics, lambda x: CASE x WHEN 'defense-evasion' THEN 'stealth' ELSE x END) AS tactics), coalesce(cti, FALSE) AS flag,
  CASE WHEN entity LIKE 'SRV-%' OR entity LIKE 'DB-%' THEN 'server' WHEN entity LIKE 'WKS-%' OR entity LIKE 'PC-%' THEN 'workstation' ELSE 'unknown' END AS etype
  FROM inc LEFT JOIN flg USING (entity) WHERE len(tactics) > 0)""", _canon_sql("hd", "incident_id", 2),
        _ranked_sql("incident_id", 2), f"""ch AS MATERIALIZED (SELECT hd.incident_id, n_seen > 0 AS learnt, CASE WHEN n_seen > 0 THEN p_end ELSE 0 END AS p_end,
  CASE WHEN n_seen > 0 THEN mkl.predicted ELSE cn.predicted END AS predicted FROM hd LEFT JOIN cn USING (incident_id) LEFT JOIN mkl USING (incident_id)
  JOIN (SELECT origin, sum(n) AS n_seen, max(p) FILTER (WHERE target = '<END>') AS p_end FROM prob GROUP BY 1) o ON o.origin = {_TAC}[deepest + 1])""",
        """rw AS (SELECT incident_id, list(struct_pack(tactic := tactic, p := p) ORDER BY p DESC, i) AS predicted FROM (
  SELECT incident_id, x.tactic AS tactic, i, least(1, x.p * CASE WHEN etype = 'server' AND x.tactic IN ('exfiltration', 'impact', 'command-and-control', 'collection') THEN 1.3 ELSE 1 END::DOUBLE
    * CASE WHEN risk >= 75 AND x.tactic IN ('exfiltration', 'impact', 'command-and-control', 'collection') THEN 1.2 ELSE 1 END::DOUBLE * CASE WHEN velocity >= 5 THEN 1.15 ELSE 1 END::DOUBLE
    * CASE WHEN flag AND x.tactic IN ('lateral-movement', 'command-and-control', 'exfiltration') THEN 1.4 ELSE 1 END::DOUBLE)::DOUBLE AS p
  FROM (SELECT incident_id, unnest(predicted) AS x, generate_subscripts(predicted, 1) AS i FROM ch) JOIN hd USING (incident_id)) GROUP BY 1)""",
        f"""pr AS MATERIALIZED (SELECT hd.*, rw.predicted, learnt, p_end, {_TAC}[deepest + 1] AS current_tactic,
  CASE WHEN learnt THEN coalesce(rw.predicted[1].p, 0) ELSE least(0.55::DOUBLE + 0.1::DOUBLE * least(len(tactics), 3) + CASE WHEN list_sort(list_transform(tactics, lambda x: list_position({_TAC}, x))) = list_transform(tactics, lambda x: list_position({_TAC}, x)) THEN 0.1::DOUBLE ELSE 0 END, 0.95)::DOUBLE END AS confidence
  FROM hd JOIN ch USING (incident_id) LEFT JOIN rw USING (incident_id))""")


_PRED = _incident_sql()
_PCT = "CASE WHEN x.p >= 0.1 THEN printf('%.0f%%', x.p * 100) WHEN x.p >= 0.01 THEN printf('%.1f%%', x.p * 100) ELSE printf('%.2f%%', x.p * 100) END"
_RATIONALE = f"""'Progression ' || array_to_string(tactics, ' > ') || '; deepest ' || current_tactic || ' (' || (deepest + 1) || '/15); ' ||
  CASE WHEN predicted IS NULL THEN 'no later phase is left' ELSE 'by ' || CASE WHEN learnt THEN '{sq.MODEL}' ELSE '{sq.ORDER}' END || ' next ' || array_to_string(list_transform(predicted, lambda x: x.tactic || ' (' || {_PCT} || ')'), ' or ') ||
  CASE WHEN p_end >= 0.3 THEN '; stops here with ' || printf('%.0f%%', p_end * 100) ELSE '' END || CASE WHEN etype = 'server' OR risk >= 75 OR velocity >= 5 OR flag THEN '; weighed up: ' || array_to_string(list_filter([
    CASE WHEN etype = 'server' THEN 'server' END, CASE WHEN risk >= 75 THEN 'high severity' END, CASE WHEN velocity >= 5 THEN 'fast' END, CASE WHEN flag THEN 'known campaign' END], lambda x: x IS NOT NULL), ', ') ELSE '' END END"""
section.add("incident_predict", lambda spark, sf: predictions(spark, sf).selectExpr(
    "incident_id", "current_tactic", "array_join(transform(predicted, x -> x.tactic), ',') as next", "round(confidence, 4) as confidence", "rationale"),
    f"""{_PRED} SELECT incident_id, current_tactic, coalesce(array_to_string(list_transform(predicted, lambda x: x.tactic), ','), '') AS next,
round(confidence, 4) AS confidence, {_RATIONALE} AS rationale FROM pr""")
section.add("incident_reweight", lambda spark, sf: predictions(spark, sf).selectExpr(
    "incident_id", "entity_type", "cti_flagged", "explode(predicted) as x").selectExpr(
    "incident_id", "entity_type", "cti_flagged", "x.tactic as tactic", "round(x.p, 6) as p"),
    f"""{_PRED} SELECT incident_id, etype AS entity_type, flag AS cti_flagged, x.tactic AS tactic, round(x.p, 6) AS p FROM (SELECT *, unnest(predicted) AS x FROM pr)""")


# --- response -----------------------------------------------------------------------------------------
def plans(spark, sf):
    return rs.verdicts(rs.plan(incidents(spark, sf)))


_ACTIONS = """act AS MATERIALIZED (SELECT incident_id, entity, x AS action, i AS priority FROM (SELECT incident_id, entity, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT *, list_filter([
  'enrich_context', 'notify_analyst', CASE WHEN list_contains(tactics, 'credential-access') THEN 'disable_account' END, CASE WHEN list_contains(tactics, 'credential-access') THEN 'reset_password' END,
  CASE WHEN list_contains(tactics, 'command-and-control') OR list_contains(tactics, 'exfiltration') THEN 'block_ip' END, CASE WHEN list_contains(tactics, 'lateral-movement') OR risk >= 70 THEN 'isolate_host' END,
  'snapshot_evidence'], lambda x: x IS NOT NULL) AS a FROM {0})))"""
_APPROVAL = "('isolate_host', 'block_ip', 'disable_account', 'reset_password')"
section.add("response_plan", lambda spark, sf: rs.plan(incidents(spark, sf)),
            f"{t.incident_base(_ACTIONS.format('inc'))} SELECT incident_id, entity, priority, action FROM act")
section.add("policy_verdict", lambda spark, sf: plans(spark, sf).selectExpr(
    "incident_id", "action", "decision", "policy", "sort_key"), f"""{t.incident_base(_ACTIONS.format('inc'))}
SELECT incident_id, action, CASE WHEN action IN {_APPROVAL} THEN 'requires_approval' ELSE 'allowed' END AS decision, action AS policy, priority AS sort_key FROM act""")


def blocklist_append(spark, sf):
    blocked = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("concat('203.0.113.', s_suppkey * 10 % 60) as ip").distinct()
    wanted = telemetry(spark, sf).where("category = 'network' and label = 1").selectExpr("src_ip as ip")
    added = rs.append_new(blocked, wanted, "ip")
    return blocked.selectExpr("ip", "'listed' as state").unionByName(added.selectExpr("ip", "'added' as state"))


section.add("blocklist_append", blocklist_append, f"""{t.with_(t.TEL, "b AS (SELECT DISTINCT '203.0.113.' || (s_suppkey * 10 % 60) AS ip FROM supplier)")}
SELECT ip, 'listed' AS state FROM b UNION ALL SELECT DISTINCT src_ip, 'added' FROM tel WHERE category = 'network' AND label = 1 AND src_ip NOT IN (SELECT ip FROM b)""")


def response_requests(spark, sf):
    findings = sc.reported(light(spark, sf)).selectExpr(
        "event_id as incident_id", "entity", "split(tactics, ',') as tactics", "hybrid_score as risk", "host", "user", "src_ip", "dst_ip")
    return rs.requests(findings)


section.add("response_requests", response_requests, f"""{t.light_base(
    "fnd AS (SELECT event_id AS incident_id, entity, string_split(tactics, ',') AS tactics, hybrid_score AS risk, host, \"user\", coalesce(dst_ip, src_ip) AS ip FROM light WHERE hybrid_score >= 50)",
    _ACTIONS.format('fnd'),
    "req AS (SELECT incident_id, act.entity, CASE action WHEN 'notify_analyst' THEN 'webhook_alert' WHEN 'snapshot_evidence' THEN 'ticket' ELSE action END AS request, host, \"user\", ip, CASE WHEN action IN " + _APPROVAL + " THEN 'needs_approval' ELSE 'automatic' END AS level, CASE action WHEN 'block_ip' THEN 'deny source ' || coalesce(ip, '?') WHEN 'isolate_host' THEN 'isolate ' || coalesce(host, '?') WHEN 'disable_account' THEN 'disable ' || coalesce(\"user\", '?') WHEN 'reset_password' THEN 'reset password of ' || coalesce(\"user\", '?') END AS command FROM act JOIN fnd USING (incident_id) WHERE action <> 'enrich_context')")}
SELECT * FROM req UNION ALL SELECT incident_id, entity, 'block_local', host, "user", ip, 'automatic', NULL FROM req WHERE request = 'block_ip' AND ip IS NOT NULL""")

# --- texts --------------------------------------------------------------------------------------------
section.add("explain_evidence", lambda spark, sf: ex.explain_events(light(spark, sf).withColumn(
    "detection_status", F.expr(sc.STATUS))), f"""{t.light_base()} SELECT event_id, CASE WHEN n_rules > 0 THEN 'Rules matched: ' || rules || '.' ELSE 'No rule matched this event.' END || ' ' ||
CASE WHEN anomaly_score >= 0.5 THEN printf('The anomaly model scores %.3f, above its boundary of 0.500.', anomaly_score) ELSE printf('The anomaly model scores %.3f, below its boundary.', anomaly_score) END || ' ' ||
CASE WHEN techniques <> '' THEN 'Techniques: ' || techniques || ' (tactics: ' || tactics || ').' ELSE 'No technique is attached.' END || ' ' ||
CASE WHEN n_cti > 0 THEN 'Threat intelligence matches: ' || n_cti || '.' ELSE 'No threat intelligence match.' END || ' ' ||
printf('Combined score %.1f/100 (%s).', hybrid_score, CASE WHEN n_rules > 0 AND anomaly_score >= 0.602 THEN 'RULE_AND_ANOMALY' WHEN n_rules > 0 THEN 'RULE_MATCH' WHEN anomaly_score >= 0.602 THEN 'ANOMALY_ONLY' ELSE 'NO_DETECTION' END) AS explanation FROM light""")


def explain_incident(spark, sf):
    rows = incidents(spark, sf)
    clusters = inc.clustered(found(spark, sf), t.GAP)
    return ex.explain_incidents(clusters, rows, sq.incident_predictions(rows, flagged(spark, sf), probabilities(spark, sf))).selectExpr(
        "incident_id", "summary", "reasoning", "prediction", "round(confidence, 3) as confidence")


section.add("explain_incident", explain_incident, f"""{_PRED} SELECT inc.incident_id,
'Incident on ' || inc.entity || ' with ' || inc.n_findings || ' finding(s), risk ' || inc.risk || '/100' AS summary,
inc.n_findings || ' findings between ' || strftime(inc.start_ts, '%Y-%m-%d %H:%M') || ' and ' || strftime(inc.end_ts, '%H:%M') || ' UTC. Techniques: ' ||
  CASE WHEN len(inc.techniques) = 0 THEN 'none' ELSE array_to_string(inc.techniques, ', ') END || '.' AS reasoning,
coalesce((SELECT {_RATIONALE} FROM pr WHERE pr.incident_id = inc.incident_id), 'Not enough progression for a prediction.') AS prediction,
round(0.6 * inc.mean_confidence + 0.4 * coalesce((SELECT confidence FROM pr WHERE pr.incident_id = inc.incident_id), 0.4), 3) AS confidence FROM inc""")
section.add("explain_incident_lines", lambda spark, sf: ex.evidence_lines(
    inc.clustered(found(spark, sf), t.GAP), telemetry(spark, sf)),
    f"""{t.with_(t.TEL, t.all_hits_sql(), t.FINDINGS, t.CLUSTERS, recursive=True)} SELECT clus.entity || '#' || session AS incident_id, event_id, rule_id,
'[' || strftime(clus.ts, '%H:%M:%S') || '] (' || source || ') ' || title || ' - conf. ' || printf('%.0f%%', confidence * 100) ||
CASE WHEN command_line IS NOT NULL THEN ' | cmd: ' || left(command_line, 120) WHEN src_ip IS NOT NULL THEN ' | src_ip: ' || src_ip ELSE '' END AS line FROM clus JOIN tel USING (event_id)""")

# --- coverage -------------------------------------------------------------------------------------------
section.add("nav_layer_incidents", lambda spark, sf: cov.incident_layer(incidents(spark, sf)),
            f"""{t.incident_base("x AS (SELECT incident_id, risk, unnest(techniques) AS technique FROM inc)")}
SELECT technique, score, n_incidents, worst, CASE WHEN score >= 70 THEN '#d62728' WHEN score >= 40 THEN '#ff7f0e' ELSE '#ffdd57' END AS color
FROM (SELECT technique, max(risk) AS score, count(*) AS n_incidents, arg_max(incident_id, struct_pack(r := risk, i := incident_id)) AS worst FROM x GROUP BY 1)""")


def firing(spark, sf):
    return det.rule_matches(telemetry(spark, sf)).select("rule_id", "technique")


_FIRE = t.with_(t.TEL, f"h AS ({t.hits_sql(cat.PER_EVENT)})", "tech(technique, name, tactic) AS (VALUES " + ", ".join(
    f"('{i}', {t.sql_text(n)}, '{c}')" for i, n, c in det.TECHNIQUES) + ")")
section.add("nav_layer_rules", lambda spark, sf: cov.rule_layer(firing(spark, sf)), f"""{_FIRE}
SELECT technique, count(DISTINCT rule_id) AS n_rules, array_to_string(list_sort(list_distinct(list(rule_id))), ',') AS rules FROM h GROUP BY 1""")
section.add("coverage_summary", lambda spark, sf: cov.coverage(firing(spark, sf)), f"""{_FIRE}
SELECT tactic, count(*) AS total, count(*) FILTER (WHERE technique IN (SELECT split_part(technique, '.', 1) FROM h)) AS covered,
round(count(*) FILTER (WHERE technique IN (SELECT split_part(technique, '.', 1) FROM h)) / count(*), 4) AS ratio FROM tech GROUP BY tactic""")


def set_coverage_gain(spark, sf):
    events = telemetry(spark, sf)
    native = det.rule_matches(events, [r for r in cat.NATIVE if not r.count]).select("technique").distinct()
    every = det.rule_matches(events).select("technique").distinct()
    new = every.exceptAll(native)
    both = every.intersect(native)
    return new.selectExpr("technique", "'new' as part").unionByName(both.selectExpr("technique", "'before' as part"))


_NATIVE_SQL = t.hits_sql([r for r in cat.NATIVE if not r.count])
section.add("set_coverage_gain", set_coverage_gain, f"""{t.with_(t.TEL, f"h AS ({t.hits_sql(cat.PER_EVENT)})", f"n AS ({_NATIVE_SQL})")}
SELECT DISTINCT technique, CASE WHEN technique IN (SELECT technique FROM n) THEN 'before' ELSE 'new' END AS part FROM h""")

"""Sources, normalisers, exports and sinks. Raw records are made from the telemetry and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from secflow.queries import tables as t
from secflow.queries.campaigns import light
from secflow.queries.operations import STORE
from secflow.queries.registry import Section
from secflow.plans import operations as ops
from secflow.plans import sequence as sq
from secflow.plans import anomaly, chain
from secflow.plans import catalogue as cat
from secflow.plans import cti
from secflow.plans import detection as det
from secflow.plans import scoring as sc
from secflow.plans.behaviour import profiles
from secflow.queries.campaigns import lists
from secflow.queries.scoring import context as intel_context
from secflow.settings import checkpointed, work_path
from secflow.sources import flows, intel, ocsf, prepared, sinks
from secflow.sources import normalize as n
from secflow.sources.telemetry import telemetry

section = Section()
_TEL = t.with_(t.TEL)
ISO = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
KEEP = "cast(event_id as string)"


def raw_json(spark, sf, where: str, fields: dict[str, str]):
    """Telemetry rows as JSON text in the shape of one source."""
    body = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return telemetry(spark, sf).where(where).selectExpr("event_id as _keep_id", f"to_json(named_struct({body})) as value")


def shown(df, *columns):
    return df.selectExpr("_keep_id as event_id", "unix_micros(ts) as micros", *columns)


_AUTH = {"source": "'auth'", "timestamp": ISO, "hostname": "host", "username": "user", "ip": "src_ip",
         "result": "if(outcome = 'failure', outcome, '')"}
section.add("norm_auth", lambda spark, sf: shown(n.auth(raw_json(spark, sf, "source = 'auth'", _AUTH)),
            "action", "host", "user", "src_ip", "outcome", "size(tags) as n_tags"),
            f"""{_TEL} SELECT event_id, epoch_us(ts) AS micros, 'user_login' AS action, host, "user", src_ip, CASE outcome WHEN 'failure' THEN outcome ELSE 'unknown' END AS outcome, 0 AS n_tags FROM tel WHERE source = 'auth'""")
_FLOW = {"source": "'netflow'", "stime": "cast(unix_micros(ts) / 1000000 as decimal(20, 6))", "srcip": "src_ip", "`id.resp_h`": "dst_ip",
         "dsport": "cast(dst_port as string)", "sbytes": "concat(bytes_out, '.0')", "resp_bytes": "bytes_in", "service": "if(k % 2 = 0, 'http', null)"}
_FLOW = {k.strip("`"): v for k, v in _FLOW.items()}
section.add("norm_netflow", lambda spark, sf: shown(n.netflow(raw_json(spark, sf, "source = 'netflow'", _FLOW)),
            "action", "src_ip", "dst_ip", "dst_port", "bytes_out", "bytes_in", "protocol", "outcome"),
            f"""{_TEL} SELECT event_id, epoch_us(ts) AS micros, action, src_ip, dst_ip, dst_port, bytes_out, bytes_in, CASE WHEN k % 2 = 0 THEN 'http' END AS protocol, 'unknown' AS outcome FROM tel WHERE source = 'netflow'""")
_WEB = {"source": "'web'", "@timestamp": "if(k % 9 = 0, 'yesterday', " + ISO + ")", "method": "upper(action)", "remote_addr": "src_ip", "uri": "command_line", "status": "cast(outcome as int)", "server": "host"}
section.add("norm_web", lambda spark, sf: shown(n.web(raw_json(spark, sf, "source = 'web'", _WEB)),
            "action", "host", "src_ip", "command_line", "outcome", "array_join(tags, ',') as tags"),
            f"""{_TEL} SELECT event_id, CASE WHEN k % 9 <> 0 THEN epoch_us(ts) END AS micros, 'GET' AS action, host, src_ip, command_line, outcome, CASE WHEN k % 9 = 0 THEN 'timestamp_invalido' ELSE '' END AS tags FROM tel WHERE source = 'web'""")
_SYS = {"source": "'sysmon'", "EventID": "k % 27", "UtcTime": "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", "Computer": "host", "User": "user", "Image": "process_name",
        "CommandLine": "if(k = 50, repeat(command_line, 400), command_line)", "ParentImage": "parent_process", "Hashes": "concat('SHA256=', upper(md5), ', MD5=', md5)",
        "ParentCommandLine": "if(k % 2 = 0, 'parent -x', null)", "IntegrityLevel": "'High'", "QueryName": "if(k % 27 = 22, concat('q', k, '.test'), '')"}
_SYSOUT = ["category", "action", "host", "user", "process_name", "length(command_line) as command_chars", "parent_process", "hashes['md5'] as md5", "hashes['sha256'] as sha256",
           "array_join(array_sort(transform(map_entries(properties), e -> concat(e.key, '=', e.value))), ',') as props", "array_join(tags, ',') as tags"]
_SYSCAT = " ".join(f"WHEN {i} THEN '{c}'" for i, (c, _) in n.SYSMON_EVENTS.items())
_SYSACT = " ".join(f"WHEN {i} THEN '{a}'" for i, (_, a) in n.SYSMON_EVENTS.items())
section.add("norm_sysmon", lambda spark, sf: shown(n.sysmon(raw_json(spark, sf, "source = 'sysmon'", _SYS)), *_SYSOUT),
            f"""{_TEL} SELECT event_id, epoch_us(ts) AS micros, CASE k % 27 {_SYSCAT} ELSE 'process' END AS category, CASE k % 27 {_SYSACT} ELSE 'sysmon_event_' || (k % 27) END AS action, host, "user", process_name,
least(8192, length(command_line) * CASE WHEN k = 50 THEN 400 ELSE 1 END)::INT AS command_chars, parent_process, md5, upper(md5) AS sha256,
'integrity_level=High,' || CASE WHEN k % 2 = 0 THEN 'parent_command_line=parent -x,' ELSE '' END || CASE WHEN k % 27 = 22 THEN 'query_name=q' || k || '.test,' ELSE '' END || 'sysmon_event_id=' || (k % 27) AS props,
CASE WHEN k = 50 AND length(command_line) * 400 > 8192 THEN 'campo_truncado' ELSE '' END AS tags FROM tel WHERE source = 'sysmon'""")

_XML = ("concat('<Event xmlns=\"http://schemas.test/win\"><System><Provider Name=\"Sysmon\"/><EventID>', k % 4, '</EventID><TimeCreated SystemTime=\"', " + ISO +
        ", '\"/><Computer>', host, '</Computer></System><EventData><Data Name=\"Image\">', process_name, '</Data><Data Name=\"User\">', user, '</Data></EventData></Event>')")
section.add("norm_sysmon_xml", lambda spark, sf: shown(n.sysmon_xml(telemetry(spark, sf).where("source = 'sysmon'").selectExpr(
    "event_id as _keep_id", f"{_XML} as value")), "category", "host", "user", "process_name"),
    f"""{_TEL} SELECT event_id, epoch_us(ts) AS micros, CASE k % 4 WHEN 2 THEN 'file' WHEN 3 THEN 'network' ELSE 'process' END AS category, host, "user", process_name FROM tel WHERE source = 'sysmon'""")

# --- system logs ----------------------------------------------------------------------------------------
_MSG = ("case k % 5 when 0 then concat('Failed password for invalid user ', user, ' from ', src_ip, if(k % 10 = 0, ':51234 ssh2', ' port 22')) "
        "when 1 then concat(if(k % 3 = 0, 'Message from daemon: ', ''), 'Accepted password for ', user, ' from ', src_ip) "
        "when 2 then 'Connection closed' when 3 then 'unit started' else 'pam check' end")
_PROG = "element_at(array('sshd', 'cron', 'systemd', 'sudo'), cast(k % 4 + 1 as int))"
_SQL_MSG = """CASE k % 5 WHEN 0 THEN 'Failed password for invalid user ' || "user" || ' from ' || src_ip || CASE WHEN k % 10 = 0 THEN ':51234 ssh2' ELSE ' port 22' END WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'Message from daemon: ' ELSE '' END || 'Accepted password for ' || "user" || ' from ' || src_ip WHEN 2 THEN 'Connection closed' WHEN 3 THEN 'unit started' ELSE 'pam check' END"""
_SQL_PROG = "['sshd', 'cron', 'systemd', 'sudo'][k % 4 + 1]"
_SQL_CLASS = """CASE WHEN k % 5 < 2 OR k % 4 IN (0, 3) THEN 'authentication' WHEN k % 5 = 2 THEN 'network' ELSE 'process' END AS category,
CASE WHEN k % 5 = 0 THEN 'failure' WHEN k % 5 = 1 THEN 'success' ELSE 'unknown' END AS outcome, CASE WHEN k % 5 < 2 THEN src_ip END AS src_ip"""
_JRN = {"source": "'linux'", "__REALTIME_TIMESTAMP": "cast(unix_micros(ts) as string)", "MESSAGE": _MSG, "_COMM": _PROG, "_HOSTNAME": "host", "_PID": "cast(k as string)", "_UID": "if(k % 6 = 0, '1000', null)"}
section.add("norm_journald", lambda spark, sf: shown(n.journald(raw_json(spark, sf, "source = 'auth'", _JRN)), "category", "outcome", "src_ip", "host", "user", "process_name", "command_line"),
            f"""{_TEL} SELECT event_id, epoch_us(ts) AS micros, {_SQL_CLASS}, host, CASE WHEN k % 6 = 0 THEN '1000' WHEN k % 5 < 2 THEN "user" END AS "user", {_SQL_PROG} AS process_name, {_SQL_MSG} AS command_line FROM tel WHERE source = 'auth'""")
_AS_OF = "2024-01-15 00:00:00"
_LINE = f"concat(if(k % 2 = 0, '<34>', ''), date_format(ts, 'MMM'), ' ', lpad(cast(day(ts) as string), 2, ' '), ' ', date_format(ts, 'HH:mm:ss'), ' ', host, ' ', {_PROG}, if(k % 3 = 0, concat('[', k, ']'), ''), ': ', {_MSG})"


def with_rejects(shown_rows, rejects):
    """Rejected lines beside the events: category is 'rejected', outcome the reason, the rest is null."""
    given = {"event_id": "_keep_id", "category": "'rejected'", "outcome": "reason"}
    return shown_rows.unionByName(rejects.selectExpr(*[
        f"cast({given.get(c, 'null')} as {t}) as `{c}`" for c, t in shown_rows.dtypes]))


def norm_syslog(spark, sf):
    lines = telemetry(spark, sf).where("source = 'auth'").selectExpr("event_id as _keep_id", f"if(k = 99, 'garbage', {_LINE}) as value")
    events, rejects = n.syslog(lines, _AS_OF)
    return with_rejects(events.selectExpr("_keep_id as event_id", "event_id as pid", "ts", "category", "outcome", "src_ip", "host", "user", "process_name", "properties['priority'] as pri"), rejects)


section.add("norm_syslog", norm_syslog, f"""{_TEL} SELECT event_id, CASE WHEN k % 3 = 0 THEN k::VARCHAR ELSE 'syslog' END AS pid,
CASE WHEN date_trunc('second', ts) <= TIMESTAMP '2024-01-16' THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - INTERVAL 1 YEAR END AS ts, {_SQL_CLASS}, host, CASE WHEN k % 5 < 2 THEN "user" END AS "user", {_SQL_PROG} AS process_name, CASE WHEN k % 2 = 0 THEN '34' END AS pri
FROM tel WHERE source = 'auth' AND k <> 99 UNION ALL SELECT event_id, NULL, NULL, 'rejected', 'unrecognised line', NULL, NULL, NULL, NULL, NULL FROM tel WHERE source = 'auth' AND k = 99""")
_AUD = ("concat('type=', element_at(array('USER_AUTH', 'EXECVE', 'PATH', 'SOCKADDR', 'CONFIG'), cast(k % 5 + 1 as int)), ' msg=audit(', cast(unix_micros(ts) / 1000000 as decimal(20, 3)), ':', event_id, "
        "'): acct=\"', coalesce(user, 'none'), '\" exe=\"/usr/bin/my app\" addr=', src_ip, if(k % 4 < 3, concat(' res=', element_at(array('yes', 'no', 'failed'), cast(k % 4 + 1 as int))), ''), ' exit=-', k)")


def norm_auditd(spark, sf):
    lines = telemetry(spark, sf).where("source in ('auth', 'netflow')").selectExpr("event_id as _keep_id", f"if(k = 7, concat('audit: ', {_AUD}), {_AUD}) as value")
    events, rejects = n.auditd(lines)
    return with_rejects(events.selectExpr("_keep_id as event_id", "event_id as serial", "unix_millis(ts) as millis", "category", "action", "user", "process_name", "src_ip", "outcome", "properties['return_code'] as code"), rejects)


section.add("norm_auditd", norm_auditd, f"""{_TEL} SELECT event_id, event_id::VARCHAR AS serial, round(epoch_us(ts) / 1000)::BIGINT AS millis, ['authentication', 'process', 'file', 'network', 'audit'][k % 5 + 1] AS category, ['user_login', 'process_create', 'file_access', 'network_connection', 'auditd_config'][k % 5 + 1] AS action,
coalesce("user", 'none') AS "user", '/usr/bin/my app' AS process_name, src_ip, ['success', 'failure', 'failure', 'unknown'][k % 4 + 1] AS outcome, (-k)::VARCHAR AS code FROM tel WHERE source IN ('auth', 'netflow') AND k <> 7
UNION ALL SELECT event_id, NULL, NULL, 'rejected', NULL, NULL, NULL, NULL, 'unrecognised line', NULL FROM tel WHERE source IN ('auth', 'netflow') AND k = 7""")
_ACT = "element_at(array('ALLOW', 'Deny', 'drop', 'accept', 'Rejected'), cast(k % 5 + 1 as int))"
_FWL = (f"concat('date=', date_format(ts, 'yyyy-MM-dd'), ' time=', date_format(ts, 'HH:mm:ss'), ' devname=\"', host, '\" SrcIP=', src_ip, ' dstip=', dst_ip, ' dport=', dst_port, ' sentbyte=', bytes_out, ' rcvdbyte=', bytes_in, if(k % 6 = 0, '', concat(' disposition=', {_ACT})), ' policyid=', k)")
_FWJ = {"timestamp": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "fw": "host", "saddr": "src_ip", "daddr": "dst_ip", "dpt": "dst_port", "bytes_sent": "bytes_out", "in": "bytes_in", "act": f"if(k % 6 = 0, null, {_ACT})", "ruleid": "k"}


def norm_firewall(spark, sf):
    body = ", ".join(f"'{k}', {v}" for k, v in _FWJ.items())
    rows = telemetry(spark, sf).where("source = 'firewall'").selectExpr("event_id as _keep_id", f"case when k = 8 then 'link is down' when k % 2 = 0 then {_FWL} else to_json(named_struct({body})) end as value")
    events, rejects = n.firewall_lines(rows)
    return with_rejects(events.selectExpr("_keep_id as event_id", "ts", "category", "action", "host", "src_ip", "dst_ip", "dst_port", "bytes_out", "bytes_in", "outcome", "properties['rule'] as rule"), rejects)


_SQL_ACT = "CASE WHEN k % 6 <> 0 THEN lower(['ALLOW', 'Deny', 'drop', 'accept', 'Rejected'][k % 5 + 1]) END"
section.add("norm_firewall", norm_firewall, f"""{_TEL} SELECT event_id, date_trunc('second', ts) AS ts, 'network' AS category, coalesce({_SQL_ACT}, 'connection') AS action, host, src_ip, dst_ip, dst_port, bytes_out, bytes_in,
CASE WHEN k % 6 = 0 THEN 'unknown' WHEN k % 5 IN (1, 2, 4) THEN 'failure' ELSE 'success' END AS outcome, k::VARCHAR AS rule FROM tel WHERE source = 'firewall' AND k <> 8
UNION ALL SELECT event_id, NULL, 'rejected', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unrecognised line', NULL FROM tel WHERE source = 'firewall' AND k = 8""")
_EVE = {"timestamp": ISO, "flow_id": "event_id", "event_type": "element_at(array('alert', 'flow', 'DNS'), cast(k % 3 + 1 as int))", "src_ip": "src_ip", "dest_ip": "dst_ip", "dest_port": "dst_port", "proto": "'TCP'",
        "alert": "if(k % 3 = 0, named_struct('signature', concat('ET SCAN ', k), 'severity', k % 5, 'signature_id', k), null)", "flow": "if(k % 3 = 1, named_struct('bytes_toserver', bytes_out, 'bytes_toclient', bytes_in, 'state', 'closed'), null)"}
section.add("norm_ids", lambda spark, sf: shown(n.ids(raw_json(spark, sf, "category = 'network'", _EVE)), "category", "action", "src_ip", "dst_ip", "dst_port", "bytes_out", "command_line", "properties['severity_label'] as level", "properties['state'] as state"),
            f"""{_TEL} SELECT event_id, epoch_us(ts) AS micros, CASE k % 3 WHEN 0 THEN 'ids' ELSE 'network' END AS category, ['ids_alert', 'network_flow', 'suricata_dns'][k % 3 + 1] AS action, src_ip, dst_ip, dst_port, CASE WHEN k % 3 = 1 THEN bytes_out END AS bytes_out,
CASE WHEN k % 3 = 0 THEN 'ET SCAN ' || k END AS command_line, CASE WHEN k % 3 = 0 THEN ['unknown', 'critical', 'high', 'medium', 'low'][k % 5 + 1] END AS level, CASE WHEN k % 3 = 1 THEN 'closed' END AS state FROM tel WHERE category = 'network'""")
_HID = {"timestamp": ISO, "rule": "named_struct('id', concat('R', k), 'level', k % 16, 'description', element_at(array('sshd: login failed', 'File added', 'Accepted key', 'Web request'), cast(k % 4 + 1 as int)), 'groups', array('syslog', if(k % 8 = 3, 'pam', 'web')))",
        "agent": "named_struct('id', cast(u as string), 'name', host)", "data": "named_struct('srcip', if(k % 2 = 1, src_ip, null), 'dstuser', user)", "id": "if(k % 3 = 0, cast(event_id as string), null)"}
section.add("norm_hids", lambda spark, sf: shown(n.hids(raw_json(spark, sf, "source = 'auth'", _HID)), "event_id as alert_id", "category", "action", "host", "user", "src_ip", "outcome", "properties['rule_severity'] as level"),
            f"""{_TEL} SELECT event_id, epoch_us(ts) AS micros, CASE WHEN k % 3 = 0 THEN event_id::VARCHAR ELSE 'wazuh-R' || k || '-' || u || '-' || round(epoch_us(ts) / 1e6)::BIGINT END AS alert_id,
CASE WHEN k % 4 = 0 OR k % 8 = 3 THEN 'authentication' WHEN k % 2 = 1 THEN 'network' ELSE 'process' END AS category, ['sshd: login failed', 'File added', 'Accepted key', 'Web request'][k % 4 + 1] AS action, host, "user",
CASE WHEN k % 2 = 1 THEN src_ip END AS src_ip, CASE k % 4 WHEN 0 THEN 'failure' WHEN 2 THEN 'success' ELSE 'unknown' END AS outcome, CASE WHEN k % 16 >= 12 THEN 'critical' WHEN k % 16 >= 8 THEN 'high' WHEN k % 16 >= 4 THEN 'medium' ELSE 'low' END AS level
FROM tel WHERE source = 'auth'""")

# --- dispatch, guard, counters --------------------------------------------------------------------------
_ANY = {"source": "if(k % 25 = 0, 'Mainframe', upper(source))", "timestamp": "if(k % 20 = 1, 'not a time', " + ISO + ")", "host": "host", "user": "user", "src_ip": "src_ip", "dst_ip": "dst_ip", "dst_port": "dst_port", "bytes_out": "bytes_out",
        "command_line": "if(category = 'process' and k % 10 = 3, repeat('x', 9000), command_line)", "url": "command_line", "outcome": "outcome", "status": "outcome", "action": "action"}


def norm_dispatch(spark, sf):
    return n.dispatch(raw_json(spark, sf, "true", _ANY)).selectExpr("_keep_id as event_id", "source", "category", "host", "array_join(array_sort(tags), ',') as tags")


_TAGS = "array_to_string(list_sort(list_filter([CASE WHEN k % 20 = 1 THEN 'timestamp_invalido' END, CASE WHEN k % 25 = 0 THEN 'fuente_desconocida' END, CASE WHEN category = 'process' AND k % 10 = 3 THEN 'campo_truncado' END], lambda x: x IS NOT NULL)), ',')"
section.add("norm_dispatch", norm_dispatch, f"""{_TEL} SELECT event_id, CASE WHEN k % 25 = 0 THEN 'sysmon' ELSE source END AS source, CASE WHEN k % 25 = 0 THEN 'process' ELSE category END AS category, host, {_TAGS} AS tags FROM tel""")


def norm_guard(spark, sf):
    good, large = n.guarded(raw_json(spark, sf, "source = 'sysmon'", _ANY).selectExpr("_keep_id", "if(_keep_id % 50 = 0, concat(value, repeat(' ', 20000)), value) as value"), "sysmon", 20000)
    cut = n.trimmed(n.sysmon(good), "sysmon", 20).selectExpr("_keep_id as event_id", "length(command_line) as chars", "array_join(tags, ',') as tags")
    return cut.unionByName(large.groupBy("reason").agg(F.count("*").alias("c")).selectExpr("-1L as event_id", "cast(c as int) as chars", "reason as tags"))


section.add("norm_guard", norm_guard, f"""{_TEL} SELECT event_id, CASE WHEN k % 10 = 3 THEN 20 ELSE least(20, length(command_line)) END::INT AS chars,
array_to_string(list_filter([CASE WHEN k % 20 = 1 THEN 'timestamp_invalido' END, CASE WHEN k % 10 = 3 OR length(command_line) > 20 THEN 'campo_truncado' END, 'collector:sysmon'], lambda x: x IS NOT NULL), ',') AS tags
FROM tel WHERE source = 'sysmon' AND event_id % 50 <> 0 UNION ALL SELECT -1, count(*)::INT, 'payload too large' FROM tel WHERE source = 'sysmon' AND event_id % 50 = 0 HAVING count(*) > 0""")


def norm_stats(spark, sf):
    raw = raw_json(spark, sf, "true", _ANY).selectExpr("_keep_id", "case when _keep_id % 40 = 0 then concat(value, repeat(' ', 20000)) when _keep_id % 40 = 1 then left(value, 20) else value end as value")
    good, rejects = n.accepted(raw, 20000)
    return n.stats(n.dispatch(good), rejects)


section.add("norm_stats", norm_stats, f"""{_TEL} SELECT source, coalesce(p, 0) AS processed, coalesce(i, 0) AS invalid_time, coalesce(c, 0) AS trimmed, coalesce(o, 0) AS oversized, coalesce(f, 0) AS failed, coalesce(o, 0) + coalesce(f, 0) AS rejected FROM
(SELECT CASE WHEN k % 25 = 0 THEN 'sysmon' ELSE source END AS source, count(*) AS p, count(*) FILTER (WHERE k % 20 = 1) AS i, count(*) FILTER (WHERE category = 'process' AND k % 10 = 3) AS c FROM tel WHERE event_id % 40 > 1 GROUP BY 1)
FULL JOIN (SELECT source, count(*) FILTER (WHERE NOT bad) AS o, count(*) FILTER (WHERE bad) AS f FROM (SELECT CASE WHEN event_id % 40 = 1 THEN 'unknown' WHEN k % 25 = 0 THEN 'mainframe' ELSE source END AS source, event_id % 40 = 1 AS bad FROM tel WHERE event_id % 40 < 2) GROUP BY 1) USING (source)""")
_SUB = {"source": "case when k % 13 = 0 then '  ' when k % 25 = 0 then 'mainframe' else source end", "timestamp": "case when k % 20 = 1 then 'soon' when k % 7 = 0 then null else " + ISO + " end", "event_id": "if(k % 4 = 0, null, cast(event_id as string))"}


def norm_reject(spark, sf):
    rows = n.submitted(raw_json(spark, sf, "true", _SUB))
    bad = rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).selectExpr("'rejected' as part", "reason as name", "n")
    notes = rows.where("reason is null").selectExpr("explode(annotations) as name").groupBy("name").agg(F.count("*").alias("n")).selectExpr("'note' as part", "name", "n")
    return bad.unionByName(notes)


section.add("norm_reject", norm_reject, f"""{t.with_(t.TEL, "r AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'empty source' WHEN k % 20 = 1 THEN 'unreadable time' END AS reason FROM tel)")}
SELECT 'rejected' AS part, reason AS name, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 2 UNION ALL SELECT 'note', 'event_id_generado', count(*) FROM r WHERE reason IS NULL AND k % 4 = 0
UNION ALL SELECT 'note', 'timestamp_de_recepcion', count(*) FROM r WHERE reason IS NULL AND k % 7 = 0 AND k % 20 <> 1 UNION ALL SELECT 'note', 'fuente_sin_parser_dedicado', count(*) FROM r WHERE reason IS NULL AND k % 25 = 0""")


# --- scans ------------------------------------------------------------------------------------------------
def src_jsonl(spark, sf):
    path = work_path(spark, "jsonl")
    raw_json(spark, sf, "true", _ANY).selectExpr(
        "case when _keep_id % 30 = 0 then concat('{broken', _keep_id) when _keep_id % 31 = 0 then '   ' else value end as value").write.text(path)
    good, bad = flows.read_json_lines(spark.read.text(path))
    events = n.dispatch(good)
    return events.groupBy("source").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).unionByName(
        bad.groupBy("reason").agg(F.count("*").alias("n")).selectExpr("reason as source", "n", "cast(null as timestamp) as first_ts", "cast(null as timestamp) as last_ts"))


section.add("src_jsonl", src_jsonl, f"""{_TEL} SELECT CASE WHEN k % 25 = 0 THEN 'sysmon' ELSE source END AS source, count(*) AS n, min(CASE WHEN k % 20 <> 1 THEN ts END) AS first_ts, max(CASE WHEN k % 20 <> 1 THEN ts END) AS last_ts
FROM tel WHERE event_id % 30 <> 0 AND event_id % 31 <> 0 GROUP BY 1 UNION ALL SELECT 'invalid JSON', count(*), NULL, NULL FROM tel WHERE event_id % 30 = 0""")

_RAWFLOW = {"srcip": "src_ip", "sport": "if(k % 5 = 0, concat('0x', hex(k + 1024)), cast(k + 1024 as string))", "dstip": "if(k % 9 = 0, '-', concat(' ', dst_ip, ' '))", "dsport": "concat(dst_port, '.0')", "proto": "if(k % 4 = 0, '-', 'tcp')",
            "state": "if(k % 3 = 0, '', 'FIN')", "dur": "if(k % 11 = 0, 'Infinity', cast(v as string))", "sbytes": "bytes_out", "dbytes": "bytes_in", "service": "'http'", "spkts": "k", "swin": "if(k % 2 = 0, '0x000b', '255')",
            "stime": "if(k % 10 = 0, '', cast(unix_seconds(ts) as string))", "attack_cat": "case when label = 0 then '' when k % 2 = 0 then ' Backdoors ' else 'Exploits' end", "label": "label"}


def flow_lines(spark, sf):
    cells = ", ".join(f"coalesce(cast({_RAWFLOW[c]} as string), '')" if c in _RAWFLOW else "''" for c in flows.RAW_COLUMNS)
    return telemetry(spark, sf).where("category = 'network'").selectExpr("event_id", f"concat_ws(',', {cells}) as value")


def parsed_flows(spark, sf):
    schema = ", ".join(f"{c} string" for c in flows.RAW_COLUMNS)
    return flow_lines(spark, sf).select("event_id", F.from_csv("value", schema).alias("r")).select("event_id", "r.*")


section.add("src_flow_clean", lambda spark, sf: parsed_flows(spark, sf).selectExpr(
    "event_id", f"{flows.clean_value('dstip')} as dstip", f"{flows.whole(flows.clean_value('sport'))} as sport", f"{flows.whole(flows.clean_value('dsport'))} as dsport",
    f"{flows.clean_value('swin')} as swin", f"round({flows.finite('dur')}, 4) as dur", f"{flows.clean_value('proto')} as proto"),
    f"""{_TEL} SELECT event_id, CASE WHEN k % 9 <> 0 THEN dst_ip END AS dstip, (k + 1024)::INT AS sport, dst_port AS dsport, CASE WHEN k % 2 = 1 THEN '255' END AS swin,
CASE WHEN k % 11 = 0 THEN 0 ELSE round(v, 4) END::DOUBLE AS dur, CASE WHEN k % 4 <> 0 THEN 'tcp' END AS proto FROM tel WHERE category = 'network'""")
_FLOWOUT = ["event_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_out", "outcome", "label", "attack_cat", "array_join(unavailable, ',') as unavailable", "properties['swin'] as swin", "properties['packets_out'] as packets_out", "array_join(tags, ',') as tags"]


def src_flow_events(spark, sf):
    return flows.flow_events(parsed_flows(spark, sf).withColumnRenamed("event_id", "line_no"), "concat('flows.csv:', line_no)", "line_no").selectExpr(*_FLOWOUT)


_FLOWSQL = """SELECT 'flows.csv:' || event_id AS event_id, CASE WHEN k % 10 = 0 THEN TIMESTAMP '2015-01-01' + to_seconds(event_id) ELSE date_trunc('second', ts) END AS ts, src_ip, CASE WHEN k % 9 <> 0 THEN dst_ip END AS dst_ip, (k + 1024)::INT AS src_port, dst_port,
CASE WHEN k % 4 = 0 THEN 'http' ELSE 'tcp' END AS protocol, bytes_out, CASE WHEN k % 3 = 0 THEN 'unknown' ELSE 'FIN' END AS outcome, label, CASE WHEN label = 0 THEN 'Normal' WHEN k % 2 = 0 THEN 'Backdoor' ELSE 'Exploits' END AS attack_cat,
CASE WHEN k % 10 = 0 THEN 'timestamp' ELSE '' END AS unavailable, CASE WHEN k % 2 = 1 THEN '255' END AS swin, k || '.0' AS packets_out, CASE WHEN label = 0 THEN 'benign' WHEN k % 2 = 0 THEN 'attack:Backdoor' ELSE 'attack:Exploits' END AS tags FROM tel WHERE category = 'network'"""
section.add("src_flow_events", src_flow_events, f"{_TEL} {_FLOWSQL}")


def src_flow_csv(spark, sf):
    """Written as headerless text with a byte-order mark and blank lines, then read back."""
    path = work_path(spark, "flows")
    flow_lines(spark, sf).selectExpr("explode(array(concat(char(65279), value), '')) as value").write.text(path)
    rows = flows.read_flow_csv(spark, path)
    return flows.flow_events(rows.withColumn("line_no", F.lit(0)), "srcip", "line_no").groupBy("attack_cat", "label").agg(
        F.count("*").alias("n"), F.sum("bytes_out").alias("bytes_out"), F.count_distinct("src_ip").alias("sources"))


section.add("src_flow_csv", src_flow_csv, f"""{t.with_(t.TEL, f"f AS ({_FLOWSQL})")} SELECT attack_cat, label, count(*) AS n, sum(bytes_out)::BIGINT AS bytes_out, count(DISTINCT src_ip) AS sources FROM f GROUP BY ALL""")


def src_cic_csv(spark, sf):
    path = work_path(spark, "cic")
    telemetry(spark, sf).where("category = 'network'").selectExpr(
        "event_id as `Flow ID`", "concat(' ', src_ip) as ` Source IP`", "dst_ip as ` Destination IP`", "dst_port as ` Destination Port`",
        "case k % 4 when 0 then date_format(ts, 'd/M/yyyy H:mm') when 1 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') when 2 then date_format(ts, 'dd/MM/yyyy hh:mm:ss a') else 'x' end as ` Timestamp`",
        "bytes_out as `Total Length of Fwd Packets`", "if(k % 8 = 0, 'Infinity', 'NaN') as `Flow Bytes/s`",
        "case when label = 0 then 'BENIGN' else concat('Web Attack ', char(150), ' Brute Force') end as ` Label`").write.csv(path, header=True, encoding="iso-8859-1")
    return flows.cic_events(flows.read_cic_csv(spark, path), "2024-03-01 00:00:00").selectExpr("cast(event_id as bigint) as event_id", "ts", "src_ip", "dst_ip", "dst_port", "bytes_out", "label", "attack_cat")


section.add("src_cic_csv", src_cic_csv, f"""{_TEL} SELECT event_id, CASE k % 4 WHEN 0 THEN date_trunc('minute', ts) WHEN 3 THEN TIMESTAMP '2024-03-01' ELSE date_trunc('second', ts) END AS ts, src_ip, dst_ip, dst_port, bytes_out, label,
CASE WHEN label = 0 THEN 'BENIGN' ELSE 'Web Attack - Brute Force' END AS attack_cat FROM tel WHERE category = 'network'""")
_WIN = {"@timestamp": ISO, "EventID": "element_at(array(4624, 4625, 3, 1, 4776), cast(k % 5 + 1 as int))", "Hostname": "host", "TargetUserName": "user", "User": "concat('D\\\\', user)", "IpAddress": "src_ip", "SourceIp": "dst_ip", "Image": "process_name", "CommandLine": "command_line", "DestinationPort": "'3389'"}
section.add("src_windows_json", lambda spark, sf: shown(flows.windows_events(raw_json(spark, sf, "source in ('auth', 'sysmon')", _WIN), "T1003"), "source", "category", "action", "user", "src_ip", "dst_port", "process_name", "outcome", "array_join(tags, ',') as tags"),
            f"""{_TEL} SELECT event_id, epoch_us(ts) AS micros, CASE WHEN k % 5 IN (0, 1, 4) THEN 'auth' ELSE 'sysmon' END AS source, ['authentication', 'authentication', 'network', 'process', 'authentication'][k % 5 + 1] AS category,
['user_login', 'user_login', 'event_3', 'event_1', 'user_login'][k % 5 + 1] AS action, CASE WHEN k % 5 IN (0, 1, 4) THEN "user" ELSE 'D\\' || "user" END AS "user", CASE WHEN k % 5 IN (0, 1, 4) THEN src_ip ELSE dst_ip END AS src_ip, CASE WHEN k % 5 IN (2, 3) THEN 3389 END AS dst_port,
CASE WHEN k % 5 IN (2, 3) THEN process_name END AS process_name, ['success', 'failure', 'unknown', 'unknown', 'success'][k % 5 + 1] AS outcome, 'technique:T1003' AS tags FROM tel WHERE source IN ('auth', 'sysmon')""")


def src_multi_file_limit(spark, sf):
    paths = []
    for name in ("auth", "web"):
        paths.append(work_path(spark, name))
        telemetry(spark, sf).where(f"source = '{name}'").selectExpr("event_id", "cast(ts as string) as ts", "source").write.csv(paths[-1])
    rows = spark.read.schema("event_id bigint, ts timestamp, source string").csv(paths)
    return rows.orderBy("source", "ts", "event_id").limit(2500)


section.add("src_multi_file_limit", src_multi_file_limit, f"{_TEL} SELECT event_id, ts, source FROM tel WHERE source IN ('auth', 'web') ORDER BY source, tel.ts, event_id LIMIT 2500")


# --- exports ----------------------------------------------------------------------------------------------
def as_schema(events):
    from secflow.schema import EVENT_FIELDS
    have = set(events.columns)
    extra = {"properties": "map('level', if(k % 2 = 0, 'a', 'b'))", "tags": "if(k % 3 = 0, array('x'), cast(array() as array<string>))"}
    return events.selectExpr(*[f"cast({extra.get(c, c if c in have else 'null')} as {d.simpleString()}) as `{c}`" for c, d in EVENT_FIELDS])


def to_ocsf(spark, sf):
    return ocsf.to_documents(as_schema(telemetry(spark, sf))).selectExpr(
        "cast(event_id as bigint) as event_id", "class_uid", "cast(get_json_object(document, '$.type_uid') as int) as type_uid", "cast(get_json_object(document, '$.time') as bigint) as time",
        "get_json_object(document, '$.status_id') as status_id", "get_json_object(document, '$.category_name') as category_name", "get_json_object(document, '$.device.hostname') as hostname", "array_join(json_object_keys(document), ',') as members")


_OC = """CASE category WHEN 'process' THEN 1007 WHEN 'authentication' THEN 3002 WHEN 'network' THEN 4001 ELSE 0 END"""
_OA = "CASE WHEN category IN ('process', 'authentication') THEN 1 ELSE 99 END"
section.add("to_ocsf", to_ocsf, f"""{_TEL} SELECT event_id, {_OC}::INT AS class_uid, ({_OC} * 100 + {_OA})::INT AS type_uid, epoch_us(ts) // 1000 AS time, CASE outcome WHEN 'success' THEN '1' WHEN 'failure' THEN '2' ELSE '0' END AS status_id,
CASE category WHEN 'process' THEN 'System Activity' WHEN 'authentication' THEN 'Identity & Access Management' WHEN 'network' THEN 'Network Activity' ELSE 'Uncategorized' END AS category_name, host AS hostname,
'class_uid,class_name,category_uid,category_name,activity_id,type_uid,time,severity_id,status_id,status,metadata,unmapped,' || CASE WHEN "user" IS NOT NULL THEN 'actor,' ELSE '' END || 'device,' || CASE WHEN command_line IS NOT NULL THEN 'process,' ELSE '' END || 'src_endpoint,dst_endpoint'
  || CASE WHEN bytes_in IS NOT NULL THEN ',connection_info,traffic' ELSE '' END AS members FROM tel""")


def from_ocsf(spark, sf):
    docs = ocsf.to_documents(as_schema(telemetry(spark, sf))).selectExpr("event_id as _keep_id", "if(event_id % 10 = 0, replace(document, '\"x_', '\"y_'), document) as document")
    return ocsf.from_documents(docs).selectExpr("cast(_keep_id as bigint) as event_id", "unix_millis(ts) as millis", "source", "category", "action", "host", "user", "src_ip", "dst_port", "bytes_out", "command_line", "outcome", "properties['level'] as level")


section.add("from_ocsf", from_ocsf, f"""{_TEL} SELECT event_id, epoch_us(ts) // 1000 AS millis, CASE WHEN event_id % 10 = 0 THEN 'ocsf' ELSE source END AS source, CASE WHEN event_id % 10 <> 0 THEN category WHEN category = 'web' THEN 'unknown' ELSE category END AS category,
CASE WHEN event_id % 10 = 0 THEN 'ocsf_class_' || {_OC} ELSE action END AS action, host, "user", src_ip, dst_port, bytes_out, command_line, outcome, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS level FROM tel""")
section.add("fingerprint_dedup", lambda spark, sf: sinks.deduplicated(telemetry(spark, sf).withColumn("ts", F.expr("if(k % 2 = 0, date_trunc('day', ts), ts)"))),
            f"""{t.with_(t.TEL, '''f AS (SELECT event_id, ts2, left(sha256(strftime(ts2, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts2) % 1000000 = 0 THEN '' ELSE strftime(ts2, '.%f') END || '+00:00|' || coalesce(source, 'None') || '|' || coalesce(action, 'None') || '|' || coalesce(host, 'None') || '|' || coalesce("user", 'None') || '|' || coalesce(command_line, 'None')), 16) AS fingerprint
  FROM (SELECT *, CASE WHEN k % 2 = 0 THEN date_trunc('day', ts) ELSE ts END AS ts2 FROM tel))''')} SELECT fingerprint, arg_min(event_id, struct_pack(a := ts2, b := event_id)) AS event_id, count(*) AS copies FROM f GROUP BY 1""")


# --- sinks ------------------------------------------------------------------------------------------------
def with_status(spark, sf):
    from secflow.plans.scoring import STATUS
    return light(spark, sf).withColumn("detection_status", F.expr(STATUS))


def snk_processed_events(spark, sf):
    path = work_path(spark, "processed")
    sinks.write_processed(sinks.processed_rows(with_status(spark, sf)), path)
    return spark.read.parquet(path).groupBy("day", "result").agg(
        F.count("*").alias("n"), F.count("incident_id").alias("incidents"), F.round(F.max("score"), 3).alias("max_score"))


_ST = "CASE WHEN n_rules > 0 AND anomaly_score >= 0.602 THEN 'RULE_AND_ANOMALY' WHEN n_rules > 0 THEN 'RULE_MATCH' WHEN anomaly_score >= 0.602 THEN 'ANOMALY_ONLY' ELSE 'NO_DETECTION' END"
section.add("snk_processed_events", snk_processed_events, f"""{t.light_base()} SELECT ts::DATE AS day, {_ST} AS result, count(*) AS n, count(*) FILTER (WHERE hybrid_score >= 50) AS incidents, round(max(hybrid_score), 3) AS max_score FROM light GROUP BY ALL""")


def snk_report_json(spark, sf):
    path = work_path(spark, "report")
    sinks.report_lines(sinks.processed_rows(with_status(spark, sf)).drop("day")).write.text(path)
    return spark.read.text(path).selectExpr("cast(get_json_object(value, '$.event_id') as bigint) as event_id", "get_json_object(value, '$.result') as result",
                                            "round(cast(get_json_object(value, '$.score') as double), 3) as score", "get_json_object(value, '$.incident_id') as incident_id")


section.add("snk_report_json", snk_report_json, f"""{t.light_base()} SELECT event_id, {_ST} AS result, round(hybrid_score, 3) AS score, CASE WHEN hybrid_score >= 50 THEN 'E' || event_id END AS incident_id FROM light""")


def snk_model(spark, sf):
    counts, people = work_path(spark, "transitions"), work_path(spark, "baselines")
    sq.transition_counts(lists(spark, sf)).write.parquet(counts)
    profiles(telemetry(spark, sf)).write.parquet(people)
    model = sq.transition_probabilities(spark.read.parquet(counts)).selectExpr("concat(origin, '>', target) as name", "n", "round(p, 6) as p")
    return model.unionByName(spark.read.parquet(people).selectExpr("concat(type, ':', entity) as name", "n_events as n", "cast(size(hours) as double) as p"))


section.add("snk_model", snk_model, f"""{t.with_(t.TEL, t.SEQ_STEPS, t.markov_sql())} SELECT origin || '>' || target AS name, n, round(p, 6) AS p FROM prob
UNION ALL SELECT 'user:' || "user", count(*), count(DISTINCT hour(ts)) FROM tel WHERE "user" IS NOT NULL GROUP BY "user" UNION ALL SELECT 'host:' || host, count(*), count(DISTINCT hour(ts)) FROM tel GROUP BY host""")


def snk_idempotent(spark, sf):
    """Every incident is delivered twice to a store that holds a third of them; one 'created' entry each."""
    path = work_path(spark, "incidents")
    store = ops.order_store(spark, sf)
    store.where("right(incident_id, 1) in ('0', '3', '6')").write.parquet(path)
    new = sinks.append_incidents(spark.read.parquet(path), store.unionByName(store))
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("severity", "state").agg(F.count("*").alias("n"), F.count_distinct("incident_id").alias("ids"))


section.add("snk_idempotent", snk_idempotent, f"{t.with_(STORE)} SELECT severity, state, count(*) AS n, count(DISTINCT incident_id) AS ids FROM sto GROUP BY ALL")


# --- from raw records to scored hosts -----------------------------------------------------------------------
_CHAIN = {"source": "source", "timestamp": ISO, "UtcTime": "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", "EventID": "if(source = 'sysmon', 1, null)", "event_id": "'same'",
          "host": "host", "user": "user", "src_ip": "src_ip", "dst_ip": "dst_ip", "dst_port": "dst_port", "bytes_out": "bytes_out", "bytes_in": "bytes_in", "Image": "process_name",
          "CommandLine": "if(source = 'sysmon', command_line, null)", "ParentImage": "parent_process", "Hashes": "if(md5 is null, null, concat('MD5=', md5))",
          "url": "if(source = 'web', command_line, null)", "outcome": "if(source = 'web', null, outcome)", "status": "if(source = 'web', outcome, null)", "action": "action"}


def from_raw(spark, sf):
    """Telemetry as raw JSON of its sources, all with the same few ids, read back by the normalisers."""
    return prepared.referenced(n.dispatch(raw_json(spark, sf, "true", _CHAIN)))


def pipeline_end_to_end(spark, sf):
    """Raw records to rule evidence per event, joined by the events' own references."""
    events = from_raw(spark, sf)
    evidence = sc.rule_evidence(det.rule_matches(events))
    seen = cti.observables(events).groupBy("event_id").agg(F.count("*").alias("observables"))
    return (events.join(evidence, "event_id", "left").join(seen, "event_id", "left")
            .selectExpr("_keep_id as event_id", "host", "source", "coalesce(rules, '') as rules", "coalesce(n_rules, 0) as n_rules", "observables"))


section.add("pipeline_end_to_end", pipeline_end_to_end, f"""{t.with_(t.TEL, f"h AS ({t.hits_sql(cat.PER_EVENT)})", "g AS (SELECT event_id, array_to_string(list_sort(list_distinct(list(rule_id))), ',') AS rules, count(*) AS n_rules FROM h GROUP BY 1)")}
SELECT event_id, host, source, coalesce(rules, '') AS rules, coalesce(n_rules, 0) AS n_rules, len(list_distinct(list_filter([src_ip, CASE WHEN source IN ('netflow', 'firewall', 'sysmon') THEN dst_ip END, CASE WHEN source = 'sysmon' THEN md5 END], lambda x: x IS NOT NULL))) AS observables FROM tel LEFT JOIN g USING (event_id)""")


def raw_to_incidents(spark, sf):
    """Raw records to features, forest, behaviour, indicators, score and incidents; no SQL form, as the forest has none.

    One row per event with its score, and one per incident.
    """
    events, folder = checkpointed(from_raw(spark, sf)), work_path(spark, "model")
    # The raw records have no labels: the forest learns from every other record.
    anomaly.fit(events, "event_id % 2 = 0", folder, t.FEATURE_WINDOW)
    evidence, incidents, _ = chain.scored(
        events, anomaly.load(spark, folder), intel_context(spark, sf), intel.reputation(spark, sf, t.REPUTATION_TTL),
        chain.Options(t.AS_OF, t.VOLUME_WINDOWS, t.SEQUENCE_WINDOWS, t.GAP))
    kept = events.select("event_id", "_keep_id").groupBy("event_id").agg(F.min("_keep_id").alias("kept"))
    rows = evidence.join(kept, "event_id").selectExpr(
        "'event' as kind", "cast(kept as string) as id", "entity", "detection_status as status", "rules as detail",
        "round(hybrid_score, 3) as score")
    return rows.unionByName(incidents.selectExpr(
        "'incident' as kind", "incident_id as id", "entity", "array_join(tactics, ',') as status",
        "array_join(techniques, ',') as detail", "cast(risk as double) as score"))


section.add("raw_to_incidents", raw_to_incidents)

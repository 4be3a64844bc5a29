"""Raw formats on small fixtures."""

from __future__ import annotations

from datetime import datetime

import pytest

from secflow.sources import flows, intel, ocsf
from secflow.sources import normalize as n


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("text,want", [
    ("2024-03-01T10:00:00.250+02:00", datetime(2024, 3, 1, 8, 0, 0, 250000)), ("2024-03-01T10:00:00Z", datetime(2024, 3, 1, 10)),
    ("2024-03-01 10:00:00", datetime(2024, 3, 1, 10)), ("2024/03/01 10:00:00", datetime(2024, 3, 1, 10)),
    ("2024-03-01T10:00:00+0200", datetime(2024, 3, 1, 8)), ("1709287200", datetime(2024, 3, 1, 10)), ("yesterday", None)])
def test_times(spark, text, want):
    row = one(n.auth(lines(spark, f'{{"timestamp": "{text}", "user": "ana"}}')))
    assert row.ts == want and row.tags == ([] if want else [n.TAG_TIME])


def test_syslog_year_before(spark):
    rows, rejects = n.syslog(lines(spark, "<13>Dec 31 23:59:00 web1 sshd[99]: Failed password for invalid user bob from 203.0.113.9 port 1", "no log line"), "2025-01-01 00:10:00")
    row = one(rows)
    assert (row.ts, row.user, row.src_ip, row.outcome, row.event_id) == (datetime(2024, 12, 31, 23, 59), "bob", "203.0.113.9", "failure", "99")
    assert [tuple(r) for r in rejects.collect()] == [("no log line", "unrecognised line")]


def test_addresses_with_ports_and_a_second_from(spark):
    events, rejects = n.syslog(lines(
        spark, "Jan 10 10:00:00 h sshd[1]: Failed password for root from 203.0.113.9:51234 ssh2",
        "Jan 10 10:00:01 h sshd[1]: Message from daemon: Failed password for bob from 10.0.0.5",
        "Jan 10 10:00:02 h sshd[1]: Failed password for invalid user eve from 10.0.0.6 port 22",
        "Jan 10 10:00:03 h sshd[1]: Message from daemon: from nowhere"), "2024-01-15 00:00:00")
    got = {r.command_line: (r.user, r.src_ip) for r in events.collect()}
    assert rejects.count() == 0
    assert sorted(got.values(), key=str) == [("bob", "10.0.0.5"), ("eve", "10.0.0.6"), ("root", "203.0.113.9"), (None, None)]


def test_auditd_quotes(spark):
    row = one(n.auditd(lines(spark, 'type=SYSCALL msg=audit(1709287200.500:42): exe="/bin/my tool" auid=1000 success=no exit=-13 key=(null)'))[0])
    assert (row.process_name, row.user, row.outcome, row.properties["return_code"]) == ("/bin/my tool", "1000", "failure", "-13")


def test_firewall_vendors(spark):
    row = one(n.firewall(lines(spark, 'date=2024-03-01 time=10:00:00 devname="FG 1" srcip=10.0.0.1 dstport=443 action="Deny" sentbyte=12')))
    assert (row.ts, row.host, row.outcome, row.action, row.bytes_out) == (datetime(2024, 3, 1, 10), "FG 1", "failure", "deny", 12)


def test_sysmon_hashes_and_unknown_number(spark):
    row = one(n.sysmon(lines(spark, '{"EventID": 255, "UtcTime": "2024-03-01 10:00:00.000", "Hashes": "SHA256=AB, MD5=CD"}')))
    assert (row.category, row.action, row.hashes) == ("process", "sysmon_event_255", {"sha256": "AB", "md5": "CD"})


def test_ids_alert_is_not_an_ocsf_finding(spark):
    event = n.ids(lines(spark, '{"timestamp": "2024-03-01T10:00:00Z", "event_type": "alert", "alert": {"signature": "X", "severity": 1}}'))
    assert one(event).category == "ids" and one(ocsf.classified(event)).class_uid == 0


def test_headed_flow_file_without_time_or_addresses(spark, tmp_path):
    (tmp_path / "f.csv").write_text("\ufeffid,dur,proto,sbytes,attack_cat,label\n1,0.5,tcp,10.0,Backdoors,1\n\n2,-,udp,0x20,,0\n", encoding="utf-8")
    rows = flows.read_flow_csv(spark, str(tmp_path / "f.csv"))
    got = {r.event_id: r for r in flows.flow_events(rows, "id", "cast(id as int)").collect()}
    assert got["1"].attack_cat == "Backdoor" and got["2"].attack_cat == "Normal"
    assert got["1"].unavailable == ["timestamp", "ip_addresses"] and got["2"].bytes_out == 32 and got["1"].bytes_out == 10


def test_broken_lines_are_kept_apart(spark):
    good, bad = flows.read_json_lines(lines(spark, '{"a": 1}', "", "{oops"))
    assert (good.count(), bad.count()) == (1, 1)


def test_bundle(spark):
    text = ('{"objects": [{"type": "x-mitre-matrix", "tactic_refs": ["t2", "t1"]}, {"type": "x-mitre-tactic", "id": "t1", "x_mitre_shortname": "impact", "name": "Impact"},'
            '{"type": "x-mitre-tactic", "id": "t2", "x_mitre_shortname": "execution", "name": "Execution"},'
            '{"type": "attack-pattern", "name": "Old", "revoked": true, "external_references": [{"source_name": "mitre-attack", "external_id": "T1"}]},'
            '{"type": "attack-pattern", "name": "Sub", "x_mitre_is_subtechnique": true, "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "impact"}],'
            '"external_references": [{"source_name": "mitre-attack", "external_id": "T2.001"}]}]}')
    objects = intel.bundle_objects(lines(spark, text))
    assert [r.tactic for r in intel.tactic_order(objects).orderBy("position").collect()] == ["execution", "impact"]
    row = one(intel.techniques(objects))
    assert (row.technique, row.tactics, row.parent) == ("T2.001", ["impact"], "T2")

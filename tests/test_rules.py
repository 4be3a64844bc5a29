"""Every rule fires on its case and near misses stay quiet."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from secflow.functions import predicates as p
from secflow.functions import scalars as s
from secflow.plans import catalogue as cat
from secflow.plans.detection import rule_matches

COMMANDS = {
    "bitsadmin-download": "bitsadmin /transfer j http://x", "certutil-download": "certutil -decode a b",
    "clear-eventlogs": "wevtutil cl System", "create-local-account": "net user eve x /add",
    "disable-defender": "Set-MpPreference -DisableRealtimeMonitoring 1", "inhibit-recovery": "bcdedit /set recoveryenabled No",
    "linux-clear-logs": "journalctl --vacuum-time=1s", "linux-cron": "crontab -e", "linux-ssh-key": "echo k >> authorized_keys",
    "lsass-dump": "procdump -ma lsass", "msiexec-remote": "msiexec /i https://x/y.msi", "net-recon": "net group x",
    "netconfig-discovery": "ipconfig /all", "nltest-trust": "nltest /dclist:x", "portscan-tool": "nmap 10.0.0.1",
    "ps-encoded-cmd": "powershell -enc AAAA", "run-key": "reg add HKCU\\a\\run", "schtasks-create": "schtasks /create /tn a",
    "service-stop": "sc stop WinDefend", "sudoers": "vi /etc/sudoers", "wmic-process": "wmic process call create x",
}
IMAGES = {
    "hh-exec": "C:\\hh.exe", "mshta-exec": "mshta.exe", "netstat-discovery": "netstat.exe", "psexec-service": "PAExec.exe",
    "regasm-regsvcs": "regsvcs.exe", "systeminfo": "systeminfo.exe", "tasklist": "tasklist.exe", "whoami": "whoami.exe",
}
DDL = ("event_id bigint, ts timestamp, host string, category string, command_line string, process_name string, "
       "src_ip string, dst_ip string, dst_port int, bytes_out bigint, outcome string, query_name string")


def event(no, category, command=None, process=None, src=None, dst=None, port=None, size=None, outcome=None, query=None):
    return (no, None, "h", category, command, process, src, dst, port, size, outcome, query)


def fired(spark, *rows):
    out = {}
    for r in rule_matches(spark.createDataFrame(list(rows), DDL)).collect():
        out.setdefault(r.event_id, set()).add(r.rule_id)
    return out


def test_there_are_all_rules():
    assert len(cat.SIGMA) == 38 and len(cat.NATIVE) == 7
    assert len({r.rule_id for r in cat.ALL_RULES}) == 45


def test_each_rule_fires(spark):
    rows, want = [], []
    for rule, command in COMMANDS.items():
        want.append(rule)
        rows.append(event(len(rows), "process", command))
    for rule, image in IMAGES.items():
        want.append(rule)
        rows.append(event(len(rows), "process", None, image))
    for rule, row in [
        ("regsvr32-exec", ("process", "regsvr32 /s /u x.sct", "regsvr32.exe")), ("rundll32-exec", ("process", "rundll32 javascript:x", "rundll32.exe")),
        ("proxy-port", ("network", None, None, None, None, 9050)), ("c2-port-connect", ("network", None, None, None, None, 4445)),
        ("large-outbound", ("network", None, None, None, None, None, 104857601)), ("rdp-lateral", ("network", None, None, "10.0.0.1", "192.168.1.1", 3389)),
        ("auth-failure", ("authentication", None, None, None, None, None, None, "login failed")),
        ("auth-failure-external", ("authentication", None, None, "8.8.8.8", None, None, None, "denied")),
        ("dns-tunneling", ("dns", None, None, None, None, None, None, None, "a" * 45 + ".example.test")),
    ]:
        want.append(rule)
        rows.append(event(len(rows), *row))
    got = fired(spark, *rows)
    missing = [rule for no, rule in enumerate(want) if rule not in got.get(no, set())]
    assert not missing and set(want) == {r.rule_id for r in cat.SIGMA}


def test_near_misses(spark):
    got = fired(spark, event(0, "web", "GET /nmap"), event(1, "network", port=14444), event(2, "network", size=104857600),
                event(3, "network", src="10.0.0.1", dst="8.8.8.8", port=3389), event(4, "process", "notepad -nopause"),
                event(5, "authentication", src="10.1.1.1", outcome="failure"))
    assert got == {5: {"auth-failure"}}


def test_missing_source_counts_as_external(spark):
    assert "auth-failure-external" in fired(spark, event(0, "authentication", outcome="failure"))[0]


@pytest.mark.parametrize("ip,public", [("8.8.8.8", True), ("10.1.2.3", False), ("172.31.0.1", False), ("172.32.0.1", True),
                                       ("127.0.0.1", False), ("169.254.1.1", False), ("256.1.1.1", False), ("203.0.113.5", False), (None, False),
                                       ("2606:4700:4700::1111", True), ("2a00:1450:4001:82a:0:0:0:200e", True), ("::1", False), ("fe80::1", False),
                                       ("fd00::1", False), ("2001:db8::1", False), ("2001::1", False), ("2606:4700", False), ("2606::1::2", False)])
def test_public_ip(spark, ip, public):
    assert spark.createDataFrame([(ip,)], "ip string").where(p.public_ip("ip")).count() == int(public)


def test_scalars(spark):
    row = spark.createDataFrame([("aabc", "a'b;c", "x@y", 0.004)], "a string, b string, e string, p double").select(
        F.expr(s.entropy("a")).alias("entropy"), F.expr(s.special_chars("b")).alias("special"),
        F.expr(s.entity_type("e")).alias("kind"), F.expr(s.percent_text("p")).alias("pct"),
        F.expr(s.percent_text("0.625D")).alias("half")).first()
    assert (row.entropy, row.special, row.kind, row.pct, row.half) == (1.5, 2, "user", "0.40%", "62%")

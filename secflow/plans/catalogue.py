"""Detection rules as plain data.

A condition is ``(field, op, values)``; ``("and" | "or" | "not", ...)`` combines conditions. The
predicates, thresholds, techniques and levels are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from secflow.functions import predicates as p
from secflow.schema import SEVERITY_SCORE


@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str
    severity: str
    technique: str
    tactic: str
    category: str
    when: tuple
    count: int = 0
    minutes: int = 0
    group_by: tuple = field(default_factory=tuple)

    @property
    def confidence(self) -> float:
        return min(0.5 + SEVERITY_SCORE[self.severity] / 200.0, 0.99)


FAILED = ("outcome", "contains_any", ("failure", "failed", "denied"))
POWERSHELL = (r"powershell(\.exe)?\b.*?(\s-enc\b|\s-e\b|-encodedcommand\b|-nop\b|-noprofile\b"
              r"|-w\s+hidden\b|-windowstyle\s+hidden\b)")
SCANNER = r"\b(nmap|masscan|zmap|rustscan)\b|\s-sS\b|\s-p-(\s|$)"
TOOL_PORTS = (4444, 4445, 1337, 31337)
INTERNAL = ("10.", "192.168.", "172.16.", "172.17.", "172.18.", "172.19.", "172.20.")
BULK = 104857600

NATIVE = [
    Rule("RULE-0001", "Repeated failed logins", "high", "T1110", "credential-access", "authentication",
         FAILED, 5, 5, ("src_ip", "user")),
    Rule("RULE-0002", "Hidden or encoded PowerShell", "high", "T1059", "execution", "process",
         ("command_line", "regex", POWERSHELL)),
    Rule("RULE-0003", "Scheduled task created", "medium", "T1053", "persistence", "process",
         ("command_line", "regex", r"schtasks(\.exe)?\b.*?/create\b")),
    Rule("RULE-0004", "Network scanner started", "medium", "T1046", "discovery", "process",
         ("command_line", "regex", SCANNER)),
    Rule("RULE-0005", "Remote desktop between internal hosts", "medium", "T1021", "lateral-movement", "network",
         ("and", ("dst_port", "in", (3389,)), ("src_ip", "regex", p.PRIVATE), ("dst_ip", "regex", p.PRIVATE))),
    Rule("RULE-0006", "Repeated connections to a tool port", "high", "T1071", "command-and-control", "network",
         ("dst_port", "in", TOOL_PORTS), 3, 10, ("src_ip", "dst_ip", "dst_port")),
    Rule("RULE-0007", "Very large outbound transfer", "critical", "T1048", "exfiltration", "network",
         ("bytes_out", "gt", BULK)),
]


def _cmd_any(*values: str) -> tuple:
    return ("command_line", "contains_any", values)


def _cmd_all(*values: str) -> tuple:
    return ("command_line", "contains_all", values)


def _image(*values: str) -> tuple:
    return ("process_name", "endswith", values)


_AUTH, _PROC, _NET = "authentication", "process", "network"
SIGMA = [
    Rule("proxy-port", "Anonymising proxy port", "medium", "T1090", "command-and-control", _NET,
         ("dst_port", "in", (9050, 9051, 9150, 1080))),
    Rule("auth-failure-external", "Failed login from outside", "medium", "T1110.003", "credential-access", _AUTH,
         ("and", FAILED, ("not", ("src_ip", "startswith", INTERNAL + ("127.",))))),
    Rule("auth-failure", "Failed login", "low", "T1110", "credential-access", _AUTH, FAILED),
    Rule("bitsadmin-download", "Transfer job download", "medium", "T1197", "command-and-control", _PROC,
         ("and", _cmd_any("bitsadmin"), _cmd_any("/transfer", "/create", "/addfile"))),
    Rule("c2-port-connect", "Connection to a tool port", "high", "T1071", "command-and-control", _NET,
         ("dst_port", "in", TOOL_PORTS)),
    Rule("certutil-download", "Certificate tool download", "high", "T1105", "command-and-control", _PROC,
         ("and", _cmd_any("certutil"), _cmd_any("-urlcache", "-verifyctl", "-decode"))),
    Rule("clear-eventlogs", "Event log cleared", "high", "T1070.001", "defense-evasion", _PROC,
         ("or", _cmd_all("wevtutil", "cl"), _cmd_any("clear-eventlog", "clear-winevent"))),
    Rule("create-local-account", "Local account created", "medium", "T1136.001", "persistence", _PROC,
         _cmd_all("net ", "user", "/add")),
    Rule("disable-defender", "Real-time protection switched off", "high", "T1562.001", "defense-evasion", _PROC,
         _cmd_all("set-mppreference", "disablerealtimemonitoring")),
    Rule("dns-tunneling", "Very long subdomain", "high", "T1071.004", "command-and-control", "dns",
         ("query_name", "regex", r"^[a-z0-9]{40,}\..+$")),
    Rule("hh-exec", "Compiled help viewer started", "high", "T1218.001", "execution", _PROC, _image("hh.exe")),
    Rule("inhibit-recovery", "Recovery data deleted", "critical", "T1490", "impact", _PROC,
         ("or", _cmd_all("vssadmin", "delete", "shadow"), _cmd_all("wbadmin", "delete"),
          _cmd_all("bcdedit", "recoveryenabled", "no"), _cmd_all("shadowcopy", "delete"))),
    Rule("large-outbound", "Large outbound transfer", "critical", "T1048", "exfiltration", _NET,
         ("bytes_out", "gt", BULK)),
    Rule("linux-clear-logs", "System log cleared", "high", "T1070.002", "defense-evasion", _PROC,
         ("or", _cmd_all("journalctl", "--vacuum"), _cmd_any("> /var/log/", "rm -rf /var/log", "shred"))),
    Rule("linux-cron", "Cron entry changed", "medium", "T1053.003", "persistence", _PROC,
         ("or", _cmd_all("crontab", "-e"), _cmd_any("/etc/cron.d/", "/etc/crontab"))),
    Rule("linux-ssh-key", "Login key added", "medium", "T1098.004", "persistence", _PROC,
         _cmd_any("authorized_keys")),
    Rule("lsass-dump", "Credential process dumped", "critical", "T1003.001", "credential-access", _PROC,
         ("or", _cmd_all("procdump", "lsass"), _cmd_all("comsvcs", "minidump"))),
    Rule("mshta-exec", "Script host for HTML started", "high", "T1218.005", "defense-evasion", _PROC,
         _image("mshta.exe")),
    Rule("msiexec-remote", "Installer run from a URL", "high", "T1218.007", "execution", _PROC,
         ("and", _cmd_any("msiexec"), _cmd_any("http://", "https://"))),
    Rule("net-recon", "Account and group listing", "medium", "T1069", "discovery", _PROC,
         _cmd_any("net user", "net group", "net localgroup", "net accounts", "net1 user", "net1 group",
                  "net1 localgroup")),
    Rule("netconfig-discovery", "Network settings listed", "low", "T1016", "discovery", _PROC,
         ("or", _cmd_all("ipconfig", "/all"), _cmd_all("route", "print"))),
    Rule("netstat-discovery", "Connections listed", "low", "T1049", "discovery", _PROC, _image("netstat.exe")),
    Rule("nltest-trust", "Domain trusts listed", "medium", "T1482", "discovery", _PROC,
         ("and", _cmd_any("nltest"), _cmd_any("/domain_trusts", "/dclist", "/trusted_domains"))),
    Rule("portscan-tool", "Port scanner started", "medium", "T1046", "discovery", _PROC,
         ("command_line", "regex", SCANNER)),
    Rule("ps-encoded-cmd", "Encoded PowerShell command", "high", "T1059.001", "execution", _PROC,
         ("command_line", "regex", POWERSHELL)),
    Rule("psexec-service", "Remote service execution", "medium", "T1569.002", "execution", _PROC,
         _image("psexec.exe", "psexec64.exe", "paexec.exe")),
    Rule("rdp-lateral", "Internal remote desktop", "medium", "T1021.001", "lateral-movement", _NET,
         ("and", ("dst_port", "in", (3389,)), ("src_ip", "startswith", INTERNAL),
          ("dst_ip", "startswith", INTERNAL))),
    Rule("regasm-regsvcs", "Assembly registration tool started", "high", "T1218.009", "defense-evasion", _PROC,
         _image("regasm.exe", "regsvcs.exe")),
    Rule("regsvr32-exec", "Silent library registration", "high", "T1218.010", "defense-evasion", _PROC,
         ("and", _image("regsvr32.exe"), _cmd_any("/s /u", "scrobj.dll", "http://", "https://", ".sct"))),
    Rule("run-key", "Run key changed", "medium", "T1547.001", "persistence", _PROC,
         _cmd_all("reg ", "add", "\\run")),
    Rule("rundll32-exec", "Library runner with script", "high", "T1218.011", "defense-evasion", _PROC,
         ("and", _image("rundll32.exe"),
          _cmd_any("javascript:", "vbscript:", ".js,", ".vbs,", "mshtml,", "shell32.dll,ShellExec_RunDLL"))),
    Rule("schtasks-create", "Task scheduled", "medium", "T1053.005", "persistence", _PROC,
         _cmd_all("schtasks", "/create")),
    Rule("service-stop", "Security service stopped", "high", "T1489", "impact", _PROC,
         ("and", _cmd_any("net stop", "sc stop", "sc.exe stop"),
          _cmd_any("windefend", "sense", "mbamservice", "sophos", "mcafee", "sepmasterservice"))),
    Rule("sudoers", "Sudo rights changed", "high", "T1548.003", "privilege-escalation", _PROC,
         _cmd_any("visudo", "/etc/sudoers")),
    Rule("systeminfo", "System details listed", "low", "T1082", "discovery", _PROC, _image("systeminfo.exe")),
    Rule("tasklist", "Processes listed", "low", "T1057", "discovery", _PROC, _image("tasklist.exe")),
    Rule("whoami", "Current user queried", "medium", "T1033", "discovery", _PROC, _image("whoami.exe")),
    Rule("wmic-process", "Process created through management tool", "high", "T1047", "execution", _PROC,
         _cmd_all("wmic", "process", "call", "create")),
]

PER_EVENT = [r for r in NATIVE if not r.count] + SIGMA
VOLUME = [r for r in NATIVE if r.count]
ALL_RULES = NATIVE + SIGMA

# Ordered technique patterns (name, techniques, window in minutes); grouped by host.
SEQUENCES = [
    ("brute-force-then-execution", ("T1110", "T1059"), 30),
    ("execution-then-persistence", ("T1059", "T1053"), 30),
    ("discovery-then-lateral", ("T1046", "T1021"), 60),
    ("channel-then-exfiltration", ("T1071", "T1048"), 60),
    ("full-chain", ("T1110", "T1059", "T1053", "T1048"), 120),
]


def condition(tree: tuple) -> str:
    head = tree[0]
    if head == "and":
        return p.all_of(condition(t) for t in tree[1:])
    if head == "or":
        return p.any_of(condition(t) for t in tree[1:])
    if head == "not":
        return p.negate(condition(tree[1]))
    name, op, value = tree
    build = {"contains_any": p.contains_any, "contains_all": p.contains_all, "startswith": p.starts_with,
             "endswith": p.ends_with, "in": p.one_of, "regex": p.matches}
    return p.compare(name, op, value) if op in ("gt", "lt", "gte", "lte") else build[op](name, value)


def predicate(rule: Rule) -> str:
    """The category test comes first, so that it short-circuits and can reach the scan."""
    return p.all_of([f"category = {p.literal(rule.category)}", condition(rule.when)])


def fields_of(tree: tuple) -> set[str]:
    if tree[0] in ("and", "or", "not"):
        return set().union(*[fields_of(t) for t in tree[1:]])
    return {tree[0]}


def rules_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    rows = [(r.rule_id, r.title, r.severity, r.technique, r.tactic, r.category, r.confidence)
            for r in (rules or ALL_RULES)]
    return spark.createDataFrame(
        rows, "rule_id string, title string, severity string, technique string, tactic string, "
              "category string, confidence double")

"""The normalised event and the fixed vocabularies that all jobs share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_FIELDS: list[tuple[str, T.DataType]] = [
    ("event_id", T.StringType()), ("ts", T.TimestampType()), ("source", T.StringType()),
    ("category", T.StringType()), ("action", T.StringType()), ("host", T.StringType()),
    ("user", T.StringType()), ("src_ip", T.StringType()), ("dst_ip", T.StringType()),
    ("src_port", T.IntegerType()), ("dst_port", T.IntegerType()), ("protocol", T.StringType()),
    ("bytes_out", T.LongType()), ("bytes_in", T.LongType()), ("process_name", T.StringType()),
    ("command_line", T.StringType()), ("parent_process", T.StringType()),
    ("outcome", T.StringType()),
    ("properties", T.MapType(T.StringType(), T.StringType())),
    ("hashes", T.MapType(T.StringType(), T.StringType())),
    ("raw", T.StringType()), ("tags", T.ArrayType(T.StringType())),
]
EVENT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in EVENT_FIELDS])
EVENT_COLUMNS = [n for n, _ in EVENT_FIELDS]

# Severity scores.
SEVERITY_SCORE = {"info": 0, "low": 25, "medium": 50, "high": 75, "critical": 100}

# Kill-chain order of the tactics.
TACTICS = [
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence",
    "privilege-escalation", "stealth", "defense-impairment", "credential-access", "discovery",
    "lateral-movement", "collection", "command-and-control", "exfiltration", "impact",
]
TACTIC_ALIAS = {"defense-evasion": "stealth"}
END = "<END>"

# Technique dimension (id, name, tactic).
TECHNIQUES = [
    ("T1595", "Active Scanning", "reconnaissance"),
    ("T1190", "Exploit Public-Facing Application", "initial-access"),
    ("T1078", "Valid Accounts", "initial-access"),
    ("T1059", "Command and Scripting Interpreter", "execution"),
    ("T1053", "Scheduled Task/Job", "execution"),
    ("T1547", "Boot or Logon Autostart Execution", "persistence"),
    ("T1548", "Abuse Elevation Control Mechanism", "privilege-escalation"),
    ("T1027", "Obfuscated Files or Information", "stealth"),
    ("T1110", "Brute Force", "credential-access"),
    ("T1003", "OS Credential Dumping", "credential-access"),
    ("T1087", "Account Discovery", "discovery"),
    ("T1046", "Network Service Discovery", "discovery"),
    ("T1021", "Remote Services", "lateral-movement"),
    ("T1560", "Archive Collected Data", "collection"),
    ("T1071", "Application Layer Protocol", "command-and-control"),
    ("T1041", "Exfiltration Over C2 Channel", "exfiltration"),
    ("T1048", "Exfiltration Over Alternative Protocol", "exfiltration"),
    ("T1486", "Data Encrypted for Impact", "impact"),
    ("T1490", "Inhibit System Recovery", "impact"),
]

# The score from which an anomaly counts, and from which an event is a finding.
ANOMALY_THRESHOLD = 0.602
ALERT_THRESHOLD = 50.0


def severity_score(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(0)
    for name, score in SEVERITY_SCORE.items():
        out = F.when(c == name, score).otherwise(out)
    return out.cast("bigint")


def normal_tactic(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    for old, new in TACTIC_ALIAS.items():
        c = F.when(c == old, new).otherwise(c)
    return c


def tactic_index(col: Column | str) -> Column:
    """Position in the kill chain, -1 when unknown."""
    chain = F.array(*[F.lit(t) for t in TACTICS])
    return F.coalesce(F.array_position(chain, normal_tactic(col)) - 1, F.lit(-1)).cast("bigint")


def tactic_name(index: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in TACTICS]), index)

"""Row expressions as SQL text."""

from __future__ import annotations

from secflow.functions.predicates import literals
from secflow.schema import ANOMALY_THRESHOLD

# Fixed values.
COMMON_PORTS = (80, 443, 22, 53, 25, 3389, 445, 139, 21, 23, 3306, 8080)
SERVER_PREFIXES = ("srv-", "db-", "web-", "app-", "dc-", "mail-", "sql-", "fs-")
WORKSTATION_PREFIXES = ("wks-", "pc-", "laptop-", "desk-", "ws-")


def entropy(c: str) -> str:
    """Shannon entropy in bits; one pass per distinct character, no Python."""
    share = f"((length({c}) - length(replace({c}, ch, ''))) / length({c}))"
    return (f"case when coalesce({c}, '') = '' then 0D else aggregate(array_distinct(filter(split({c}, ''), "
            f"ch -> ch <> '')), 0D, (acc, ch) -> acc - {share} * log2({share})) end")


def bytes_ratio(out: str = "bytes_out", into: str = "bytes_in") -> str:
    o, i = f"coalesce({out}, 0)", f"coalesce({into}, 0)"
    return f"case when {o} + {i} = 0 then 0.5D else {o} / ({o} + {i}) end"


def special_chars(c: str) -> str:
    return f"length(regexp_replace(coalesce({c}, ''), '[\\\\p{{L}}\\\\p{{N}}\\\\s]', ''))"


def rare_port(c: str = "dst_port") -> str:
    return f"coalesce({c} <> 0 and {c} not in ({literals(COMMON_PORTS)}), false)"


def is_night(ts: str = "ts") -> str:
    return f"(hour({ts}) < 6 or hour({ts}) > 22)"


def hour_angle(ts: str = "ts") -> str:
    return f"(2 * pi() * hour({ts}) / 24)"


def log_volume(c: str) -> str:
    return f"log1p(coalesce({c}, 0))"


def entity() -> str:
    return "coalesce(host, user, src_ip, 'unknown')"


def entity_type(c: str) -> str:
    def any_prefix(values: tuple) -> str:
        return "(" + " or ".join(f"startswith(lower({c}), '{v}')" for v in values) + ")"
    octet = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    return (f"case when {any_prefix(SERVER_PREFIXES)} then 'server' "
            f"when {any_prefix(WORKSTATION_PREFIXES)} then 'workstation' "
            f"when contains({c}, '@') then 'user' "
            f"when {c} rlike '^{octet}[.]{octet}[.]{octet}[.]{octet}$' then 'network_address' else 'unknown' end")


def anomaly_severity(c: str) -> str:
    return f"case when {c} >= 0.60 then 'medium' when {c} >= 0.50 then 'low' else 'info' end"


def score_severity(c: str) -> str:
    return (f"case when {c} >= 85 then 'critical' when {c} >= 70 then 'high' when {c} >= 55 then 'medium' "
            "else 'low' end")


def percent_text(c: str) -> str:
    """No decimals from ten percent, one from one percent, two below."""
    return (f"case when {c} >= 0.1 then format_string('%.0f%%', bround({c} * 100, 0)) "
            f"when {c} >= 0.01 then format_string('%.1f%%', bround({c} * 100, 1)) "
            f"else format_string('%.2f%%', bround({c} * 100, 2)) end")


def ioc_values(c: str) -> str:
    return f"transform(regexp_extract_all({c}, '=\\\\s*[\\'\"]([^\\'\"]+)[\\'\"]', 1), x -> lower(x))"


def sanitized(c: str, tag: str = "untrusted", limit: int = 500) -> str:
    """Neutralise delimiter tags, drop control characters, cut long text visibly."""
    clean = (f"regexp_replace(regexp_replace({c}, '(?i)</?\\\\s*{tag}\\\\s*>', '[tag removed]'), "
             "'[\\\\x00-\\\\x09\\\\x0b-\\\\x1f]', '')")
    return f"case when length({clean}) > {limit} then concat(left({clean}, {limit}), '...[cut]') else {clean} end"


def capped_json(c: str, limit: int = 32000) -> str:
    return (f"case when length({c}) > {limit} then to_json(named_struct('truncated', true, 'original_length', "
            f"length({c}), 'preview', left({c}, {limit}))) else {c} end")


def incident_title(rule_title: str = "rule_title", score: str = "anomaly_score", who: str = "entity") -> str:
    return (f"left(concat(case when {rule_title} is not null then {rule_title} when {score} >= {ANOMALY_THRESHOLD} "
            f"then 'Anomaly without a rule' else 'Detection' end, ' - ', coalesce({who}, 'unknown entity')), 200)")


def report_feed(confidence: str) -> dict[str, str]:
    return {"malicious": f"{confidence} >= 25",
            "category": f"case when {confidence} >= 75 then 'c2' when {confidence} >= 25 then 'suspicious' end",
            "score": f"cast({confidence} as double)"}


def pulse_feed(pulses: str) -> dict[str, str]:
    return {"malicious": f"{pulses} > 0", "score": f"least({pulses} * 10.0D, 100.0D)"}

"""Event predicates as SQL text for ``where``, ``expr`` and ``selectExpr``.

Rule logic is two-valued: a missing field makes a condition false, so its negation is true. Every
leaf is therefore closed with ``coalesce(.., false)`` before it is combined.
"""

from __future__ import annotations

from collections.abc import Iterable


def literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def literals(values: Iterable) -> str:
    return ", ".join(literal(v) for v in values)


def closed(condition: str) -> str:
    return f"coalesce({condition}, false)"


def any_of(parts: Iterable[str]) -> str:
    return "(" + " or ".join(parts) + ")"


def all_of(parts: Iterable[str]) -> str:
    return "(" + " and ".join(parts) + ")"


def negate(part: str) -> str:
    return f"(not {part})"


def lowered(col: str) -> str:
    return f"lower(cast({col} as string))"


def equals(col: str, value: object) -> str:
    return closed(f"{lowered(col)} = {literal(str(value).lower())}")


def one_of(col: str, values: Iterable) -> str:
    return closed(f"{lowered(col)} in ({literals(str(v).lower() for v in values)})")


def contains(col: str, value: str) -> str:
    return closed(f"contains({lowered(col)}, {literal(value.lower())})")


def contains_any(col: str, values: Iterable[str]) -> str:
    return any_of(contains(col, v) for v in values)


def contains_all(col: str, values: Iterable[str]) -> str:
    return all_of(contains(col, v) for v in values)


def starts_with(col: str, values: Iterable[str]) -> str:
    return any_of(closed(f"startswith({lowered(col)}, {literal(v.lower())})") for v in values)


def ends_with(col: str, values: Iterable[str]) -> str:
    return any_of(closed(f"endswith({lowered(col)}, {literal(v.lower())})") for v in values)


def matches(col: str, pattern: str) -> str:
    """Unanchored search, ignoring case."""
    return closed(f"cast({col} as string) rlike {literal('(?i)' + pattern)}")


def not_matches(col: str, pattern: str) -> str:
    """True on a missing field."""
    return negate(matches(col, pattern))


def like_pattern(value: str) -> str:
    for char in ("\\", "%", "_"):
        value = value.replace(char, "\\" + char)
    return value.replace("*", "%").replace("?", "_")


def wildcard(col: str, value: str) -> str:
    """Whole-value match with ``*`` and ``?``, ignoring case."""
    return closed(f"cast({col} as string) ilike {literal(like_pattern(value))}")


def compare(col: str, op: str, value: float) -> str:
    """Numeric comparison; text that is no number is false."""
    sign = {"gt": ">", "lt": "<", "gte": ">=", "lte": "<=", "eq": "=", "neq": "<>"}[op]
    return closed(f"try_cast({col} as double) {sign} {value}")


PRIVATE = r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"  # fixed value


def private_ip(col: str) -> str:
    return matches(col, PRIVATE)


# Ranges that are not public: unspecified, private, shared, loopback, link-local, documentation,
# benchmarking, multicast and reserved.
NOT_PUBLIC = (r"^(0|10|127|22[4-9]|2[3-5][0-9])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\."
              r"|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^198\.1[89]\."
              r"|^198\.51\.100\.|^203\.0\.113\.")
IPV4 = r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"


# Written forms of IPv6: eight groups, or fewer with one gap. Public are those of 2000::/3 outside protocol
# assignments (2001::/23) and documentation (2001:db8::/32).
IPV6 = (r"^(([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=([^:]*:){2,7}[^:]*$)(?!.*::.*::)(?!.*:::)"
        r"[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*::([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?)$")
PUBLIC_IPV6 = r"^[23][0-9A-Fa-f]{3}:"
NOT_PUBLIC_IPV6 = r"^2001:(:|0{0,3}[0-9A-Fa-f]{1,2}:|0?1[0-9A-Fa-f]{2}:|0?[dD][bB]8:)"


def public_ip(col: str) -> str:
    """A valid address outside the private, loopback, link-local and reserved ranges."""
    return any_of([all_of([matches(col, IPV4), not_matches(col, NOT_PUBLIC)]),
                   all_of([matches(col, IPV6), matches(col, PUBLIC_IPV6), not_matches(col, NOT_PUBLIC_IPV6)])])

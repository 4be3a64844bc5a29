"""Incident store work: lifecycle replay, triage, queues, filters and service figures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.functions.predicates import literals
from secflow.operators.blocks import block_scan
from secflow.operators.timeline import row_index
from secflow.plans.detection import with_scalar

# Lifecycle.
STATES = ["new", "triaged", "confirmed", "false_positive", "uncertain", "resolved"]
ALLOWED = {
    "new": ["triaged", "confirmed", "false_positive", "uncertain", "resolved"],
    "triaged": ["confirmed", "false_positive", "uncertain", "resolved", "new"],
    "confirmed": ["resolved", "triaged"], "false_positive": ["resolved", "triaged"],
    "uncertain": ["resolved", "triaged"], "resolved": ["triaged"],
}
RESOLUTIONS = ["true_positive", "false_positive", "benign", "duplicate"]
SEVERITIES = ["critical", "high", "medium", "low"]


def lifecycle(changes: DataFrame, block: int | None = None) -> DataFrame:
    """Replay change requests (incident_id, seq, state, resolution, owner, severity) in order.

    The lifecycle is an automaton over six states, so the effect of a block of requests is a table
    of six end states. ``seq`` counts from 1 without holes.
    """
    allowed = [[target in ALLOWED[origin] for target in STATES] for origin in STATES]
    closed = STATES.index("resolved")
    coded = changes.selectExpr(
        "incident_id", "seq", "cast(seq - 1 as bigint) as _idx", "owner", "severity",
        "resolution as asked_resolution",
        f"case when state is null then -1 when state in ({literals(STATES)}) "
        f"then cast(array_position(array({literals(STATES)}), state) - 1 as int) else -2 end as target",
        f"coalesce(resolution in ({literals(RESOLUTIONS)}), false) as resolvable",
        f"severity is not null and severity not in ({literals(SEVERITIES)}) as bad_severity",
    )

    def move(state: int, target: int, resolvable: bool, bad: bool) -> tuple[int, str]:
        if target == -2:
            return state, "unknown state"
        if target >= 0 and target != state:
            if not allowed[state][target]:
                return state, "transition not allowed"
            if target == closed and not resolvable:
                return state, "resolution needed"
        if bad:
            return state, "unknown severity"
        return (state, "") if target < 0 else (int(target), "")

    def describe(pdf: pd.DataFrame) -> list:
        ends = list(range(6))
        for row in zip(pdf["target"], pdf["resolvable"], pdf["bad_severity"]):
            ends = [move(s, *row)[0] for s in ends]
        return ends

    def step(state: float, target: int, resolvable: bool, bad: bool, resolution: str | None):
        before = int(state)
        after, error = move(before, target, resolvable, bad)
        kept = resolution if after == closed and not error else None
        return float(after), (STATES[before], STATES[after], error, kept)

    return block_scan(
        coded, ["incident_id"], inputs=["target", "resolvable", "bad_severity", "asked_resolution"], step=step,
        start=0.0, keep=["incident_id", "seq", "owner", "severity"],
        outputs={"state_before": "string", "state_after": "string", "error": "string", "resolution": "string"},
        describe=describe, advance=lambda s, e: e[int(s)], compose=lambda first, then: [then[int(s)] for s in first],
        block=block)


def final_states(replayed: DataFrame) -> DataFrame:
    """Where each incident ended: rejected requests change nothing."""
    good = "error = ''"
    closing = "error = '' and state_after = 'resolved' and state_before <> 'resolved'"
    return replayed.groupBy("incident_id").agg(
        F.expr("max_by(state_after, seq)").alias("state"),
        F.expr(f"max_by(owner, seq) filter (where {good} and owner is not null)").alias("owner"),
        F.expr(f"max_by(severity, seq) filter (where {good} and severity is not null)").alias("severity"),
        F.expr(f"max_by(resolution, seq) filter (where {closing})").alias("last_resolution"),
        F.count_if(F.expr("error <> ''")).alias("rejected"),
    ).withColumn("resolution", F.expr("if(state = 'resolved', last_resolution, null)")).drop("last_resolution")


TRIAGE = {"CONFIRM": ("TRUE_POSITIVE", "confirmed"), "REJECT": ("FALSE_POSITIVE", "false_positive"),
          "UNCERTAIN": ("UNCERTAIN", "uncertain")}  # fixed values


def triage(actions: DataFrame) -> DataFrame:
    label = " ".join(f"when '{a}' then '{d}'" for a, (d, _) in TRIAGE.items())
    state = " ".join(f"when '{a}' then '{s}'" for a, (_, s) in TRIAGE.items())
    return actions.selectExpr("*", f"case action {label} end as decision", f"case action {state} end as target_state",
                              "action = 'COMMENT' as note_only",
                              f"action not in ({literals(list(TRIAGE) + ['COMMENT'])}) as rejected")


SEVERITY_ORDER = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end"


def queue_page(store: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the queue with the total: open first, then severity, then newest."""
    size, skip = max(1, min(limit, 200)), max(0, offset)
    total = store.agg(F.count("*").alias("total"))
    page = (store.orderBy(F.expr("state = 'resolved'"), F.expr(SEVERITY_ORDER), F.col("detected_at").desc(),
                          F.col("incident_id")).offset(skip).limit(size))
    return with_scalar(page, total)


def filtered(store: DataFrame, state=None, severity=None, owner=None, unassigned=False, entity=None,
             technique=None, since=None, text=None) -> DataFrame:
    out = store
    for name, value in (("state", state), ("severity", severity), ("owner", owner), ("entity", entity)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if unassigned:
        out = out.where("owner is null")
    if technique is not None:
        out = out.where(F.array_contains("techniques", technique))
    if since is not None:
        out = out.where(F.col("detected_at") >= F.lit(since).cast("timestamp"))
    if text is not None:
        like = f"%{text}%"
        columns = ("incident_id", "title", "entity", "owner", "state")
        found = F.lit(False)
        for name in columns:
            found = found | F.coalesce(F.col(name).ilike(like), F.lit(False))
        out = out.where(found)
    return out


def order_store(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a stored incident table."""
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "concat('I', o_orderkey) as incident_id", f"element_at(array({literals(STATES)}), cast(o_orderkey % 6 + 1 as int)) as state",
        "case left(o_orderpriority, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' else 'low' end as severity",
        "if(o_custkey % 3 = 0, null, concat('analyst', o_custkey % 7)) as owner",
        f"if(o_orderkey % 6 = 5, element_at(array({literals(RESOLUTIONS)}), cast(o_custkey % 4 + 1 as int)), null) as resolution",
        "round(o_totalprice % 100, 2) as score", "concat('C', o_custkey) as entity",
        "array(concat('T', 1000 + o_custkey % 37), concat('T', 1000 + o_orderkey % 41)) as techniques",
        "cast(o_orderdate as timestamp) as detected_at",
        "concat('Detection ', o_orderstatus, ' - C', o_custkey) as title")


def line_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as change requests of the incident named by the order."""
    states = [*STATES, None, "archived"]
    arms = " ".join(f"when {i} then {'null' if s is None else repr(s)}" for i, s in enumerate(states))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    ranked = row_index(lines, ["l_orderkey"], order, F.expr("l_linenumber div 1000"))
    return ranked.selectExpr(
        "l_orderkey as incident_id", "cast(_idx + 1 as int) as seq", f"case l_suppkey % 8 {arms} end as state",
        "case l_partkey div 3 % 5 when 0 then 'true_positive' when 1 then 'benign' when 2 then 'duplicate' "
        "when 3 then 'because' end as resolution",
        "if(l_partkey % 4 = 0, concat('analyst', l_partkey % 7), null) as owner",
        "case l_partkey % 10 when 0 then 'high' when 5 then 'low' when 7 then 'urgent' end as severity")

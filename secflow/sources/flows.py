"""Flow datasets: headerless or headed CSV, a second dataset, JSON Lines, Windows JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.settings import small_side
from secflow.sources.normalize import as_events, first, integer, with_map

# Column order of the headerless files.
RAW_COLUMNS = [
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes", "sttl", "dttl", "sloss", "dloss",
    "service", "sload", "dload", "spkts", "dpkts", "swin", "dwin", "stcpb", "dtcpb", "smeansz", "dmeansz", "trans_depth",
    "res_bdy_len", "sjit", "djit", "stime", "ltime", "sintpkt", "dintpkt", "tcprtt", "synack", "ackdat",
    "is_sm_ips_ports", "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "ct_srv_src", "ct_srv_dst",
    "ct_dst_ltm", "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm", "attack_cat", "label",
]
# Names of the kept measures, and the columns that become event fields.
RENAMED = {"dur": "duration_s", "spkts": "packets_out", "dpkts": "packets_in", "sttl": "ttl_out", "dttl": "ttl_in",
           "sloss": "loss_out", "dloss": "loss_in", "sload": "load_out", "dload": "load_in"}
MAPPED = {"srcip", "sport", "dstip", "dsport", "proto", "service", "sbytes", "dbytes", "state", "stime", "ltime",
          "attack_cat", "label", "id", *RENAMED}
SYNTHETIC_START = "2015-01-01 00:00:00"


def clean_name(name: str) -> str:
    return name.strip().lstrip("﻿").lower().replace(" ", "_").replace("-", "_")


def clean_value(c: str) -> str:
    """Trim, drop a byte-order mark, and read the usual placeholders as null."""
    bare = f"trim(regexp_replace(trim({c}), '^\\\\uFEFF', ''))"
    return f"case when {bare} in ('', '-', '0x000b') then null else {bare} end"


def whole(c: str, kind: str = "int") -> str:
    """Integer from an integer, a float-looking text or a hexadecimal port."""
    return (f"coalesce(try_cast(try_cast({c} as double) as {kind}), "
            f"case when {c} rlike '^0[xX][0-9a-fA-F]+$' then try_cast(conv(substr({c}, 3), 16, 10) as {kind}) end)")


def finite(c: str, default: str = "0D") -> str:
    number = f"try_cast({c} as double)"
    return f"case when {number} is null or isnan({number}) or abs({number}) = double('Infinity') then {default} else {number} end"


def read_flow_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Flow CSV as text columns plus provenance. A file's header row, where it has one, is recognised by its
    words and names the columns of that file only; files with other headers, or none, may be mixed. Rows of all
    layouts are put together by name. An empty input has the columns of a file without header."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.regexp_replace("value", "^\ufeff", "").alias("value"), F.input_file_name().alias("file"))
    names = f"transform(split(lower(value), ','), x -> regexp_replace(trim(x), '[^a-z0-9]+', '_'))"
    header = F.expr(f"arrays_overlap({names}, array('label', 'attack_cat', 'dur'))")
    heads = lines.where(header).groupBy("file").agg(F.min("value").alias("head"))
    layouts = [r[0] for r in heads.select("head").distinct().collect()]  # one per kind of export
    rows = lines.where(~header).join(small_side(heads), "file", "left")
    out = None
    for head in [None, *sorted(layouts)]:
        names = RAW_COLUMNS if head is None else [clean_name(n) for n in head.split(",")]
        schema = ", ".join(f"`{n}` string" for n in names)
        part = rows.where(F.col("head").eqNullSafe(F.lit(head))).select(F.from_csv("value", schema).alias("r"), "file")
        part = part.select("r.*", "file")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    used = {"file"} | ({c for h in layouts for c in map(clean_name, h.split(","))} if layouts else set())
    plain = layouts and rows.where("head is null").isEmpty()
    return out.select(*[c for c in out.columns if not plain or c in used])


def flow_events(rows: DataFrame, row_id: str, line_no: str) -> DataFrame:
    """Flow rows to events with label and category; what a file cannot offer is listed."""
    names = [c for c in rows.columns if c not in ("file", "row_id", "line_no")]
    have = {c: clean_value(f"`{c}`") for c in names}

    def value(name: str) -> str:
        return have.get(name, "cast(null as string)")

    kept = [f"named_struct('key', '{c}', 'value', {have[c]})" for c in names if c not in MAPPED]
    kept += [f"named_struct('key', '{out}', 'value', cast(try_cast({value(c)} as double) as string))" for c, out in RENAMED.items()]
    base = rows.selectExpr(
        "*", f"{row_id} as _id", f"{value('stime')} as _stime", f"{value('ltime')} as _ltime",
        f"coalesce({whole(value('label'))}, 0) as _label",
        f"case lower(coalesce({value('attack_cat')}, '')) when '' then 'Normal' when 'backdoors' then 'Backdoor' else {value('attack_cat')} end as _cat",
        f"cast(coalesce(unix_timestamp(timestamp'{SYNTHETIC_START}'), 0) + {line_no} as string) as _made")
    events = as_events(base.withColumnsRenamed({"_label": "_keep_label", "_cat": "_keep_cat"}).withColumn(
        "_keep_unavailable", F.expr(f"array_compact(array(if(coalesce(_stime, _ltime) is null, 'timestamp', null), "
                                    f"if({value('srcip')} is null and {value('dstip')} is null, 'ip_addresses', null)))")),
        "coalesce(_stime, _ltime, _made)", {
            "event_id": "_id", "source": "'netflow'", "category": "'network'", "action": "'network_flow'",
            "src_ip": value("srcip"), "dst_ip": value("dstip"), "src_port": whole(value("sport")),
            "dst_port": whole(value("dsport")), "protocol": f"coalesce({value('proto')}, {value('service')})",
            "bytes_out": whole(value("sbytes"), "bigint"), "bytes_in": whole(value("dbytes"), "bigint"),
            "outcome": f"coalesce({value('state')}, 'unknown')",
            "properties": f"map_from_entries(filter(array({', '.join(kept)}), e -> e.value is not null))",
            "raw": "cast(null as string)", "tags": "if(_keep_label = 1, concat('attack:', _keep_cat), 'benign')"})
    return events.withColumnsRenamed({"_keep_label": "label", "_keep_cat": "attack_cat", "_keep_unavailable": "unavailable"})


CIC_TIMES = ["dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm",
             "dd/MM/yyyy hh:mm:ss a", "MM/dd/yyyy hh:mm:ss a", "yyyy-MM-dd HH:mm:ss"]  # fixed values, tried in order


def read_cic_csv(spark: SparkSession, path: str) -> DataFrame:
    # Spark reads Latin-1 but not the Windows code page; the two differ only in the dash of the labels,
    # which arrives as U+0096 and is replaced below.
    rows = spark.read.csv(path, header=True, encoding="iso-8859-1")
    return rows.toDF(*[clean_name(c) for c in rows.columns])


def cic_events(rows: DataFrame, as_of: str) -> DataFrame:
    """The second flow dataset: padded names and values, seven date layouts, benign label set."""
    rows = rows.withColumns({c: F.expr(clean_value(f"`{c}`")) for c in rows.columns})

    def pick(*names: str) -> str:
        have = [f"`{n}`" for n in names if n in rows.columns]
        return f"coalesce({', '.join(have)})" if have else "cast(null as string)"

    # A one-digit hour or day is padded, because the layouts are strict.
    text = f"regexp_replace(regexp_replace({pick('timestamp')}, '^([0-9])/', '0$1/'), ' ([0-9]):', ' 0$1:')"
    text = f"regexp_replace({text}, '/([0-9])/', '/0$1/')"
    stamp = "coalesce(" + ", ".join(f"try_to_timestamp({text}, '{f}')" for f in CIC_TIMES) + f", timestamp'{as_of}')"
    label = "replace(replace(coalesce(" + pick("label") + ", 'BENIGN'), '\\u0096', '-'), '\\u2013', '-')"
    based = rows.selectExpr("*", f"{label} as _keep_category", f"date_format({stamp}, 'yyyy-MM-dd HH:mm:ss') as _t")
    events = as_events(based, "_t", {
        "event_id": f"coalesce({pick('flow_id')}, 'flow')", "source": "'netflow'", "category": "'network'",
        "action": "'network_flow'", "src_ip": pick("source_ip", "src_ip"), "dst_ip": pick("destination_ip", "dst_ip"),
        "src_port": whole(pick("source_port", "src_port")), "dst_port": whole(pick("destination_port", "dst_port")),
        "protocol": f"coalesce({pick('protocol')}, '')",
        "bytes_out": whole(pick("total_length_of_fwd_packets", "fwd_packets_length_total"), "bigint"),
        "bytes_in": whole(pick("total_length_of_bwd_packets", "bwd_packets_length_total"), "bigint"),
        "outcome": "'unknown'", "raw": "cast(null as string)", "tags": "'dataset:cicids2017'"})
    return events.withColumnRenamed("_keep_category", "attack_cat").withColumn(
        "label", F.expr("if(lower(attack_cat) in ('benign', 'normal'), 0, 1)"))


def windows_events(raw: DataFrame, technique: str) -> DataFrame:
    """Windows JSON: four logon numbers become authentication, 3 network, the rest process."""
    number = first(["EventID", "event_id"])
    rows = with_map(raw).withColumn("_n", F.expr(number))
    logon = "coalesce(_n in ('4624', '4625', '4771', '4776'), false)"

    def by_kind(auth: str, other: str) -> str:
        return f"if({logon}, {auth}, {other})"

    null = "cast(null as string)"
    return as_events(rows, first(["@timestamp", "UtcTime", "TimeCreated"]), {
        "event_id": "coalesce(_n, 'sysmon')", "source": by_kind("'auth'", "'sysmon'"),
        "category": f"case when {logon} then 'authentication' when _n = '3' then 'network' else 'process' end",
        "action": by_kind("'user_login'", "if(_n is null, 'process_create', concat('event_', _n))"),
        "host": first(["Hostname", "Computer"]),
        "user": by_kind(first(["TargetUserName", "SubjectUserName"]), first(["User", "SubjectUserName"])),
        "src_ip": by_kind(first(["IpAddress", "SourceIp"]), first(["SourceIp"])),
        "dst_ip": by_kind(null, first(["DestinationIp"])), "dst_port": by_kind("cast(null as int)", integer(first(["DestinationPort"]))),
        "protocol": by_kind(null, first(["Protocol"])), "process_name": by_kind(null, first(["Image", "SourceImage"])),
        "command_line": by_kind(null, first(["CommandLine"])), "parent_process": by_kind(null, first(["ParentImage"])),
        "outcome": f"case when _n = '4625' then 'failure' when {logon} then 'success' else 'unknown' end",
        "tags": f"'technique:{technique}'"})


def read_json_lines(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records and the quarantine: blank lines are skipped, broken ones are kept with a reason."""
    lines = raw.where(F.trim("value") != "")
    parsed = lines.withColumn("_ok", F.expr("try_parse_json(value) is not null and from_json(value, 'map<string,string>') is not null"))
    return parsed.where("_ok").drop("_ok"), parsed.where("not _ok").select("value", F.lit("invalid JSON").alias("reason"))

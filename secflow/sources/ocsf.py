"""Events to and from the open schema documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.sources.normalize import as_events

# Classes, categories and activity numbers.
VERSION = "1.1.0"
CLASS = ("case when source = 'suricata' and category = 'alert' then 2004 when category = 'process' then 1007 "
         "when category = 'authentication' then 3002 when category in ('network', 'flow', 'dns') or source in ('firewall', 'netflow') "
         "then 4001 else 0 end")
CLASS_NAME = ("case class_uid when 0 then 'Base Event' when 3002 then 'Authentication' when 2004 then 'Detection Finding' "
              "when 4001 then 'Network Activity' else 'Process Activity' end")
CATEGORY = "case class_uid when 1007 then 1 when 2004 then 2 when 3002 then 3 when 4001 then 4 else 0 end"
CATEGORY_NAME = ("case category_uid when 1 then 'System Activity' when 2 then 'Findings' when 3 then 'Identity & Access Management' "
                 "when 4 then 'Network Activity' else 'Uncategorized' end")
ACTIVITY = ("case when class_uid = 1007 then case action when 'process_create' then 1 when 'process_terminate' then 2 "
            "when 'process_access' then 6 else 99 end when class_uid = 3002 then case action when 'user_login' then 1 "
            "when 'user_logout' then 2 else 99 end when class_uid = 4001 then case action when 'network_connection' then 1 "
            "when 'network_close' then 2 when 'network_traffic' then 6 else 99 end else 99 end")


def classified(events: DataFrame) -> DataFrame:
    return (events.withColumn("class_uid", F.expr(CLASS)).withColumn("category_uid", F.expr(CATEGORY))
            .withColumn("activity_id", F.expr(ACTIVITY)))


def to_documents(events: DataFrame) -> DataFrame:
    """One JSON document per event; members without a value are left out."""
    document = (
        "to_json(named_struct('class_uid', class_uid, 'class_name', " + CLASS_NAME + ", 'category_uid', category_uid, "
        "'category_name', " + CATEGORY_NAME + ", 'activity_id', activity_id, 'type_uid', class_uid * 100 + activity_id, "
        "'time', unix_millis(ts), 'severity_id', 0, 'status_id', case outcome when 'success' then 1 when 'failure' then 2 else 0 end, "
        "'status', outcome, 'metadata', named_struct('version', '" + VERSION + "', 'original_time', "
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\")), "
        "'unmapped', map_concat(coalesce(properties, map()), map_filter(map('x_source', source, 'x_category', category, 'x_action', action, "
        "'x_tags', to_json(tags)), (k, v) -> v is not null)), "
        "'actor', if(user is null, null, named_struct('user', named_struct('name', user))), "
        "'device', if(host is null, null, named_struct('hostname', host)), "
        "'process', if(process_name is null and command_line is null and parent_process is null, null, named_struct('name', process_name, "
        "'cmd_line', command_line, 'parent_process', if(parent_process is null, null, named_struct('name', parent_process)))), "
        "'src_endpoint', if(src_ip is null and dst_ip is null and src_port is null and dst_port is null, null, named_struct('ip', src_ip, 'port', src_port)), "
        "'dst_endpoint', if(src_ip is null and dst_ip is null and src_port is null and dst_port is null, null, named_struct('ip', dst_ip, 'port', dst_port)), "
        "'connection_info', if(protocol is null and bytes_in is null and bytes_out is null, null, named_struct('protocol_name', protocol)), "
        "'traffic', if(protocol is null and bytes_in is null and bytes_out is null, null, named_struct('bytes_in', bytes_in, 'bytes_out', bytes_out)), "
        "'finding_info', if(class_uid = 2004, named_struct('title', properties['signature'], 'uid', event_id), null)))")
    return classified(events).withColumn("document", F.expr(document))


SCHEMA = ("class_uid int, time bigint, status string, uid string, unmapped map<string,string>, "
          "actor struct<user: struct<name: string>>, device struct<hostname: string>, "
          "process struct<name: string, cmd_line: string, parent_process: struct<name: string>>, "
          "src_endpoint struct<ip: string, port: int>, dst_endpoint struct<ip: string, port: int>, "
          "connection_info struct<protocol_name: string>, traffic struct<bytes_in: bigint, bytes_out: bigint>, "
          "finding_info struct<title: string, uid: string>")


def from_documents(documents: DataFrame, column: str = "document") -> DataFrame:
    """Events from documents of our own or of others; a foreign one gets a category from its class."""
    rows = documents.withColumn("d", F.from_json(column, SCHEMA)).withColumn("value", F.col(column))
    own = "(d.unmapped['x_category'] is not null and d.unmapped['x_action'] is not null)"
    derived = "case d.class_uid when 1007 then 'process' when 3002 then 'authentication' when 4001 then 'network' when 2004 then 'alert' else 'unknown' end"
    return as_events(rows, "cast(d.time / 1000 as string)", {
        "event_id": "coalesce(d.finding_info.uid, d.uid, '')", "source": "coalesce(d.unmapped['x_source'], 'ocsf')",
        "category": f"if({own}, d.unmapped['x_category'], {derived})",
        "action": f"if({own}, d.unmapped['x_action'], concat('ocsf_class_', coalesce(d.class_uid, 0)))",
        "host": "d.device.hostname", "user": "d.actor.user.name", "src_ip": "d.src_endpoint.ip", "dst_ip": "d.dst_endpoint.ip",
        "src_port": "d.src_endpoint.port", "dst_port": "d.dst_endpoint.port", "protocol": "d.connection_info.protocol_name",
        "bytes_in": "d.traffic.bytes_in", "bytes_out": "d.traffic.bytes_out", "process_name": "d.process.name",
        "command_line": "d.process.cmd_line", "parent_process": "d.process.parent_process.name", "outcome": "d.status",
        "properties": "map_filter(d.unmapped, (k, v) -> not startswith(k, 'x_'))"})

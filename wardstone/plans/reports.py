"""Reporting queries over normalized events, detections and incidents: totals, breakdowns, time series, recent rows.

A report is data: table, condition, shape. ``build`` makes one lazy plan of it: filter, then one aggregate or a top-k; conditions, time range and variable filters reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import external_ip


@dataclass(frozen=True)
class Report:
    table: str
    time: str
    kind: str  # count, by, over_time, recent, values, one
    where: str = "true"
    keys: dict[str, str] = field(default_factory=dict)  # output name: expression
    limit: int | None = None
    order: tuple[str, ...] = ()
    explode: str | None = None
    condition: object = None  # a Column function where SQL text is not enough


_POWERSHELL = "event_id = 1 AND (lower(image) LIKE '%powershell.exe%' OR lower(image) LIKE '%pwsh.exe%')"
_TOOLS = "(ingestion_path = '/security' OR ingestion_protocol LIKE 'syslog%')"
_DESTINATION = "CASE WHEN destination_hostname = '' THEN destination_ip ELSE destination_hostname END"


def _events(kind: str, where: str = "true", keys: dict | None = None, **more) -> Report:
    return Report("events", "event_time", kind, where, keys or {}, **more)


def _detections(kind: str, where: str = "true", keys: dict | None = None, **more) -> Report:
    return Report("detections", "detected_at", kind, where, keys or {}, **more)


def _incidents(kind: str, where: str = "true", keys: dict | None = None, time: str = "last_seen", **more) -> Report:
    return Report("incidents", time, kind, where, keys or {}, **more)


def _names(*columns: str) -> dict[str, str]:
    return {c: c for c in columns}


REPORTS: dict[str, Report] = {
    # security overview
    "overview_total_events": _events("count"),
    "overview_process_creation": _events("count", "event_id = 1"),
    "overview_powershell": _events("count", _POWERSHELL),
    "overview_network_connections": _events("count", "event_id = 3"),
    "overview_activity_over_time": _events("over_time", keys=_names("event_type")),
    "overview_top_destinations": _events("by", "event_id = 3", {"destination": _DESTINATION}, limit=15),
    "overview_top_dns": _events("by", "event_id = 22 AND query_name <> ''", {"query": "query_name"}, limit=15),
    "overview_top_processes": _events("by", "event_id = 1 AND image <> ''", _names("image"), limit=15),
    "overview_external_destinations": _events("by", "event_id = 3 AND destination_ip <> ''", {"destination": _DESTINATION}, limit=20, condition=lambda: external_ip(F.col("destination_ip"))),
    "overview_by_event_id": _events("by", keys=_names("event_id")),
    "overview_recent_processes": _events("recent", "event_id = 1", _names("event_time", "host_name", "user_name", "process_path", "process_id", "command_line", "parent_process_name", "source_event_id"), limit=200),
    "overview_recent_powershell": _events("recent", _POWERSHELL, _names("event_time", "host_name", "user_name", "process_path", "command_line", "source_event_id"), limit=200),
    "overview_recent_network": _events("recent", "event_id = 3", _names("event_time", "host_name", "process_path", "source_ip", "source_port", "destination_ip", "destination_port", "destination_hostname", "protocol", "source_event_id"), limit=200),
    "overview_by_platform": _events("by", keys=_names("platform")),
    "overview_linux_processes": _events("by", "platform = 'linux' AND event_action = 'process_execute' AND process_path <> ''", _names("process_path"), limit=15),
    "overview_by_source_type": _events("by", keys=_names("source_type")),
    "overview_failed_authentication": _events("count", "platform = 'linux' AND event_category = 'authentication' AND outcome = 'failure'"),
    "overview_authentication_over_time": _events("over_time", "platform = 'linux' AND event_category = 'authentication'", _names("outcome")),
    "overview_sudo": _events("recent", "platform = 'linux' AND event_action = 'sudo_command'", _names("event_time", "host_name", "user_name", "command_line", "outcome", "source_type", "source_event_id"), limit=200),
    "overview_linux_executions": _events("recent", "platform = 'linux' AND event_action = 'process_execute'", {"event_time": "event_time", "host_name": "host_name", "account": "CASE WHEN user_name = '' THEN user_id ELSE user_name END", "process_path": "process_path", "command_line": "command_line", "outcome": "outcome", "source_event_id": "source_event_id"}, limit=200),
    "overview_variable_hosts": _events("values", "host_name <> ''", _names("host_name")),
    "overview_variable_platforms": _events("values", "platform <> ''", _names("platform")),
    # security sources
    "sources_tool_events": _events("count", _TOOLS),
    "sources_alerts": _events("count", "product = 'Suricata' AND event_kind = 'alert'"),
    "sources_syslog": _events("count", "ingestion_protocol LIKE 'syslog%'"),
    "sources_network": _events("count", "event_category IN ('network', 'dns', 'web', 'intrusion_detection') OR source_ip <> '' OR destination_ip <> ''"),
    "sources_over_time": _events("over_time", _TOOLS, {"source": "vendor || ' / ' || product"}),
    "sources_by_vendor": _events("by", keys=_names("vendor")),
    "sources_by_product": _events("by", keys=_names("product")),
    "sources_by_source_type": _events("by", keys=_names("source_type")),
    "sources_by_protocol": _events("by", keys=_names("ingestion_protocol")),
    "sources_top_signatures": _events("by", "signature <> ''", _names("signature"), limit=15),
    "sources_top_source_ips": _events("by", "source_ip <> ''", _names("source_ip"), limit=15),
    "sources_top_destination_ips": _events("by", "destination_ip <> ''", _names("destination_ip"), limit=15),
    "sources_dns": _events("by", "event_category = 'dns' AND domain <> ''", _names("domain"), limit=15),
    "sources_http": _events("recent", "event_category = 'web'", _names("event_time", "device_name", "source_ip", "destination_ip", "url", "source_event_id"), limit=200),
    "sources_recent_alerts": _events("recent", "event_kind = 'alert'", _names("event_time", "device_name", "severity", "signature_id", "signature", "source_ip", "source_port", "destination_ip", "destination_port", "source_event_id"), limit=200),
    "sources_variable_vendors": _events("values", "vendor <> ''", _names("vendor")),
    "sources_variable_products": _events("values", "product <> ''", _names("product")),
    # detections
    "detections_total": _detections("count"),
    "detections_new": _detections("count", "status = 'new'"),
    "detections_severe": _detections("count", "severity IN ('high', 'critical')"),
    "detections_over_time": _detections("over_time", keys=_names("severity")),
    "detections_by_severity": _detections("by", keys=_names("severity")),
    "detections_by_rule": _detections("by", keys=_names("rule_name"), limit=20),
    "detections_by_platform": _detections("by", keys=_names("platform")),
    "detections_by_source_type": _detections("by", keys=_names("source_type")),
    "detections_by_host": _detections("by", "host_name <> ''", _names("host_name"), limit=20),
    "detections_top_users": _detections("by", "user_name <> ''", _names("user_name"), limit=20),
    "detections_top_source_ips": _detections("by", "source_ip <> ''", _names("source_ip"), limit=20),
    "detections_top_destination_ips": _detections("by", "destination_ip <> ''", _names("destination_ip"), limit=20),
    "detections_tactics": _detections("by", keys={"tactic": "item"}, explode="mitre_tactics"),
    "detections_techniques": _detections("by", keys={"technique": "item"}, explode="mitre_techniques"),
    "detections_recent": _detections("recent", keys=_names("detected_at", "severity", "status", "rule_name", "platform", "host_name", "user_name", "source_ip", "destination_ip", "detection_id"), limit=500),
    "detections_variable_rules": _detections("values", keys=_names("rule_name")),
    "detections_variable_tactics": _detections("values", keys={"tactic": "item"}, explode="mitre_tactics"),
    # incidents
    "incidents_open": _incidents("count", "status <> 'closed'"),
    "incidents_new": _incidents("count", "status = 'new'"),
    "incidents_severe_open": _incidents("count", "status <> 'closed' AND severity IN ('high', 'critical')"),
    "incidents_cross_source_open": _incidents("count", "status <> 'closed' AND source_family_count > 1"),
    "incidents_created_over_time": _incidents("over_time", keys=_names("severity"), time="created_at"),
    "incidents_by_severity": _incidents("by", keys=_names("severity")),
    "incidents_by_type": _incidents("by", keys=_names("incident_type")),
    "incidents_hosts": _incidents("by", "primary_host <> ''", {"host": "primary_host"}, limit=20),
    "incidents_users": _incidents("by", "primary_user <> ''", {"account": "primary_user"}, limit=20),
    "incidents_techniques": _incidents("by", keys={"technique": "item"}, explode="mitre_technique_ids"),
    "incidents_cross_source": _incidents("recent", "source_family_count > 1", _names("last_seen", "incident_id", "severity", "status", "incident_type", "primary_host", "input_count"), limit=200),
    "incidents_current": _incidents("recent", keys=_names("last_seen", "incident_id", "severity", "status", "incident_type", "primary_host", "primary_user", "input_count"), limit=500),
}
_ID = {"events": "source_event_id", "detections": "detection_id", "incidents": "incident_id"}


def build(report: Report, rows: DataFrame, between: tuple[Column, Column] | None = None, variables: dict[str, str] | None = None, bucket: str = "1 hour") -> DataFrame:
    """The report over rows of its table; between is the time range, variables are regular expressions that columns (or, for arrays, an element) must match ('.*' is all)."""
    if between is not None:
        rows = rows.where(F.col(report.time).between(*between))
    for name, pattern in (variables or {}).items():
        if pattern != ".*":
            rows = rows.where(_matches(rows, name, pattern))
    rows = rows.where(report.where)
    if report.condition is not None:
        rows = rows.where(report.condition())
    if report.explode:
        rows = rows.withColumn("item", F.explode(report.explode))
    keys = [F.expr(e).alias(n) for n, e in report.keys.items()]
    n = F.count(F.lit(1)).alias("n")
    if report.kind == "count":
        return rows.agg(n)
    if report.kind == "values":
        return rows.select(*keys).distinct()
    if report.kind == "over_time":
        return rows.groupBy(F.window(report.time, bucket).start.alias("bucket"), *keys).agg(n)
    if report.kind == "by":
        out = rows.groupBy(*keys).agg(n)
        return out.orderBy(F.desc("n"), *report.keys).limit(report.limit) if report.limit else out
    return rows.select(*keys).orderBy(F.desc(report.time), _ID[report.table]).limit(report.limit)


def _matches(rows: DataFrame, name: str, pattern: str) -> Column:
    if dict(rows.dtypes)[name].startswith("array"):
        return F.exists(name, lambda x: x.rlike(pattern))
    return F.col(name).rlike(pattern)


def sql(report: Report, table: str, bucket_hours: int = 1, condition: str = "true") -> str:
    """The same report in SQL over a table or CTE."""
    source = f"(SELECT *, unnest({report.explode}) AS item FROM {table})" if report.explode else table
    keys = ", ".join(f"{e} AS {n}" for n, e in report.keys.items())
    where = f"FROM {source} WHERE ({report.where}) AND ({condition})"
    if report.kind == "count":
        return f"SELECT count(*) AS n {where}"
    if report.kind == "values":
        return f"SELECT DISTINCT {keys} {where}"
    if report.kind == "over_time":
        return f"SELECT time_bucket(INTERVAL '{bucket_hours} hours', {report.time}, TIMESTAMP '1970-01-01') AS bucket, {keys}, count(*) AS n {where} GROUP BY ALL"
    if report.kind == "by":
        return f"SELECT {keys}, count(*) AS n {where} GROUP BY ALL" + (f" ORDER BY n DESC, {', '.join(report.keys)} LIMIT {report.limit}" if report.limit else "")
    return f"SELECT {keys} {where} ORDER BY {report.time} DESC, {_ID[report.table]} LIMIT {report.limit}"


def backlog(schedule: DataFrame) -> DataFrame:
    """Unevaluated inputs of all scopes and the age of the oldest; zero without rows."""
    return schedule.agg(F.coalesce(F.sum("unevaluated_input_count"), F.lit(0)).alias("backlog"), F.coalesce(F.max("oldest_unevaluated_age_seconds"), F.lit(0.0)).alias("oldest_age"))


def incident_detail(incidents: DataFrame, incident_id: str) -> DataFrame:
    return incidents.where((F.lit(incident_id) != ".*") & (F.col("incident_id") == incident_id))


def evidence_timeline(timeline: DataFrame, incident_id: str) -> DataFrame:
    """One incident's inputs in order, with the rule of detections and the action of events."""
    rows = timeline.where((F.lit(incident_id) != ".*") & (F.col("incident_id") == incident_id))
    return rows.withColumn("rule_or_action", F.when(F.col("input_kind") == "detection", F.col("rule_name")).otherwise(F.col("event_action"))).orderBy("occurred_at", "input_kind", "input_id")

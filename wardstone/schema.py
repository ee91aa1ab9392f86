"""Stored tables: the normalized event, detections, the ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXT, _INT, _LONG, _TIME = "string", "int", "bigint", "timestamp"
#: Columns of a normalized event with their types; texts default to '' and numbers to 0.
EVENT = {
    "event_time": _TIME, "ingested_at": _TIME, "event_id": _INT, "event_type": _TEXT, "channel": _TEXT, "provider_name": _TEXT, "record_id": _LONG, "computer": _TEXT, "user": _TEXT, "process_guid": _TEXT, "process_id": _LONG,
    "image": _TEXT, "image_loaded": _TEXT, "command_line": _TEXT, "parent_image": _TEXT, "parent_command_line": _TEXT, "powershell_script": _TEXT, "source_ip": _TEXT, "source_port": _INT, "destination_ip": _TEXT,
    "destination_port": _INT, "destination_hostname": _TEXT, "query_name": _TEXT, "query_status": _TEXT, "query_results": _TEXT, "target_filename": _TEXT, "target_object": _TEXT, "registry_details": _TEXT, "protocol": _TEXT,
    "initiated": "smallint", "hashes": _TEXT, "rule_name": _TEXT, "message": _TEXT, "validation_id": _TEXT, "raw_json": _TEXT, "host_name": _TEXT, "platform": _TEXT, "source_type": _TEXT, "event_category": _TEXT,
    "event_action": _TEXT, "event_code": _TEXT, "source_event_id": _TEXT, "user_name": _TEXT, "user_id": _TEXT, "process_name": _TEXT, "process_path": _TEXT, "parent_process_name": _TEXT, "parent_process_id": _LONG,
    "service_name": _TEXT, "outcome": _TEXT, "severity": _TEXT, "device_name": _TEXT, "vendor": _TEXT, "product": _TEXT, "event_kind": _TEXT, "ingestion_protocol": _TEXT, "ingestion_path": _TEXT, "source_address": _TEXT,
    "original_format": _TEXT, "network_direction": _TEXT, "rule_id": _TEXT, "signature": _TEXT, "signature_id": _TEXT, "url": _TEXT, "domain": _TEXT, "syslog_facility": _TEXT, "syslog_application": _TEXT,
}
#: Columns that make up an event's identity.
IDENTITY = ("source_type", "host_name", "source_event_id", "event_time", "raw_json")
RETENTION_DAYS = {"events": 90, "detections": 180}


def event_columns(given: dict[str, Column]) -> list[Column]:
    """The event's columns in order: what is given, cast, and the defaults for the rest."""
    unknown = set(given) - set(EVENT)
    if unknown:
        raise ValueError(f"not columns of an event: {sorted(unknown)}")
    out = []
    for name, kind in EVENT.items():
        default = F.lit("" if kind == _TEXT else None if kind == _TIME else 0).cast(kind)
        c = given.get(name)
        out.append((default if c is None else c.cast(kind) if kind == _TIME else F.coalesce(c.try_cast(kind) if kind != _TEXT else c.cast(kind), default)).alias(name))
    return out


def with_uid(events: DataFrame) -> DataFrame:
    """events with event_uid: SHA-256 over source, host, time, its own id and the raw record."""
    parts = [F.col(c) for c in ("source_type", "host_name", "source_event_id")]
    return events.withColumn("event_uid", F.sha2(F.concat_ws("\0", *parts, F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSS"), F.col("raw_json")), 256))


def retained(rows: DataFrame, time: str, days: int, now: Column | None = None) -> DataFrame:
    """Rows younger than the retention."""
    return rows.where(F.col(time) >= (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {days} DAYS"))

"""Adapters that turn tables into telemetry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stamp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as normalized telemetry: identity, clock, host, user, action, severity."""
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("value") >= 100, "high").when(F.col("value") >= 50, "medium").when(F.col("value") >= 10, "low").otherwise("informational")
    return e.select(
        F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), stamp(F.col("ts"))), 256).alias("event_uid"), "event_id", F.col("ts").alias("occurred_at"), "user_id",
        F.concat(F.lit("host-"), F.col("user_id") % 10).alias("host_name"), F.concat(F.lit("user-"), F.col("user_id")).alias("user_name"), F.col("event_type").alias("event_action"),
        severity.alias("severity"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("attr"), F.lit("linux").alias("platform"), F.lit("linux_journald").alias("source_type"),
    )


#: The same rows in SQL, as the body of a CTE named t.
EVENTS_SQL = """SELECT sha256(event_type || '|' || user_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S.%g')) AS event_uid, event_id, ts AS occurred_at, user_id,
 'host-' || (user_id % 10) AS host_name, 'user-' || user_id AS user_name, event_type AS event_action,
 CASE WHEN value >= 100 THEN 'high' WHEN value >= 50 THEN 'medium' WHEN value >= 10 THEN 'low' ELSE 'informational' END AS severity, value,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS attr, 'linux' AS platform, 'linux_journald' AS source_type FROM events"""

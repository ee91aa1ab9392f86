"""Queries that run whole flows: sources put together, incremental and streaming detection, transport filters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correlate, incremental, lifecycle, sigma, views
from ..sources.files import SYSMON_IDS, audit_events, event_log, journal, schema_differences
from ..sources.telemetry import events, table
from ..streaming.engine import DetectionEngine
from ..streaming.store import Store
from . import normalize
from .catalogue import D, RULES, T, query
from .report_queries import EVENTS, security


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumnRenamed("occurred_at", "event_time")


_FOUND = D + "SELECT sha256(rule_id || chr(0) || event_uid) AS detection_id, rule_id FROM r"


@query(_FOUND)
def incremental_detections(spark, sf_dir):
    """Three batches that overlap, the second broken off between detections and ledger: each detection is written once."""
    store = Store(spark, _folder(spark))
    engine = DetectionEngine(spark, store, sigma.compile_rules(RULES))
    rows = _telemetry(spark, sf_dir)
    engine.run_batch(rows.where("event_id % 3 = 0"), 0)
    try:
        engine.run_batch(rows.where("event_id % 2 = 0"), 1, fail_after="detections")
    except RuntimeError:
        pass
    engine.run_batch(rows, 2)
    return spark.read.parquet(f"{store.path}/detections").select("detection_id", "rule_id")


@query(_FOUND)
def streaming_detections(spark, sf_dir):
    """The same through a streaming query that takes all files there are and ends, run twice."""
    folder = _folder(spark)
    rows = _telemetry(spark, sf_dir)
    rows.repartition(3).write.parquet(f"{folder}/in")
    engine = DetectionEngine(spark, Store(spark, f"{folder}/out"), sigma.compile_rules(RULES))
    for _ in range(2):
        engine.stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in"), f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out/detections").select("detection_id", "rule_id")


@query("SELECT 'f' || (user_id % 5) AS file, event_id * 100 AS \"offset\", 'type=SYSCALL msg=audit(1.0:' || event_id || '): pid=' || event_id || chr(10) || 'type=EXECVE msg=audit(1.0:' || event_id || '): a0=x' || CASE WHEN event_id % 4 = 0 THEN '' ELSE chr(10) || 'type=EOE msg=audit(1.0:' || event_id || '):' END AS message FROM events")
def audit_assembly(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    head = F.concat(F.lit(" msg=audit(1.0:"), "event_id", F.lit("):"))
    lines = F.array(
        F.struct(F.lit(0).alias("i"), F.concat(F.lit("type=SYSCALL"), head, F.lit(" pid="), "event_id").alias("line")), F.struct(F.lit(1).alias("i"), F.concat(F.lit("type=EXECVE"), head, F.lit(" a0=x")).alias("line")),
        F.when(F.col("event_id") % 4 != 0, F.struct(F.lit(2).alias("i"), F.concat(F.lit("type=EOE"), head).alias("line"))),
    )
    rows = e.select(F.concat(F.lit("f"), F.col("user_id") % 5).alias("file"), "event_id", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("x"))
    return audit_events(rows.select("file", (F.col("event_id") * 100 + F.col("x.i")).alias("offset"), F.col("x.line").alias("line")))


@query("WITH ev AS (" + EVENTS + ") SELECT source_event_id FROM ev WHERE NOT (lower(process_path) LIKE '%curl' AND destination_port IN (443, 8080))")
def self_traffic_excluded(spark, sf_dir):
    return normalize.self_traffic(security(spark, sf_dir, "events"), (443, 8080), "curl").select("source_event_id")


@query("SELECT event_id, '{\"vendor\":\"OISF\",\"product\":\"Suricata\",\"source_type\":\"suricata_eve\",\"platform\":\"network\",\"device_name\":\"ids\",\"event\":' || props || '}' AS body FROM events WHERE event_id % 9 <> 0")
def eve_envelope(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "broken").otherwise(F.col("props")).alias("value"))
    good, _ = normalize.envelope(lines, "ids", ["event_id"])
    return good.select("event_id", "body")


@query("WITH ev AS (" + EVENTS + ") SELECT source_event_id FROM ev WHERE event_id IN (1, 3, 22)")
def event_log_filter(spark, sf_dir):
    return event_log(security(spark, sf_dir, "events"), SYSMON_IDS).select("source_event_id")


@query("SELECT event_id FROM events WHERE user_id % 4 = 1 OR event_type = 'error'")
def journal_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id") % 4).alias("_SYSTEMD_UNIT"), F.col("event_type").alias("_COMM"))
    return journal(rows, units=("u1",), commands=("error",)).select("event_id")


@query("SELECT * FROM (VALUES ('event_id: bigint instead of int'), ('nothing: missing instead of string')) v(difference)")
def schema_contract(spark, sf_dir):
    found = schema_differences(table(spark, sf_dir, "events"), {"event_id": "int", "user_id": "bigint", "nothing": "string"})
    return spark.createDataFrame([(x,) for x in found], "difference string")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAYS")
def retention(spark, sf_dir):
    from ..schema import retained

    return retained(table(spark, sf_dir, "events"), "ts", 7, F.to_timestamp_ntz(F.lit("2024-01-30 00:00:00"))).select("event_id")


@query("""WITH o AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 5 = 1 THEN 'closed' ELSE 'acknowledged' END AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS n FROM orders),
 f AS (SELECT c, min(n) FILTER (s = 'closed') AS fc, min(n) FILTER (s = 'acknowledged') AS fa, count(*) FILTER (s = 'acknowledged') AS acks FROM o GROUP BY c)
 SELECT f.c AS incident_id, CASE WHEN fc IS NULL THEN 'acknowledged' ELSE 'closed' END AS status, CAST(1 + CASE WHEN fc IS NULL THEN 0 ELSE 1 END + CASE WHEN fa IS NOT NULL AND (fc IS NULL OR fa < fc) THEN 1 ELSE 0 END AS INTEGER) AS revision, CAST((SELECT count(*) FROM o WHERE o.c = f.c AND s = 'acknowledged' AND n > fc) AS INTEGER) AS refused FROM f""")
def lifecycle_states(spark, sf_dir):
    """Every customer as an incident, every order as a transition that is asked for twice."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("incident_id"), F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 5 == 1, "closed").otherwise("acknowledged").alias("to"), F.col("o_orderdate").alias("at"))
    return lifecycle.replayed(o.union(o), "incident_id", "id", "to", "at")


@query(T + "SELECT event_id, 'i-' || user_id AS incident_id FROM t WHERE severity = 'high' AND event_uid IN (SELECT event_uid FROM t WHERE attr % 2 = 0)")
def confirmed_links(spark, sf_dir):
    e = events(spark, sf_dir)
    ledger = e.where("attr % 2 = 0").select(F.col("event_uid").alias("evaluation_token"))
    links = e.where("severity = 'high'").select("event_id", F.concat(F.lit("i-"), "user_id").alias("incident_id"), F.col("event_uid").alias("introduction_revision_token"))
    return views.confirmed(links, ledger, "introduction_revision_token").select("event_id", "incident_id")


@query("SELECT o_custkey, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_custkey)")
def immutable_append(spark, sf_dir):
    """Rows appended twice by key are there once; keys of the first append keep their content."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    first = incremental.first_per_key(o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "status")
    store = Store(spark, _folder(spark))
    store.append_new("t", first.where("o_custkey % 2 = 0"), ["o_custkey"], ["status"])
    store.append_new("t", first, ["o_custkey"], ["status"])
    return spark.read.parquet(f"{store.path}/t")


@query(T + """SELECT host_name, count(*) AS evaluated, count(*) FILTER (event_action IN ('error', 'purchase')) AS matched, count(*) FILTER (event_action = 'error') AS created, count(*) FILTER (event_action = 'purchase') AS updated, CAST(sum(attr % 3) AS BIGINT) AS links,
 count(*) FILTER (event_action = 'signup') AS invalid, count(*) FILTER (severity = 'high') AS late_outside, count(*) FILTER (severity = 'high' AND attr > 50) AS outside_horizon, count(*) FILTER (event_action = 'view') AS failed FROM t GROUP BY host_name""")
def cycle_statistics(spark, sf_dir):
    action = F.create_map(*[F.lit(x) for x in ("error", "created", "purchase", "updated", "click", "no_match", "signup", "invalid_input", "view", "failed")])[F.col("event_action")]
    high = F.col("severity") == "high"
    rows = events(spark, sf_dir).withColumns({"action": action, "lateness": F.when(high, "late_outside_boundary").otherwise("on_time"), "reason": F.when(high & (F.col("attr") > 50), "outside_reconciliation_horizon").otherwise(""), "members": F.array_repeat(F.lit(1), (F.col("attr") % 3).cast("int"))})
    return correlate.cycle_statistics(rows, ["host_name"])


@query(T + "SELECT host_name AS correlation_rule_id, event_action AS violation_type, count(*) AS n, count(DISTINCT (severity, user_id)) AS inputs, list_slice(list_sort(list(DISTINCT 'p' || (attr % 5))), 1, 2) AS projections, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM t GROUP BY host_name, event_action")
def integrity_summary(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("host_name").alias("correlation_rule_id"), F.col("event_action").alias("violation_type"), F.col("severity").alias("input_kind"), F.col("user_id").alias("input_id"), F.concat(F.lit("p"), F.col("attr") % 5).alias("projection_name"), F.col("occurred_at").alias("detected_at"))
    return incremental.integrity_summary(rows)


@query(T.rstrip() + """, l AS (SELECT user_id, max(epoch_ms(occurred_at)) AS last, max(occurred_at) AS last_at FROM t GROUP BY user_id),
 c AS (SELECT l.user_id, last, last_at, (SELECT count(*) FROM t WHERE t.user_id = l.user_id AND event_action = 'error' AND last - epoch_ms(occurred_at) <= 172800000) AS errors,
 (SELECT count(*) FROM t b WHERE b.user_id = l.user_id AND b.event_action = 'purchase' AND (SELECT count(*) FROM t a WHERE a.user_id = l.user_id AND a.event_action = 'error' AND epoch_ms(a.occurred_at) < epoch_ms(b.occurred_at) AND last - epoch_ms(a.occurred_at) <= 172800000) >= 2) AS done FROM l)
SELECT user_id, CASE WHEN errors < 2 THEN 0 WHEN done = 0 THEN 1 ELSE 2 END AS stages_done, last_at FROM c""")
def sequence_progress(spark, sf_dir):
    stages = [(F.col("event_action") == "error", 2), (F.col("event_action") == "purchase", 1)]
    return correlate.sequence_progress(events(spark, sf_dir), ["user_id"], "occurred_at", 172_800_000, stages)

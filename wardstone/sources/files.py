"""File sources: landing zones, multi-line audit records, journals, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AUDIT_START = r"^type=(?:SYSCALL|EXECVE|USER_CMD|USER_LOGIN|USER_AUTH|USER_ACCT|CRED_ACQ|CRED_DISP) "
SYSMON_IDS = (1, 3, 7, 11, 13, 22)


def landing(spark: SparkSession, path: str, route: str, stream: bool = False) -> DataFrame:
    """JSON lines of a folder as rows for the normalizer; stream=True follows new files."""
    lines = (spark.readStream if stream else spark.read).format("text").load(path)
    return lines.select(F.lit(route).alias("path"), F.col("value").alias("body"), F.lit("").alias("peer"), F.lit(None).cast("string").alias("validation_id"), F.current_timestamp().alias("received_at"))


ENVELOPE = "path string, peer string, headers map<string,string>, body string, received_at timestamp"


def requests(spark: SparkSession, path: str, stream: bool = False, header: str = "x-validation-id") -> DataFrame:
    """Requests that a receiver put down as JSON lines (ENVELOPE) as rows for the normalizer: the path routes them, the header's name is read without regard to case."""
    lines = (spark.readStream if stream else spark.read).schema(ENVELOPE).json(path)
    named = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k) == header)
    return lines.select("path", "body", F.coalesce("peer", F.lit("")).alias("peer"), F.get(F.map_values(named), F.lit(0)).alias("validation_id"), F.coalesce("received_at", F.current_timestamp()).alias("received_at"))


def recovered(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Newline-delimited JSON that was kept while the store was away: (rows of the schema, lines that aren't)."""
    bad = "_broken"
    rows = spark.read.schema(f"{schema}, {bad} string").option("columnNameOfCorruptRecord", bad).json(path)
    # the JSON reader drops columns that a query doesn't name, broken lines with them
    rows = rows.withColumn("_kept", F.col(bad).isNull())
    return rows.where("_kept").drop(bad, "_kept"), spark.read.text(path).where(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).isNull() | F.try_parse_json("value").isNull())


def audit_events(lines: DataFrame, start: str = AUDIT_START, end: str = r"^type=EOE ") -> DataFrame:
    """file, offset, message: audit lines (file, offset, line) put together; a record starts at a start line after an end line or with another serial, and holds lines up to its end line."""
    serial = F.regexp_extract("line", r"msg=audit\(([0-9.]+:[0-9]+)\)", 1)
    w = Window.partitionBy("file").orderBy("offset")
    rows = lines.withColumn("serial", serial)
    fresh = F.lag("serial").over(w).isNull() | (F.lag("serial").over(w) != F.col("serial")) | F.coalesce(F.lag("line").over(w).rlike(end), F.lit(False))
    rows = rows.withColumn("n", F.sum(fresh.cast("int")).over(w))
    out = rows.groupBy("file", "n").agg(F.min("offset").alias("offset"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "line"))), lambda x: x["line"]), "\n").alias("message"))
    return out.where(F.col("message").rlike(start)).select("file", "offset", "message")


def journal(rows: DataFrame, units: tuple = (), identifiers: tuple = (), commands: tuple = ()) -> DataFrame:
    """Journal export rows of any of the units, identifiers or commands."""
    keep = F.lit(False)
    for column, values in (("_SYSTEMD_UNIT", units), ("SYSLOG_IDENTIFIER", identifiers), ("_COMM", commands)):
        if values and column in rows.columns:
            keep = keep | F.coalesce(F.col(column).isin(*values), F.lit(False))
    return rows.where(keep)


def event_log(rows: DataFrame, ids: tuple[int, ...] = SYSMON_IDS) -> DataFrame:
    return rows.where(F.col("event_id").isin(*ids))


def schema_differences(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """What a table's columns lack of a contract."""
    have = dict(df.dtypes)
    return sorted([f"{c}: {have.get(c, 'missing')} instead of {t}" for c, t in expected.items() if have.get(c) != t])

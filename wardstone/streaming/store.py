"""Tables of an engine in a folder of Parquet files, with appends that can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import incremental

LEDGER = "engine_id string, ruleset string, event_uid string, event_time timestamp, evaluated_at timestamp, source_type string, host_name string"
CHECKPOINT = "engine_id string, ruleset string, batch long, evaluated long, detections long, newest timestamp, updated_at timestamp"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str, schema: str | T.StructType) -> DataFrame:
        """The table, or no rows where nothing was written yet."""
        path = f"{self.path}/{name}"
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame, by: list[str] | None = None) -> None:
        writer = rows.write.mode("append")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{name}")

    def append_new(self, name: str, rows: DataFrame, keys: list[str], content: list[str]) -> None:
        """Rows whose key is not there yet; different content under a stored key is an error."""
        self.append(name, incremental.new_rows(rows, self.read(name, rows.schema), keys, content))


    def backfill(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """A projection of rows that were there before the table: those that it lacks."""
        self.append(name, rows.dropDuplicates(keys).join(self.read(name, rows.schema).select(*keys), keys, "left_anti").select(*rows.columns))

    def seed(self, name: str, docs: list[dict], schema: str) -> DataFrame:
        """Fixture documents as rows of a table; fields that they lack are null."""
        rows = self.spark.createDataFrame(docs, schema)
        self.append(name, rows)
        return rows

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def enrolled_since(self, scope: dict[str, str | int], requested: DataFrame, floor: str) -> object:
        """The floor of a scope: the one that was stored when it was first seen, else the requested one, which is stored for good. A scope that comes back finds its own."""
        schema = ", ".join([*[f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in scope.items()], "floor timestamp"])
        here = incremental.all_of(*[F.col(k) == v for k, v in scope.items()])
        found = self.read("scopes", schema).where(here).agg(F.min("floor")).first()[0]
        if found is None:
            rows = requested.select(*[F.lit(v).alias(k) for k, v in scope.items()], F.col(floor).cast("timestamp").alias("floor"))
            self.append("scopes", rows)
            found = self.read("scopes", schema).where(here).agg(F.min("floor")).first()[0]
        return found

    def confirm(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Read back: an error unless every key of rows is stored exactly once."""
        stored = self.read(name, rows.schema).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        wrong = rows.select(*keys).distinct().join(stored, keys, "left").where(F.coalesce("_n", F.lit(0)) != 1)
        if not wrong.isEmpty():
            raise incremental.Conflict(f"{name}: a key is missing or stored twice")


def write_events(events: DataFrame, path: str) -> None:
    """Append events by month, sorted for row-group skipping."""
    rows = events.withColumn("yyyymm", F.date_format("event_time", "yyyyMM"))
    rows.sortWithinPartitions("event_type", "event_time", "computer", "event_id").write.mode("append").partitionBy("yyyymm").parquet(path)


def write_rejects(rows: DataFrame, path: str) -> None:
    """Dead letters as JSON lines by day."""
    rows.withColumn("dt", F.date_format("received_at", "yyyy-MM-dd")).write.mode("append").partitionBy("dt").json(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", "false").csv(path)


def fan_out(batch: DataFrame, sinks: list) -> None:
    """One batch into several projections, read once."""
    batch.persist()
    try:
        for sink in sinks:
            sink(batch)
    finally:
        batch.unpersist()

"""Shared storage, batching and null handling of the operators in this folder."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master, whose executor is the driver, may do without: it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="wardstone-")
        atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
    return f"file://{_own[key]}"


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, scratch: list[DataFrame] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors, forgets the partitioning. scratch collects tables that the caller drops."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "snappy").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if scratch is not None:
        scratch.append(out)
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the files of a written() table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, mb: int = 4) -> None:
    """Arrow batches of a few MB: texts may be long, and a batch is held several times over by a Python worker and the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(125 * mb))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def give_back() -> None:
    """Return freed memory of this Python worker to the system: workers live on between tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def released(run):
    """run, for mapInArrow, which gives memory back when a task's last batch is done."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20):
    """Parts of a batch whose texts in column sum to max_bytes at most (a single longer text comes alone)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))

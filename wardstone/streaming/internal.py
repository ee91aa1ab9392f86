"""Internal logs: what streaming queries report of themselves, as JSON lines that can be read like any other source."""

from __future__ import annotations

import json
import threading
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "at string, kind string, query string, batch long, rows long, rows_per_second double, error string"


class InternalLog(StreamingQueryListener):
    """Writes one line per event to a file of the driver: queries that start, make progress, idle, or end."""

    def __init__(self, path: str | Path):
        self.path, self.lock = Path(path), threading.Lock()
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def _write(self, **row) -> None:
        with self.lock, self.path.open("a") as f:
            f.write(json.dumps(row) + "\n")

    def onQueryStarted(self, event) -> None:
        self._write(at=event.timestamp, kind="started", query=str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._write(at=p.timestamp, kind="progress", query=str(p.id), batch=p.batchId, rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        self._write(at=event.timestamp, kind="idle", query=str(event.id))

    def onQueryTerminated(self, event) -> None:
        self._write(at="", kind="terminated", query=str(event.id), error=event.exception)


def internal_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)

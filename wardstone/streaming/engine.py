"""Incremental detection: batches of events against a ledger, exactly once in effect, replayable after a crash at any point."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import incremental, sigma
from ..operators.correlation_rules import ruleset_fingerprint
from .store import CHECKPOINT, LEDGER, Store


class DetectionEngine:
    """Detections are written before the ledger marks their events; a repeat finds the detections by their ids and writes none twice. A changed ruleset is a new scope with its own floor:
    ``lookback`` before the time at which it is first seen, stored then and never moved. Without a lookback all history counts. Rows without an identity go to ``rejected`` and are not evaluated."""

    def __init__(self, spark: SparkSession, store: Store, rules: list[sigma.Rule], engine_id: str = "detection", lookback: str | None = None, observed: str | None = None):
        self.spark, self.store, self.rules, self.engine_id, self.observed = spark, store, rules, engine_id, observed
        self.scope, self.floor = ruleset_fingerprint(rules), None
        if lookback is not None:
            now = spark.range(1).select((F.current_timestamp() - F.expr(f"INTERVAL {lookback}")).alias("at"))
            self.floor = store.enrolled_since({"engine_id": engine_id, "ruleset": self.scope}, now, "at")

    def _scope(self, df: DataFrame) -> DataFrame:
        return df.where((F.col("engine_id") == self.engine_id) & (F.col("ruleset") == self.scope))

    def pending(self, events: DataFrame) -> DataFrame:
        ledger = self._scope(self.store.read("ledger", LEDGER))
        if self.floor is not None:
            events = incremental.enrolled(events, F.lit(self.floor), "event_time", self.observed)
        return incremental.unevaluated(events.where(self._known()), ledger, ["event_uid"])

    @staticmethod
    def _known():
        return F.coalesce(F.trim("event_uid") != "", F.lit(False))

    def run_batch(self, events: DataFrame, batch: int = 0, fail_after: str | None = None) -> dict:
        """Evaluate what the ledger doesn't have yet. fail_after names a step after which to break off (tests)."""
        began = time.monotonic()
        todo = self.pending(events).dropDuplicates(["event_uid"]).persist()
        lost = events.where(~self._known())
        if not lost.isEmpty():
            self.store.append("rejected", lost.select(F.to_json(F.struct("*")).alias("body"), F.lit("blank event_uid").alias("ingest_error"), F.current_timestamp().alias("received_at")))
        try:
            found = sigma.detect(todo, self.rules, keep=[c for c in ("event_uid", "event_time", "source_type", "host_name", "user_name", "platform") if c in events.columns])
            found = found.drop("event_uid")
            stored = self.store.read("detections", found.schema)
            self.store.append("detections", found.dropDuplicates(["detection_id"]).join(stored.select("detection_id"), "detection_id", "left_anti"))
            if fail_after == "detections":
                raise RuntimeError("broken off after detections")
            now = F.current_timestamp()
            self.store.append("ledger", todo.select(F.lit(self.engine_id).alias("engine_id"), F.lit(self.scope).alias("ruleset"), "event_uid", F.col("event_time").cast("timestamp").alias("event_time"), now.alias("evaluated_at"), "source_type", "host_name"))
            if fail_after == "ledger":
                raise RuntimeError("broken off after the ledger")
            row = todo.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("event_time").cast("timestamp")).alias("newest")).first()
            done = {"batch": batch, "evaluated": row.n, "newest": row.newest, "seconds": time.monotonic() - began}
            self.store.append("checkpoints", self.spark.createDataFrame([(self.engine_id, self.scope, batch, row.n, 0, row.newest, None)], CHECKPOINT).withColumn("updated_at", now))
            return done
        finally:
            todo.unpersist()

    def stream(self, events: DataFrame, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        """A streaming query over events; without an interval it takes all that is there and ends."""
        writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.run_batch(df, n) and None)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

    def status(self, events: DataFrame) -> dict:
        ledger = self._scope(self.store.read("ledger", LEDGER))
        row = incremental.backlog(events, ledger, ["event_uid"], "event_time").first()
        return {"engine": self.engine_id, "ruleset": self.scope, "evaluated": ledger.count(), "backlog": row.unevaluated_count, "oldest": row.oldest_unevaluated}


def drain(step, page: int, rest: float = 10.0, most: int = 10, sleep=time.sleep, cycles: int | None = None) -> int:
    """Run step (returning how many rows it took) again at once while pages are full, pausing briefly after most of them, else rest. Errors back off from 1 to 60 s."""
    full, wait, done = 0, 1.0, 0
    while cycles is None or done < cycles:
        done += 1
        try:
            n = step()
            wait = 1.0
        except Exception:
            sleep(wait)
            wait = min(60.0, wait * 2)
            continue
        full = full + 1 if n >= page else 0
        if not full:
            sleep(rest)
        elif full % most == 0:
            sleep(0.1)
    return done

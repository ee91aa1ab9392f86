"""Commands over a store: ``status``, ``test-rule`` and ``transition``; each prints one JSON object.

    python -m wardstone.cli test-rule rule.yml events/ --limit 100
    python -m wardstone.cli status store/ events/
    python -m wardstone.cli transition store/ rule.yml INCIDENT TRANSITION closed
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from .operators import lifecycle, sigma
from .operators.correlation_rules import compile_correlation
from .sources.rules import parse_strict, shipped
from .streaming.correlation import CorrelationEngine
from .streaming.engine import DetectionEngine
from .streaming.store import Store

MAX_ROWS = 10_000


def run_rule(spark: SparkSession, doc: dict, events: str, limit: int = 100) -> dict:
    """A dry run: the rule's plan, how many of the events match, and some of them. Nothing is written."""
    rule = sigma.compile_rule(doc)
    found = sigma.detect(spark.read.parquet(events), [rule], keep=[]).select("detection_id", "source_event_uid", "evidence_json")
    return {"plan": rule.plan(), "matches": found.count(), "sample": [r.asDict() for r in found.orderBy("detection_id").limit(min(limit, MAX_ROWS)).collect()]}


def status(spark: SparkSession, store: str, events: str) -> dict:
    return DetectionEngine(spark, Store(spark, store), sigma.compile_rules(shipped("detection"))).status(spark.read.parquet(events))


def transition(spark: SparkSession, store: str, doc: dict, incident: str, id: str, to: str, at_ms: int | None = None) -> dict:
    engine = CorrelationEngine(spark, Store(spark, store), compile_correlation(doc))
    now = engine.transition(incident, id, to, int(time.time() * 1000) if at_ms is None else at_ms)
    return {"incident_id": incident, "status": now.status, "revision": now.revision, "late_accept_until_ms": now.late_accept_until_ms}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wardstone")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in (("test-rule", ("rule", "events")), ("status", ("store", "events")), ("transition", ("store", "rule", "incident", "id", "to"))):
        p = commands.add_parser(name)
        for w in words:
            p.add_argument(w)
        if name == "test-rule":
            p.add_argument("--limit", type=int, default=100)
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if a.command == "test-rule":
            out = run_rule(spark, yaml.safe_load(Path(a.rule).read_text()), a.events, a.limit)
        elif a.command == "status":
            out = status(spark, a.store, a.events)
        else:
            out = transition(spark, a.store, parse_strict(Path(a.rule).read_text()), a.incident, a.id, a.to)
    except (ValueError, lifecycle.TransitionError) as e:  # rule, document and transition errors are values that don't fit
        print(json.dumps({"error": str(e)}))
        return 1
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())

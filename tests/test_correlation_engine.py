"""Incremental correlation against one batch over all inputs, broken off at every step."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_rules import _det, _inputs, _rule
from wardstone.operators import incidents, lifecycle
from wardstone.streaming.correlation import LINK, BrokenOff, CorrelationEngine
from wardstone.streaming.store import Store


def _rows(n=60):
    rng = random.Random(4)
    out = [_det(f"{i:03}", i * 40, rng.choice("abc"), rng.choice(["h1", "h2"]), severity=rng.choice(["low", "medium", "high"])) for i in range(n)]
    return out + [_det("900", 100, "a", "h1"), _det("900", 100, "b", "h1"), _det("901", 50, "a", None)]


def test_batches_equal_one_run(spark, tmp_path):
    rule, rows = _rule("host-suspicious-activity"), _rows()
    every = _inputs(spark, rows).cache()
    expected = incidents.evaluate(rule, every).cache()
    engine = CorrelationEngine(spark, Store(spark, str(tmp_path)), rule)
    cut = F.unix_millis("occurred_at") - F.unix_millis(F.lit("2026-01-01 12:00:00").cast("timestamp"))
    for n, step in enumerate(("incidents", "links", "confirmation", "ledger", None)):
        part = every.where(cut < (n + 1) * 700_000)
        if step:
            with pytest.raises(BrokenOff):
                engine.run_batch(part, n, fail_after=step)
            if n % 2:
                continue  # the next batch takes up what this one left
        done = engine.run_batch(part, n)
        assert done["failed"] == 0
    want = {(r.input_kind, r.input_id): (r.action, r.reason, r.incident_id) for r in expected.collect()}
    got = {(r.input_kind, r.input_id): (r.action, r.reason_code, r.incident_id) for r in engine.ledger().collect()}
    assert got == want and engine.ledger().count() == len(want)
    links = sorted((r.incident_id, r.input_id, r.relationship) for r in incidents.links(expected).collect())
    assert sorted((r.incident_id, r.input_id, r.relationship) for r in engine.confirmed("links", LINK).collect()) == links and links
    status = engine.status(every)
    assert status["backlog"] == 0 and status["incidents"] == len({i for i, _, _ in links}) == engine.incidents(every).count()
    assert engine.run_batch(every, 9)["evaluated"] == 0


def test_floor_blocked_scope_and_closure(spark, tmp_path):
    rule = _rule("host-suspicious-activity")
    store = Store(spark, str(tmp_path))
    first = [_det("1", 0, "a"), _det("2", 10, "b")]
    inputs = _inputs(spark, first)
    engine = CorrelationEngine(spark, store, rule, floor=datetime(2026, 1, 1, 11))
    assert CorrelationEngine(spark, store, rule, floor=datetime(2030, 1, 1)).floor == engine.floor
    assert not engine.preflight(inputs, inputs.limit(1), "history") and engine.preflight(inputs, inputs, "history")
    assert engine.run_batch(inputs, 0, intact=False)["blocked"] and engine.ledger().count() == 0
    assert engine.run_batch(inputs, 1)["created"] == 1
    incident = engine.incidents(inputs).first().incident_id
    closed = int(datetime(2026, 1, 1, 12, 1).timestamp() * 1000)
    assert engine.transition(incident, "t1", "closed", closed).status == "closed" and engine.transition(incident, "t1", "closed", closed).revision == 2
    with pytest.raises(lifecycle.TransitionError):
        engine.transition(incident, "t2", "acknowledged", closed)
    more = _inputs(spark, [*first, (*_det("3", 20, "c")[:4], 300), _det("4", 90, "d")])
    engine.run_batch(more, 2)
    got = {r.input_id: (r.action, r.reason_code) for r in engine.ledger().collect()}
    assert got["3"] == ("enriched_closed", "matched") and got["4"] == ("no_match", "late_outside_boundary")
    assert engine.incidents(more).first().status == "closed"


def test_decisions_read_the_inputs_once(spark, tmp_path):
    """Canonical rows are staged; what is decided from them reads no input again."""
    _inputs(spark, _rows()).write.parquet(f"{tmp_path}/inputs")
    engine = CorrelationEngine(spark, Store(spark, f"{tmp_path}/store"), _rule("host-suspicious-activity"))
    kept, append = [], engine.store.append
    engine.store.append = lambda name, rows, by=None: (kept.append((name, rows.inputFiles())), append(name, rows, by))
    engine.run_batch(spark.read.parquet(f"{tmp_path}/inputs"))
    read = [name for name, files in kept if any("/inputs/" in f for f in files)]
    assert len(read) == 1 and read[0].startswith("staging/") and read[0].endswith("/rows")

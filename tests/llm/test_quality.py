import zlib

import numpy as np
import pyarrow as pa

from wardstone.llm.quality import NAMES, features, isotonic, keep_quality, quality_scores


def _rows(prose):
    good = [(i, prose(60 + i % 50, i)) for i in range(300)]
    bad = [(1000 + i, (f"SPAM{i}!! " * 40) if i % 2 else "word " * (30 + i)) for i in range(200)]
    return good, bad


def test_held_out_accuracy(spark, frame, prose):
    good, bad = _rows(prose)
    docs = frame(good + bad, clash=True)
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:250]] + [(i, 0) for i, _ in bad[:150]] + [(None, 1), (3, 1), (5, None)], "doc_id long, quality int").selectExpr("*", "0 AS x")
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == 500
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, i < 1000) for i, r in got.items() if r.held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_labels_of_held_out_rows_are_not_learnt(spark, frame, prose):
    good, bad = _rows(prose)
    docs = frame(good + bad)
    true = [(i, int(i < 1000)) for i, _ in good + bad]
    lies = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in true]
    a, b = ({r.doc_id: r.score for r in quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (true, lies))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_edge_cases(spark, frame, edge):
    docs = frame(edge)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(abs(r.score - 0.5) < 0.01 for r in quality_scores(docs, none).collect())
    one = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    out = quality_scores(docs, one).collect()
    assert len(out) == len(edge) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1 and not any(r.held_out for r in out if r.doc_id is None)
    assert quality_scores(frame([]), one).count() == 0 and keep_quality(frame([]), none).count() == 0


def test_features():
    x = features(pa.array(["AB cd! 12\n", "", None, "aa aa aa bb"]))
    at = NAMES.index
    assert x[0, at("upper")] == 0.2 and x[0, at("digit")] == 0.2 and x[0, at("line_ends")] == 0.1 and x[0, at("signs")] == 0.1
    assert not x[1].any() and not x[2].any() and abs(x[3, at("top_word")] - 0.75) < 1e-9 and x[3, at("repeats")] == 0.5


def test_isotonic():
    at, v = isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert at.tolist() == [0, 1.5, 3] and v.tolist() == [0, 0.5, 1]

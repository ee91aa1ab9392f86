import re

import numpy as np
import pyarrow as pa

from wardstone.llm.common import slices
from wardstone.llm.components import components
from wardstone.llm.kernel import shingle_sets, word_hash, words

RUN = re.compile(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+")


def test_words_are_those_of_the_definition(edge, prose):
    texts = [t for _, t in edge] + [prose(n, n) for n in range(12)]
    w = words(pa.array(texts, pa.string()))
    b = w.bounds()
    for i, t in enumerate(texts):
        own = [m.encode() for m in RUN.findall((t or "").lower())]
        assert [bytes(w.data[s:e]) for s, e in zip(w.start[b[i] : b[i + 1]], w.end[b[i] : b[i + 1]])] == own
        if len(own) < 500:
            assert w.h[b[i] : b[i + 1]].tolist() == [word_hash(x.decode()) for x in own]


def test_hashes_do_not_depend_on_the_batch(prose):
    texts = [prose(50, i) for i in range(30)]
    whole = shingle_sets(pa.array(texts))
    for t, s in zip(texts, whole):
        assert np.array_equal(shingle_sets(pa.array(["pad", t]))[1], s)
        n = len(RUN.findall(t))
        assert len(s) <= n - 4 and len(s) > 0
    short = shingle_sets(pa.array(["a b c d", "A, b; c d!", "a b c", "", None]))
    assert np.array_equal(short[0], short[1]) and not np.array_equal(short[0], short[2]) and [len(x) for x in short] == [1, 1, 1, 0, 0]


def test_slices(edge):
    b = pa.RecordBatch.from_pydict({"text": [t for _, t in edge]}, pa.schema([("text", pa.string())]))
    parts = list(slices(b, "text", 1000))
    assert sum(p.num_rows for p in parts) == len(edge) and all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 1000 for p in parts)
    assert list(slices(b.slice(0, 0), "text")) == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200), (300, 250), (250, 275)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200, 250: 250, 275: 250, 300: 250}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

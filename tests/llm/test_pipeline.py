"""The pipeline against its stages done by hand, and the registration of queries."""

import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages_against_brute_force(spark):
    import corpus_pipeline as p
    from wardstone.llm import decontam, ngram_join, pieces, pii, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "sentencepiece"]
    good = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    from .test_ngram_join import brute

    first = {i for i, c, _ in brute(rows) if i == c}
    texts = {i: t for i, t in rows if i in first}
    left = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    leaked = {r.doc_id for r in decontam.leaks(left, bench).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(left.where(~left.doc_id.isin(list(leaked)))).collect()}
    out = {r.doc_id: r for r in p.run(spark, SF).collect()}
    assert set(out) == set(clean)
    model = pieces.Pieces.load()
    for i, r in out.items():
        assert r.text == clean[i] and r.n_chars == len(clean[i])
        ids, _ = model.encode_batch([clean[i]])
        assert list(r.ids) == ids.tolist() and model.decode(r.ids) == clean[i]


def test_every_operator_has_one_query(spark):
    import __spark_entry__ as e

    names = list(e.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)

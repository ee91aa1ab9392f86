"""The columns of queries that SQL can express, whole tables, in DuckDB."""

import os

import pytest

from wardstone.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")

URLS = """WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
 p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
 r(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block'))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, (SELECT arg_max(rule, length(rule)) FROM r WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/')))) AS rule FROM p"""
EDITS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS n, first_value(coalesce(text, '')) OVER (ORDER BY doc_id) AS f FROM documents)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(coalesce(n, f), 1, length(t) // 4)) AS edited_sha256 FROM d"""


@pytest.mark.parametrize("name,sql", [("op6_url_filters", URLS), ("op4_document_fingerprints", EDITS)])
def test_plain_columns(spark, name, sql):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    db = duckdb.connect()
    for t in ("pages", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = db.sql(sql)
    got = QUERIES[name](spark, SF).select(*rel.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rel.fetchall(), key=repr) and got

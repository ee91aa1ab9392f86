"""Queries of this folder, one per operator, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spots import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_matches

    return license_matches(_table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digests

    return digests(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .pii import KINDS, pii_spans

    found = pii_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import all_documents

    return all_documents(_table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import deduplicated

    return deduplicated(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_warc, op3_quality_classifier, op4_document_fingerprints, op5_license_scans, op6_url_filters, op7_sentencepiece, op8_pii, op9_ngram_jaccard_join, op10_suffix_array_dedup)}

#: SQL of the operators that SQL can express; the others are tested against brute force, an exact round trip or held-out rows.
ORACLES: dict[str, str] = {
    "op2_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
 x AS (SELECT *, sha1(h) AS s FROM p),
 v AS (SELECT *, [('0x' || substr(s, 5 * i + 1, 5))::BIGINT FOR i IN range(8)] AS g FROM x)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((g[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
 CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM v""",
    "op9_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[0-9a-z]|[^\x00-\x7F])+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(i) WHERE len(ws) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 5 * c >= 4 * (x.n + y.n - c)),
 r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(other) FROM r WHERE r.doc_id = d.doc_id), d.doc_id)) AS class_id, coalesce(k.n_links, 0) AS n_links, coalesce(k.n_copies, 0) AS n_copies
FROM documents d LEFT JOIN (SELECT a, count(*) AS n_links, count(*) FILTER (same) AS n_copies FROM l GROUP BY a) k ON k.a = d.doc_id""",
    "op10_suffix_array_dedup": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
 x AS (SELECT doc_id, p, array_slice(b, p + 1, p + 50) AS w FROM d, unnest(range(0, greatest(n - 49, 0))) AS u(p)),
 m AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS o FROM x) WHERE o < doc_id),
 i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS f FROM m),
 g AS (SELECT doc_id, p, sum(f) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i),
 r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM g GROUP BY doc_id, k),
 c AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM r UNION ALL SELECT d.doc_id, coalesce(max(z), 0), any_value(n) FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id),
 k AS (SELECT doc_id, string_agg(hex(array_slice(b, a + 1, z)), '' ORDER BY a, z) AS kept FROM c JOIN d USING (doc_id) WHERE z > a GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce((SELECT sum(z - a) FROM r WHERE r.doc_id = d.doc_id), 0) AS BIGINT) AS n_removed, CAST((SELECT count(*) FROM r WHERE r.doc_id = d.doc_id) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
}

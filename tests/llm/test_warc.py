import base64
import gzip
import hashlib
import json

import pytest

from wardstone.llm import warc
from wardstone.llm.common import new_dir

PAGES = [(1, "http://a/", "same"), (2, "http://b/", "same"), (5, None, "same"), (3, "u", None), (4, "u\r\nX: y", ""), (6, "http://long/", "x" * 300_000), (7, "é", "é中😀"), (7, "é", "é中😀"), (None, "n", "same"), (8, "solo", "WARC/1.1\r\nWARC-Type: response\r\n\r\n")]


def _pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "'y' AS keeper")


def _expected(rows, least):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        top = max([x for x in groups[p] if x is not None], default=None) if len(groups[p]) > 1 and len(p) >= least else None
        again = top is not None and (i is None or i < top)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 3, 100])
def test_round_trip(spark, least):
    got = warc.warc_round_trip(spark, _pages(spark), least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == _expected(PAGES, least)


def test_empty_table(spark):
    assert warc.warc_round_trip(spark, _pages(spark, [])).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_splits_filters_and_payloads(spark, compression):
    path = new_dir(spark, "t")
    rows = [(i, f"http://h{i % 3}/{i}", f"page {i} " + "z" * (i * 7 % 5000)) for i in range(200)]
    warc.archive_pages(_pages(spark, rows).repartition(3), path, compression=compression, splitBytes=2000)
    local = path.removeprefix("file://")
    held = json.load(open(f"{local}/_manifest.json"))["files"]
    assert sum(len(f["splits"]) for f in held) > 10
    df = warc.read_warc(spark, path)
    assert df.rdd.getNumPartitions() == sum(len(f["splits"]) for f in held)
    assert {(r.record_id, bytes(r.payload)) for r in df.collect()} == {(f"urn:page:{i}", h.encode()) for i, _, h in rows}
    some = df.where("target_uri LIKE 'http://h1/%' AND record_type = 'response'")
    assert some.count() == 67
    reader = warc.WarcReader({"path": path, "payload": "false"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    rest = list(reader.pushFilters([EqualTo(("record_id",), "urn:page:7"), In(("record_type",), ("response",)), GreaterThan(("payload_bytes",), 3)]))
    assert [type(f) for f in rest] == [GreaterThan]
    found = [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    assert [r["record_id"] for r in found] == ["urn:page:7"] and found[0]["payload"] is None


def test_files_of_others(spark, tmp_path):
    """Members without lengths of their own, a warcinfo record, a folder without a manifest."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    body = warc.record_bytes({"record_type": "response", "record_id": "urn:page:1", "payload": b"p" * 9000, "target_uri": "http://x/"})
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(body) + gzip.compress(body))
    (tmp_path / "b.warc").write_bytes(info + body)
    df = warc.read_warc(spark, str(tmp_path))
    assert sorted((r.record_type, len(r.payload)) for r in df.collect()) == [("response", 9000)] * 3 + [("warcinfo", 5)] * 2
    assert df.where("record_type = 'response'").count() == 3 and warc.read_warc(spark, str(tmp_path), payload="false").where("payload IS NULL").count() == 5
    assert len(warc.scan_bytes((tmp_path / "a.warc.gz").read_bytes())) == 3


@pytest.mark.parametrize("packed", [False, True])
def test_truncated_archives_are_errors(spark, tmp_path, packed):
    """A file cut anywhere but between records fails; nothing is left out in silence."""
    record = lambda i: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nContent-Type: text/html\r\nContent-Length: 300\r\n\r\n".encode() + (str(i) * 300).encode() + b"\r\n\r\n"
    parts = [gzip.compress(record(i), mtime=0) if packed else record(i) for i in range(3)]
    whole = b"".join(parts)
    borders = {len(b"".join(parts[:k])) for k in range(4)} | (set() if packed else {len(b"".join(parts[:k])) - j for k in range(1, 4) for j in (2, 4)})
    name = tmp_path / f"a.warc{'.gz' if packed else ''}"
    for cut in sorted({*borders, *range(len(parts[0]) + 5, len(whole), 61 if not packed else 11), len(whole) - 1}):
        name.write_bytes(whole[:cut])
        read = lambda n: list(warc.WarcReader({"path": str(name), "payload": n}).read(warc._Split(str(name), 0, None)))  # noqa: B023, E731
        for n in ("true", "false"):
            if cut in borders or (not packed and any(0 <= b - cut <= 4 for b in borders)):
                read(n)
            else:
                with pytest.raises((warc.Truncated, ValueError)):
                    read(n)

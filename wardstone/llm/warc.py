"""WARC archives as a Spark Python data source: ``format("warc")`` reads and writes.

Writing: one archive per task, one gzip member per record, whose gzip header carries the member's
compressed and plain length (extra field ``sl``). The commit writes ``_manifest.json``: the committed
files with offsets of record starts about every ``splitBytes``. Files of failed or repeated task
attempts are not in it and are never read.

Reading: the driver plans partitions from the manifest, cutting files at those offsets, or one
partition per ``*.warc``/``*.warc.gz`` file where there is no manifest. Filters on the header columns are
pushed into the reader. A record's headers are parsed first; a record that fails a filter, or any
record under ``option("payload", "false")``, is skipped by a seek (by inflating without keeping, where a
foreign member doesn't tell its length) and its payload is not decoded.

Defined cases: a null payload is an empty one. A null url has no WARC-Target-URI. Null ids have no
WARC-Record-ID of a page and come back as null. Extra columns of pages are ignored by the writer.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .common import new_dir, written

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, content_type string, payload binary"
ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("content_type", pa.string()), ("payload", pa.binary())])
HEADER_COLUMNS = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "content_type")
_DATE = "1970-01-01T00:00:00Z"  # records carry no fetch time, and archives must not differ between attempts
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str):
    """(file system, path in it) of a local path or a URI, also as Spark writes them."""
    path = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path))
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """A header value: line ends would end the header."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict) -> bytes:
    """One record, plain. Responses hold an HTTP response around the payload, revisits none. payload_digest is base32 or 40 hex digits; the record has base32."""
    payload = row.get("payload") or b""
    kind = row["record_type"]
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {_DATE}"]
    for name, key in (("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to")):
        if row.get(key) is not None:
            lines.append(f"{name}: <{_clean(row[key])}>")
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    found = row.get("payload_digest") or digest(payload)
    if len(found) == 40:
        found = base64.b32encode(bytes.fromhex(found)).decode()
    lines.append(f"WARC-Payload-Digest: sha1:{found}")
    lines.append(f"WARC-Payload-Length: {len(payload) if row.get('payload_bytes') is None else row['payload_bytes']}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {_REVISIT}")
        block = b""
    else:
        kind_of = _clean(row.get("content_type") or "text/html; charset=utf-8")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind_of}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(plain: bytes, level: int = 6) -> bytes:
    """A gzip member that tells its own lengths."""
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    raw = body.compress(plain) + body.flush()
    size = 24 + len(raw) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(plain) & 0xFFFFFFFF)
    return head + raw + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _row(h: dict[str, str]) -> dict:
    bare = lambda k: h[k].strip("<>") if k in h else None
    found = h.get("warc-payload-digest", "")
    return {
        "record_type": h.get("warc-type"), "record_id": bare("warc-record-id"), "target_uri": h.get("warc-target-uri"), "refers_to": bare("warc-refers-to"), "content_type": h.get("content-type"),
        "payload_digest": found.partition(":")[2] or None, "payload_bytes": int(h["warc-payload-length"]) if "warc-payload-length" in h else None, "payload": None,
    }


class Truncated(ValueError):
    """An archive that ends inside a record."""


class _Plain:
    """Records of a plain archive."""

    def __init__(self, f):
        self.f, self.end = f, f.size()

    def head(self) -> bytes | None:
        got = b""
        while (at := got.find(b"\r\n\r\n")) < 0:
            more = self.f.read(4096)
            if not more:
                if got:
                    raise Truncated("the archive ends inside a header")
                return None
            got = (got + more).lstrip(b"\r\n") if not got else got + more
        self.rest = got[at + 4 :]
        return got[:at]

    def body(self, n: int, keep: bool) -> bytes:
        if len(self.rest) >= n:
            out, back = self.rest[:n], len(self.rest) - n
            self.f.seek(self.f.tell() - back)
            return out
        to = self.f.tell() + n - len(self.rest)
        if to > self.end:
            raise Truncated("the archive ends inside a record")
        if keep:
            return self.rest + self.f.read(n - len(self.rest))
        self.f.seek(to)
        return b""

    def close(self) -> None:
        """Past the blank lines after a record, so that the next one's place is known."""
        at = self.f.tell()
        if self.f.read(4) != b"\r\n\r\n":
            self.f.seek(at)


class _Gzip:
    """Records of an archive with a gzip member for each."""

    def __init__(self, f):
        self.f, self.end = f, f.size()

    def head(self) -> bytes | None:
        self.at = self.f.tell()
        first = self.f.read(4096)
        if not first:
            return None
        if len(first) < 18:
            raise Truncated(f"the archive ends inside the member at {self.at}")
        if first[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {self.at}")
        self.size = struct.unpack("<I", first[16:20])[0] if first[3] & 4 and first[12:14] == b"sl" else None
        if self.size and self.at + self.size > self.end:
            raise Truncated(f"the archive ends inside the member at {self.at}")
        self.z = zlib.decompressobj(31)
        self.plain = self.z.decompress(first)
        while (to := self.plain.find(b"\r\n\r\n")) < 0:
            if self.z.eof or not (more := self.f.read(4096)):
                raise Truncated(f"the header of the member at {self.at} has no end")
            self.plain += self.z.decompress(more)
        self.rest = self.plain[to + 4 :]
        return self.plain[:to]

    def body(self, n: int, keep: bool) -> bytes:
        if not keep and self.size:
            return b""
        parts, have = [self.rest], len(self.rest)
        while have < n and not self.z.eof and (more := self.f.read(1 << 16)):
            got = self.z.decompress(more)
            have += len(got)
            if keep:
                parts.append(got)
        if have < n:
            raise Truncated(f"the record of the member at {self.at} is shorter than its length")
        return b"".join(parts)[:n] if keep else b""

    def close(self) -> None:
        if self.size:
            self.f.seek(self.at + self.size)
            return
        while not self.z.eof and (more := self.f.read(1 << 16)):
            self.z.decompress(more)
        if not self.z.eof:
            raise Truncated(f"the archive ends inside the member at {self.at}")
        self.f.seek(self.f.tell() - len(self.z.unused_data))


def _test(f):
    """A pushed filter as a function of a header row, or None where the source can't apply it."""
    if isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, StringEndsWith, StringContains, IsNull, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
        name = f.attribute[0]
        if isinstance(f, IsNull):
            return lambda r: r[name] is None
        if isinstance(f, IsNotNull):
            return lambda r: r[name] is not None
        value = f.value
        if isinstance(f, In):
            held = set(value)
            return lambda r: r[name] is not None and r[name] in held
        if isinstance(f, EqualNullSafe):
            return lambda r: r[name] == value
        test = {EqualTo: str.__eq__, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}[type(f)]
        return lambda r: r[name] is not None and test(r[name], value)
    return None


class _Split(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload, self.batch = options["path"], str(options.get("payload", "true")).lower() != "false", int(options.get("batchBytes", 4 << 20))
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self):
        at, base = _open(self.path)
        info = at.get_file_info(base)
        if info.type == pafs.FileType.File:
            return [_Split(self.path, 0, None)]
        if at.get_file_info(f"{base}/_manifest.json").type == pafs.FileType.File:
            with at.open_input_stream(f"{base}/_manifest.json") as f:
                held = json.loads(f.read())
            out = []
            for x in held["files"]:
                cuts = [*x["splits"], x["bytes"]]
                out += [_Split(f"{self.path}/{x['file']}", a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
            return out
        files = sorted(x.base_name for x in at.get_file_info(pafs.FileSelector(base)) if x.base_name.endswith((".warc", ".warc.gz")))
        return [_Split(f"{self.path}/{x}", 0, None) for x in files]

    def read(self, split):
        if split is None:
            return
        tests = [_test(f) for f in self.filters]
        at, base = _open(split.path)
        rows, held = [], 0
        with at.open_input_file(base) as f:
            f.seek(split.start)
            records = _Gzip(f) if f.read(2) == b"\x1f\x8b" else _Plain(f)
            f.seek(split.start)
            while split.end is None or f.tell() < split.end:
                head = records.head()
                if head is None:
                    break
                h = parse_headers(head)
                row, n = _row(h), int(h.get("content-length", "0"))
                wanted = all(t(row) for t in tests)
                block = records.body(n, wanted and self.payload)
                records.close()
                if not wanted:
                    continue
                if self.payload:
                    if h.get("content-type", "").startswith("application/http"):
                        http, _, body = block.partition(b"\r\n\r\n")
                        row["payload"] = body if block else None
                        row["content_type"] = parse_headers(http).get("content-type")
                    else:
                        row["payload"] = block
                    if self.verify and row["record_type"] == "response":
                        row["payload_bytes"], row["payload_digest"] = len(row["payload"] or b""), digest(row["payload"] or b"")
                rows.append(row)
                held += len(block) + 500
                if held >= self.batch:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class _Done(WriterCommitMessage):
    def __init__(self, file: str | None, size: int, splits: list[int]):
        self.file, self.size, self.splits = file, size, splits


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.gzip, self.split = options["path"], str(options.get("compression", "gzip")) == "gzip", int(options.get("splitBytes", 32 << 20))

    def write(self, batches):
        at, base = _open(self.path)
        at.create_dir(base, recursive=True)
        name, out, size, splits = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip, None, 0, [0]
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        out = at.open_output_stream(f"{base}/{name}", compression=None)
                    if size - splits[-1] >= self.split:
                        splits.append(size)
                    plain = record_bytes(row)
                    size += out.write(member(plain) if self.gzip else plain)
        finally:
            if out is not None:
                out.close()
        return _Done(name if out is not None else None, size, splits)

    def commit(self, messages):
        at, base = _open(self.path)
        at.create_dir(base, recursive=True)
        held = {"files": [{"file": m.file, "bytes": m.size, "splits": m.splits} for m in messages if m is not None and m.file]}
        with at.open_output_stream(f"{base}/_manifest.json") as f:
            f.write(json.dumps(held).encode())

    def abort(self, messages):
        at, base = _open(self.path)
        for m in messages:
            if m is not None and m.file:
                at.delete_file(f"{base}/{m.file}")


class WarcDataSource(DataSource):
    """Options: path; payload (read payloads, default true); verify (length and digest of responses from the payload read, default false); compression (gzip or none); splitBytes; batchBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def write_warc(records: DataFrame, path: str, **options) -> None:
    """records: columns of SCHEMA; missing ones are null."""
    records.sparkSession.dataSource.register(WarcDataSource)
    have = set(records.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(str(t)).alias(f.name) for f, t in zip(ARROW, ("string", "string", "string", "string", "string", "bigint", "string", "binary"))]
    records.select(*cols).write.format("warc").options(**options).mode("append").save(path)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload binary, payload_sha1 binary, keeper): keeper is the largest page_id among equal payloads of at least min_bytes, if the payload repeats and the page isn't that one.

    Pages are counted by digest with map-side sums, so a payload that a third of all pages share is one row before the shuffle;
    the join back is a plain equi-join of two shuffled sides, whose hot partitions AQE splits. Repeated page_ids: all rows with the largest are responses.
    A null page_id revisits the largest id of its group, and is a response where all ids are null.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("payload_sha1", F.unhex(F.sha1("payload")))
    groups = own.where(F.octet_length("payload") >= min_bytes).groupBy("payload_sha1").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where((F.col("n") > 1) & F.col("keeper").isNotNull()).select("payload_sha1", "keeper"), "warc-groups")
    back = own.join(groups, "payload_sha1", "left")
    return back.withColumn("keeper", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper")), F.col("keeper")))


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0, **options) -> None:
    """Write a response or revisit record for each page."""
    r = revisits(pages, min_bytes)
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    revisit = F.col("keeper").isNotNull()
    write_warc(
        r.select(
            F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), urn(F.col("keeper")).alias("refers_to"),
            F.hex("payload_sha1").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(~revisit, F.col("payload")).alias("payload"),
        ),
        path, **options,
    )


def pages_of(records: DataFrame) -> DataFrame:
    """What the archives hold of each page, one row per response or revisit."""
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")
    return records.where(F.col("record_type").isin("response", "revisit")).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))


def warc_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of pages, read again. A response's length and digest come from the payload that was read, a revisit's from its headers."""
    path = new_dir(spark, "warc")
    archive_pages(pages, path, min_bytes)
    return pages_of(read_warc(spark, path, verify="true"))


def scan_bytes(data: bytes) -> list[dict]:
    """All rows of one archive held in memory (small files and tests)."""
    f = pa.PythonFile(io.BytesIO(data), "r")
    records, out = (_Gzip(f) if data[:2] == b"\x1f\x8b" else _Plain(f)), []
    while (head := records.head()) is not None:
        h = parse_headers(head)
        row = _row(h)
        row["payload"] = records.body(int(h.get("content-length", "0")), True)
        records.close()
        out.append(row)
    return out

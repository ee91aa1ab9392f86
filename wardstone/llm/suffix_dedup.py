"""Removal of repeated byte strings: shard transforms merged by interleave refinement.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id. Texts are read as UTF-8.

Equal strings must meet without sorting every suffix of the corpus in one place. The least hash of the 16-byte pieces inside a window of ``length`` bytes is the same
wherever the window stands; runs of windows with the same least hash are its *stretches*, about one per 18 bytes.

0. Of equal texts only the one with the least doc_id takes part as a source; the others are removed as wholes, if they are long enough.
1. Each partition's (hash, document) pairs go to the hash's bucket, which finds the hashes that more than one document has. A hash that two documents of one partition have
   is known to be shared there: its pairs skip the test and one pair stands for all of them.
2. Documents get their shared hashes, and send the stretches of those, whole, to the hash's bucket.
3. A bucket keeps each distinct stretch with the least doc_id that has it. A hash with one distinct stretch is done. The others' stretches form shards, one per sender or per run of small senders: each
   is transformed by itself (but for stretches that share neither the 17 bytes before their least hash's piece nor the 17 after it with another, which no window can join), then the transforms are merged to depth ``length``, whose blocks are the equal windows and give the least doc_id of each.
4. Documents get their repeated windows, mark the covered bytes and keep the rest.

Documents are dealt to groups by a hash; messages to a group's documents travel together.

Texts travel twice, compressed one by one. Every step is spread over buckets or documents by hash.

Defined cases: a null text is empty. Null doc_ids count as larger than all others and equal to one another; documents with equal doc_ids don't remove each other's bytes. Repeated
rows get equal results. Extra columns are ignored; an empty table gives an empty result. A removed run may start or end inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import window_owners
from .common import give_back, partitions, released, slices, small_batches, written
from .kernel import buffers, mix
from .ngram_join import _grouped

_PIECE = 16
_LAST = (1 << 63) - 1  # stands for a null doc_id
_LOW = np.uint64((1 << 40) - 1)  # the part of a hash that travels with its bucket


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position on."""
    n = len(data) - _PIECE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.empty(n + 8, np.uint64)
    for o in range(8):
        own = eight[o::8]
        own[:] = np.frombuffer(padded, "<u8", len(own), o)
    with np.errstate(over="ignore"):
        h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def stretches(data: np.ndarray, offsets: np.ndarray, length: int):
    """(row, first window, windows, least hash) of every run of windows of a row that share their least hash; positions within data."""
    h = piece_hashes(data)
    wide = length - _PIECE + 1
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    low, have = h, 1
    while have * 2 <= wide:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[:n], low[wide - have : wide - have + n])
    ends = offsets[1:]
    sizes = np.diff(offsets)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = low[1:] != low[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    first = np.flatnonzero(new)
    row = np.searchsorted(offsets, first, "right") - 1
    stop = np.append(first[1:], n)
    stop = np.minimum(stop, ends[row] - length + 1)  # windows that leave the row don't count
    ok = (stop > first) & (sizes[row] >= length)
    first, stop, row = first[ok], stop[ok], row[ok]
    return row, first, stop - first, low[first]


def _tag(text: bytes) -> int:
    """Tells texts of the same doc_id apart."""
    return int.from_bytes(hashlib.md5(text, usedforsecurity=False).digest()[:4], "little")


def _short(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_short(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _prepared(docs: DataFrame) -> DataFrame:
    """ref (what a document's messages go by: its doc_id, or a hash of its text where that is null), doc_id, text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("ref"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), text.alias("text"))


def _group(refs: np.ndarray, groups: int) -> np.ndarray:
    return (mix(refs.astype(np.uint64), 83) % np.uint64(groups)).astype(np.int32)


_ROW = "group int, kind byte, ref long, doc_id long, blob binary"
_MESSAGE, _COPY, _TEXT = 0, 1, 2  # kinds of rows, in the order in which a group's are read


def _rows(group, kind: int, ref, doc_id, blob) -> pa.RecordBatch:
    n = len(blob)
    return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(np.full(n, kind, np.int8)), pa.nulls(n, pa.int64()) if ref is None else ref, pa.nulls(n, pa.int64()) if doc_id is None else doc_id, pa.array(blob, pa.binary())], ["group", "kind", "ref", "doc_id", "blob"])


def _packed(docs: DataFrame, groups: int) -> DataFrame:
    """A row for every document: blob is its text, compressed, with the length."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                texts = [t.encode() for t in b.column("text").to_pylist()]
                blobs = [len(t).to_bytes(8, "little") + (pa.compress(t, "zstd", asbytes=True) if t else b"") for t in texts]
                yield _rows(_group(b.column("ref").to_numpy(), groups), _TEXT, b.column("ref"), b.column("doc_id"), blobs)

    return _prepared(docs).mapInArrow(released(run), _ROW)


def copies(docs: DataFrame, length: int, groups: int) -> DataFrame:
    """A row for documents whose text a smaller doc_id has too: blob is the text's MD5."""

    def run(batches):
        for b in batches:
            yield _rows(_group(b.column("ref").to_numpy(), groups), _COPY, b.column("ref"), b.column("doc_id"), b.column("blob"))

    t = _prepared(docs).where(F.octet_length("text") >= length).select("ref", "doc_id", F.unhex(F.md5("text")).alias("blob"))
    several = written(t.groupBy("blob").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("blob", "least"), "equal-texts")
    later = t.join(several.hint("shuffle_merge"), "blob").where("doc_id > least")
    return written(later.select("ref", "doc_id", "blob").distinct().mapInArrow(released(run), _ROW), "copies")


def _messages(group_of: np.ndarray, columns: list[np.ndarray]):
    """Rows of packed columns of int64, one per group."""
    order = np.argsort(group_of, kind="stable")
    cut = np.append(np.flatnonzero(np.diff(group_of[order], prepend=-1)), len(order))
    at, blobs = [], []
    for a, z in zip(cut[:-1], cut[1:]):
        o = order[a:z]
        body = b"".join([len(o).to_bytes(8, "little"), *[np.ascontiguousarray(c[o].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]])  # byte planes: the high ones are alike
        blobs.append(len(body).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(body, asbytes=True))
        at.append(int(group_of[o[0]]))
    for i in range(0, len(at), 128):
        yield _rows(at[i : i + 128], _MESSAGE, None, None, blobs[i : i + 128])


def _joined(parts, most: int = 2_000_000):
    """Tuples of columns put together to large ones: fewer, larger messages."""
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p[0])
        if size >= most:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _columns(blobs: list[bytes], n: int) -> list[np.ndarray]:
    """What _messages packed, of several rows together."""
    parts = []
    for blob in blobs:
        body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
        rows = int.from_bytes(body[:8], "little")
        parts.append([np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * rows, 8 + 8 * rows * i).reshape(8, rows).T).reshape(-1).view("<i8") for i in range(n)])
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64) for _ in range(n)]


def _read_groups(rows: DataFrame, n: int, serve, schema: str, gather=None) -> DataFrame:
    """Rows dealt by group, each group's messages before its texts. serve(messages, copies, texts) gets the message blobs, the set of (ref, MD5) and a batch of texts, which are never all held; gather makes batches of a whole partition's results."""

    def run(batches):
        group, blobs, copied, seen = None, [], set(), None
        for batch in batches:
            where, kind = batch.column("group").to_numpy(), batch.column("kind").to_numpy()
            cut = np.append(np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (kind[1:] != kind[:-1]))), len(where)) if len(where) else []
            for a, z in zip(cut[:-1], cut[1:]):
                if where[a] != group:
                    group, blobs, copied, seen = where[a], [], set(), None
                part = batch.slice(a, z - a)
                if kind[a] == _MESSAGE:
                    blobs += part.column("blob").to_pylist()
                elif kind[a] == _COPY:
                    copied |= set(zip(part.column("ref").to_pylist(), part.column("blob").to_pylist()))
                else:
                    seen = seen or serve(blobs, copied)
                    yield from seen(part)
        give_back()

    return rows.repartitionById(n, "group").sortWithinPartitions("group", "kind", "ref").mapInArrow(run if gather is None else lambda batches: gather(run(batches)), schema)


def _unpacked(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], n, "zstd", asbytes=True) if n else b""


def hash_pairs(docs: DataFrame, length: int, buckets: int, most: int = 1_500_000) -> DataFrame:
    """bucket, known, keys, refs, counts: packed (hash, document) pairs. known 0: to be tested; 1: shared, to be passed on; 2: stands for a shared hash."""

    def packed(keys, refs):
        order = np.argsort(keys, kind="stable")  # a document's pairs lie together, so equal pairs come to lie side by side
        k, r = keys[order], refs[order]
        fresh = np.append(True, k[1:] != k[:-1])
        twice = np.append(False, ~fresh[1:] & (r[1:] == r[:-1]))
        start = np.flatnonzero(fresh)
        several = np.minimum.reduceat(r, start) != np.maximum.reduceat(r, start)
        kind = np.empty(len(keys), np.int8)
        kind[order] = np.where(twice, 3, np.repeat(several, np.diff(np.append(start, len(k)))))
        place = lambda x: (mix(x.astype(np.uint64), 53) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        own, known, stand = keys[kind == 0], keys[kind == 1], k[start[several]]
        for tag, x, y, at in ((0, own, refs[kind == 0], place(own & _LOW)), (1, known, refs[kind == 1], place(refs[kind == 1])), (2, stand, r[start[several]], place(stand & _LOW))):
            if not len(x):
                continue
            order = np.argsort(at, kind="stable")
            x, y, at = x[order], y[order], at[order].astype(np.int64)
            cut = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
            rows = []
            for i, z in zip(cut[:-1], cut[1:]):
                run = np.flatnonzero(np.append(True, y[i + 1 : z] != y[i : z - 1]))
                rows.append((int(at[i]), tag, _short(x[i:z]), y[i:z][run].tobytes(), np.diff(np.append(run, z - i)).astype(np.uint32).tobytes()))
            for i in range(0, len(rows), 256):
                part = list(zip(*rows[i : i + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int8()), *[pa.array(c, pa.binary()) for c in part[2:]]], ["bucket", "known", "keys", "refs", "counts"])

    def run(batches):
        keys, refs, held = [], [], 0
        for batch in batches:
            for b in slices(batch, "text"):
                data, offsets = buffers(b.column("text"))
                row, _, _, low = stretches(data, offsets, length)
                keys.append(low)
                refs.append(b.column("ref").to_numpy()[row])
                held += len(low)
                if held >= most:
                    yield from packed(np.concatenate(keys), np.concatenate(refs))
                    keys, refs, held = [], [], 0
        if held:
            yield from packed(np.concatenate(keys), np.concatenate(refs))

    return _prepared(docs).mapInArrow(released(run), "bucket int, known byte, keys binary, refs binary, counts binary")


def shared_hashes(pairs: DataFrame, n: int, groups: int) -> DataFrame:
    """Messages: (ref, shared hash) of documents that have some."""

    def run(batches):
        for t in _grouped(batches, "bucket"):
            where = t.column("bucket").to_numpy()
            known = t.column("known").to_numpy()
            keys = [_from_short(x) for x in t.column("keys").to_pylist()]
            refs = [np.repeat(np.frombuffer(r, np.int64), np.frombuffer(c, np.uint32)) for r, c in zip(t.column("refs").to_pylist(), t.column("counts").to_pylist())]
            cut = np.append(np.flatnonzero(np.diff(where, prepend=-1)), len(where))
            for a, z in zip(cut[:-1], cut[1:]):
                kind = np.repeat(known[a:z], [len(k) for k in keys[a:z]])
                k, r = np.concatenate(keys[a:z]), np.concatenate(refs[a:z])
                tested = kind != 1
                order = np.argsort(k[tested], kind="stable")
                tk, tr, tt = k[tested][order], r[tested][order], kind[tested][order]
                if len(tk):
                    start = np.flatnonzero(np.append(True, tk[1:] != tk[:-1]))
                    size = np.diff(np.append(start, len(tk)))
                    several = (np.maximum.reduceat(tt, start) == 2) | (np.maximum.reduceat(tr, start) != np.minimum.reduceat(tr, start))
                    ok = np.repeat(several, size) & (tt == 0)
                    tk, tr = tk[ok], tr[ok]
                k, r = np.concatenate([tk, k[~tested]]), np.concatenate([tr, r[~tested]])
                if not len(k):
                    continue
                yield r, k.view(np.int64)

    def messages(batches):
        for r, k in _joined(run(batches)):
            yield from _messages(_group(r, groups), [r, k])

    return pairs.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(released(messages), _ROW)


def sent_stretches(rows: DataFrame, length: int, buckets: int, n: int, most: int = 24 << 20) -> DataFrame:
    """bucket, blob: the stretches of shared hashes, packed by bucket. rows: texts and their shared hashes."""

    def packed(held):
        key, ids, ref, tag, start, size, strings = (np.concatenate(x) for x in zip(*[h[:6] + (np.array(h[6], object),) for h in held]))
        at = (mix(key & _LOW, 59) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((ref, at))
        cut = np.append(np.flatnonzero(np.diff(at[order], prepend=-1)), len(at))
        codec, rows, total = pa.Codec("zstd", 6), [], 0
        for a, z in zip(cut[:-1], cut[1:]):
            o = order[a:z]
            body = b"".join([len(o).to_bytes(8, "little"), *[x[o].astype(np.int64).tobytes() for x in (ids, ref, tag, start, size)], *strings[o]])
            rows.append((int(at[o[0]]), len(body).to_bytes(8, "little") + codec.compress(body, asbytes=True)))
            total += len(rows[-1][1])
            if total >= 1 << 20 or z == cut[-1]:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])
                rows, total = [], 0

    def serve(blobs, copied):
        refs, keys = _columns(blobs, 2)
        mark = lambda k, r: mix((k & _LOW) ^ mix(r.astype(np.uint64), 61), 67)
        asked = np.unique(mark(keys.view(np.uint64), refs))

        def texts(b):
            known = np.isin(b.column("ref").to_numpy(), refs)
            for i in range(0, b.num_rows, 256):
                part, some = b.slice(i, 256), known[i : i + 256]
                held = sorted({(r, i, _unpacked(x)) for r, i, x, ok in zip(part.column("ref").to_pylist(), part.column("doc_id").to_pylist(), part.column("blob").to_pylist(), some) if ok})
                if copied:
                    held = [h for h in held if (h[0], hashlib.md5(h[2], usedforsecurity=False).digest()) not in copied]
                if not held:
                    continue
                ref, ids = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
                raw, offsets = b"".join([h[2] for h in held]), np.cumsum([0, *[len(h[2]) for h in held]])
                row, first, windows, low = stretches(np.frombuffer(raw, np.uint8), offsets, length)
                m = mark(low, ref[row])
                at = np.searchsorted(asked, m)
                at[at == len(asked)] = 0
                ok = asked[at] == m
                row, first, windows, low = row[ok], first[ok], windows[ok], low[ok]
                if len(row):
                    strings = [raw[s : s + w - 1 + length] for s, w in zip(first.tolist(), windows.tolist())]
                    tags = np.array([_tag(h[2]) for h in held], np.int64)
                    yield low, ids[row], ref[row], tags[row], first - offsets[row], windows, strings

        return texts if len(refs) else (lambda b: iter(()))

    def run(parts):
        held, total = [], 0
        for p in parts:
            held.append(p)
            total += sum(map(len, p[6])) + 120 * len(p[6])
            if total >= most:
                yield from packed(held)
                held, total = [], 0
        if held:
            yield from packed(held)

    return _read_groups(rows, n, serve, "bucket int, blob binary", run)


def _senders(blobs: list[bytes], length: int):
    """Each sender's (doc_id, ref, tag, start, windows, least hashes, bytes, ends of its stretches there)."""
    for blob in blobs:
        body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
        n = int.from_bytes(body[:8], "little")
        cols = np.frombuffer(body, np.int64, 5 * n, 8).reshape(5, n)
        base = 8 + 40 * n
        sizes = cols[4] - 1 + length
        ends = np.cumsum(sizes)
        h = piece_hashes(np.frombuffer(body, np.uint8, -1, base))
        both = np.stack([ends - sizes, ends - _PIECE + 1], axis=1).ravel()
        key = np.minimum.reduceat(np.append(h, ~np.uint64(0)), both)[::2] if n else np.zeros(0, np.uint64)
        yield (*cols, key, body, base + ends)


def _joinable(keys: np.ndarray, strings: list[bytes], length: int) -> np.ndarray:
    """Whether each of distinct stretches may share a window with another of its least hash: the bytes before the hash's piece, or those after it, are the same for half the length that a window has besides the piece. A stretch that has the piece twice may."""
    sizes = np.array([len(s) for s in strings])
    start = np.cumsum(sizes) - sizes
    h = np.append(piece_hashes(np.frombuffer(b"".join(strings), np.uint8)), np.zeros(64, np.uint64))
    string = np.repeat(np.arange(len(strings)), sizes)
    inside = np.arange(len(string)) - start[string] <= sizes[string] - _PIECE
    at = np.flatnonzero(inside & (h[: len(string)] == keys[string]))
    own = string[at]
    ok = np.zeros(len(strings), bool)
    ok[own[1:][own[1:] == own[:-1]]] = True
    offset = at - start[own]  # of every occurrence: another stretch may share a window with any of them
    side = (length - _PIECE) // 2
    for step, has in ((-side, offset >= side), (side, offset + side + _PIECE <= sizes[own])):
        i = np.flatnonzero(has)
        far = at[i] + step
        k = mix(h[far] ^ mix(h[far - (1 if step > 0 else -1)], 71) ^ mix(keys[own[i]], 73), 79)
        _, back, count = np.unique(k, return_inverse=True, return_counts=True)
        ok[own[i[count[back] > 1]]] = True
    return ok


class _Numbers(dict):
    """The number of each distinct string, in the order in which they were first asked for."""

    def __missing__(self, s: bytes) -> int:
        self[s] = n = len(self)
        return n


def repeated_in(blobs: list[bytes], length: int, most: int):
    """(ref, doc_id, tag, first window, number) of the repeated windows of one bucket's stretches, in parts of about 4 * most bytes. Merges take about most bytes at a time.

    Equal windows have equal least hashes, so hashes can be dealt to parts, and in a part to separate merges; only a part's stretches are held as objects.
    """
    senders = list(_senders(blobs, length))
    bodies, sender = [s[6] for s in senders], np.repeat(np.arange(len(senders), dtype=np.int32), [len(s[0]) for s in senders])
    ids, refs, tags, start, windows, key, ends = (np.concatenate([s[i] for s in senders]) for i in (0, 1, 2, 3, 4, 5, 7))
    del senders
    parts = max(1, -(-int(windows.sum() + (length - 1) * len(windows)) // (4 * most)))
    part_of = ((key >> np.uint64(8)) % np.uint64(parts)).astype(np.int32)
    for part in range(parts):
        at = np.flatnonzero(part_of == part)
        stop = ends[at]
        strings = [bodies[b][a:z] for b, a, z in zip(sender[at].tolist(), (stop - windows[at] + 1 - length).tolist(), stop.tolist())]
        if strings:
            yield from _repeated(ids[at], refs[at], tags[at], start[at], windows[at], key[at], sender[at], strings, length, most)
        give_back()


def _shards(chosen: np.ndarray, sizes: np.ndarray, sender: np.ndarray, least: int) -> list[np.ndarray]:
    """chosen (numbers of strings, by their sender) as shards, one per sender; small ones that follow each other are one shard."""
    new = np.flatnonzero(np.append(True, sender[1:] != sender[:-1]))
    total = np.add.reduceat(sizes, new)
    shard = (np.cumsum(total) - total) // least
    return np.split(chosen, new[1:][shard[1:] != shard[:-1]])


def _repeated(ids, refs, tags, start, windows, key, sender, strings: list[bytes], length: int, most: int):
    numbers = _Numbers()
    number = np.fromiter(map(numbers.__getitem__, strings), np.int64, len(strings))
    distinct = list(numbers)
    del numbers
    n = len(distinct)
    first = np.full(n, len(strings))
    np.minimum.at(first, number, np.arange(len(strings)))
    owner = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(owner, number, ids)
    keys, wide = key[first], windows[first]
    sizes = wide - 1 + length
    low, high = owner.copy(), owner.copy()  # the least and the largest of the owners of a string's windows
    _, kind, count = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[kind] > 1)
    if len(several):
        several = several[_joinable(keys[several], [distinct[i] for i in several.tolist()], length)]
    merged, base = [np.zeros(0, np.int64)], np.full(n, -1)  # the windows' owners of strings that were merged, and where each string's begin
    held, parts = 0, max(1, -(-int(sizes[several].sum()) // most))
    part_of = (keys[several] >> np.uint64(20)) % np.uint64(parts)
    for part in range(parts):
        chosen = several[part_of == part]
        if not len(chosen):
            continue
        shards = _shards(chosen, sizes[chosen], sender[first[chosen]], max(1, most // 16))
        by, at = window_owners([[distinct[i] for i in shard.tolist()] for shard in shards], [owner[shard] for shard in shards], length)
        base[chosen] = at + held
        edges = np.stack([at, at + wide[chosen]], axis=1).ravel()  # what lies between a string's windows and the next string is skipped
        low[chosen], high[chosen] = np.minimum.reduceat(by, edges)[::2], np.maximum.reduceat(by, edges)[::2]
        merged.append(by)
        held += len(by)
    by = np.concatenate(merged)
    own = ids
    whole = np.flatnonzero(high[number] < own)
    if len(whole):
        yield refs[whole], own[whole], tags[whole], start[whole], windows[whole]
    some = np.flatnonzero((low[number] < own) & (high[number] >= own))
    ends = np.cumsum(windows[some])
    cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]), most)[1:], "left") + 1 if len(some) else []
    for o in np.split(some, np.unique(cuts)) if len(some) else []:
        if not len(o):
            continue
        w = windows[o]
        row = np.repeat(np.arange(len(o)), w)
        place = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w)
        gone = by[base[number[o]][row] + place] < own[o][row]
        edge = np.append(True, row[1:] != row[:-1])
        begin = np.flatnonzero(gone & (edge | ~np.append(False, gone[:-1])))
        end = np.flatnonzero(gone & np.append(edge[1:] | ~gone[1:], True))
        x = o[row[begin]]
        yield refs[x], own[x], tags[x], start[x] + place[begin], end - begin + 1


def repeated_windows(sent: DataFrame, length: int, n: int, groups: int, most: int = 1 << 20) -> DataFrame:
    """Messages: (ref, doc_id, tag, first window, number) of windows that a smaller doc_id has too. Merges take about most bytes at a time."""

    def run(batches):
        for t in _grouped(batches, "bucket"):
            where, blobs = t.column("bucket").to_numpy(), t.column("blob").to_pylist()
            cut = np.append(np.flatnonzero(np.diff(where, prepend=-1)), len(where))
            for a, z in zip(cut[:-1], cut[1:]):
                yield from repeated_in(blobs[a:z], length, most)

    def messages(batches):
        for columns in _joined(run(batches)):
            yield from _messages(_group(columns[0], groups), list(columns))

    return sent.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(released(messages), _ROW)


def kept_text(text: bytes, runs: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """(the bytes kept, number removed, maximal removed runs) for runs of windows (first, number)."""
    if not len(runs):
        return text, 0, 0
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    a, z = runs[:, 0], np.maximum.accumulate(runs[:, 0] + runs[:, 1] - 1 + length)
    apart = np.append(True, a[1:] > z[:-1])
    start, stop = a[apart], z[np.append(np.flatnonzero(apart)[1:] - 1, len(z) - 1)]
    parts, at = [], 0
    for x, y in zip(start.tolist(), stop.tolist()):
        parts.append(text[at:x])
        at = y
    return b"".join([*parts, text[at:]]), int((stop - start).sum()), len(start)


def deduplicated(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary): one row per document."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    buckets = n
    groups = n
    texts, equal = _packed(docs, groups), copies(docs, length, groups)
    shared = shared_hashes(hash_pairs(docs, length, buckets), n, groups)
    again = repeated_windows(sent_stretches(texts.union(shared).union(equal), length, buckets, n), length, n, groups)

    def serve(blobs, copied):
        ref, doc, tag, first, windows = _columns(blobs, 5)
        order = np.argsort(ref, kind="stable")
        ref, doc, tag, runs = ref[order], doc[order], tag[order], np.stack([first[order], windows[order]], axis=1)

        def result(b):
            rows, last = [], (None, None, None)
            own = b.column("ref").to_numpy()
            for r, a, z, i, blob in zip(own.tolist(), np.searchsorted(ref, own), np.searchsorted(ref, own, "right"), b.column("doc_id").to_pylist(), b.column("blob").to_pylist()):
                if (i, blob) != last[:2]:  # repeated rows lie together
                    text = _unpacked(blob)
                    if copied and (r, hashlib.md5(text, usedforsecurity=False).digest()) in copied:
                        kept, gone, spans = b"", len(text), 1
                    else:
                        mine = (doc[a:z] == i) & (tag[a:z] == _tag(text)) if z > a else np.zeros(0, bool)
                        kept, gone, spans = kept_text(text, runs[a:z][mine], length)
                    last = (i, blob, (None if i == _LAST else i, len(text), gone, spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
                rows.append(last[2])
            cols = list(zip(*rows))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string(), pa.binary()])], names)

        return result

    return _read_groups(texts.union(again).union(equal), n, serve, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)

"""Vectorised words, shingles and hashes over Arrow string arrays.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters. Hashes are 64-bit
and depend only on the word's bytes, so they agree between tasks and runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 19
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; seed picks one of many independent-looking functions."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(n, _R, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)


_POW = _powers(1 << 12)


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, nulls as empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1] if off is not None and len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch in order: doc (row number), start and end (byte offsets into data), h (hash)."""

    __slots__ = ("data", "offsets", "doc", "start", "end", "h", "mask")

    def __init__(self, data, offsets, doc, start, end, h):
        self.data, self.offsets, self.doc, self.start, self.end, self.h = data, offsets, doc, start, end, h

    def bounds(self) -> np.ndarray:
        """Index of the first word of each row, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)))


def words(arr: pa.Array, full_lower: bool = True) -> Words:
    """Words of all rows; full_lower=False lowers ASCII only, which keeps byte offsets those of the text."""
    global _POW
    if full_lower:
        arr = pc.utf8_lower(arr)
    data, offsets = buffers(arr)
    n = len(data)
    starts, ends, hashes = [], [], []
    cuts = offsets[1:-1]
    at = 0
    while at < n:
        to = min(n, at + _CHUNK)
        while to < n and _WORD[data[to - 1]] and _WORD[data[to]]:
            tail = np.flatnonzero(~_WORD[data[at:to]])
            if len(tail) and at + tail[-1] + 1 > at:
                to = at + int(tail[-1]) + 1
                break
            to = min(n, to + _CHUNK)
        part = data[at:to]
        mask = _WORD[part]
        edge = np.empty(len(part), bool)
        edge[0] = True
        edge[1:] = ~mask[:-1]
        inside = cuts[(cuts >= at) & (cuts < to)] - at
        edge[inside] = True
        s = np.flatnonzero(mask & edge)
        if len(s):
            last = np.empty(len(part), bool)
            last[-1] = True
            last[:-1] = ~mask[1:]
            last[inside[inside > 0] - 1] = True
            e = np.flatnonzero(mask & last) + 1
            size = e - s
            if size.max() >= len(_POW):
                _POW = _powers(1 << int(size.max()).bit_length())
            kept = np.flatnonzero(mask)
            first = np.cumsum(size) - size
            rel = np.arange(len(kept)) - np.repeat(first, size)
            low = _LOWER[part[kept]].astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                low *= _POW[rel]
                h = np.add.reduceat(low, first)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(mix(h))
        at = to
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else empty
    end = np.concatenate(ends) if ends else empty
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, offsets, doc, start, end, h)


def word_hash(word: str) -> int:
    return int(words(pa.array([word])).h[0])


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words; the index of the run's first word is the position in a kept mask of words."""
    n = len(w.h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = w.doc[:n] == w.doc[k - 1 :]
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total += w.h[i : i + n] * _POW[i + 1]
    return w.doc[:n][ok], mix(total[ok], 5)


def row_sets(doc: np.ndarray, h: np.ndarray, rows: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each row; doc is ascending."""
    at = np.searchsorted(doc, np.arange(rows + 1))
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]


def shingle_sets(arr: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The set of k-word shingles of each row. A text of 1 to k-1 words has the one shingle of all its words; a text without words has none."""
    w = words(arr)
    doc, h = shingles(w, k)
    rows = len(w.offsets) - 1
    out = row_sets(doc, h, rows)
    at = w.bounds()
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < k))
    with np.errstate(over="ignore"):
        for i in short:
            own = w.h[at[i] : at[i + 1]]
            out[i] = mix(np.array([(own * _POW[1 : len(own) + 1]).sum()], np.uint64), 1000 + len(own))
    return out

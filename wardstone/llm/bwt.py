"""Burrows-Wheeler transforms of string collections and their merge by interleave refinement, to a fixed depth."""

from __future__ import annotations

import numpy as np


_END = 255  # no byte of UTF-8 text


class Collection:
    """Strings of UTF-8 bytes laid out with an end mark after each."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        sizes = np.array([len(s) for s in strings], np.int64) + 1
        self.first = np.cumsum(sizes) - sizes
        self.text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        last = self.first + sizes - 1
        self.before = np.arange(len(self.text)) - 1  # the position whose symbol precedes, around each string
        self.before[self.first] = last
        self.after = np.arange(len(self.text)) + 1
        self.after[last] = self.first


def sorted_rotations(c: Collection, depth: int) -> np.ndarray:
    """Positions in the order of their next depth symbols at least, around each string: by 8 symbols first, then by doubling of ranks."""
    rank, jump = c.text.astype(np.uint64), c.after
    for shift in (8, 16, 32):
        rank = rank << np.uint64(shift) | rank[jump]
        jump = jump[jump]
    known = 8
    _, rank = np.unique(rank, return_inverse=True)
    while known < depth:
        _, rank = np.unique(rank.astype(np.int64) * (int(rank.max()) + 2) + rank[jump], return_inverse=True)
        jump, known = jump[jump], known * 2
    return np.argsort(rank, kind="stable")


def transform(c: Collection, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard's transform: the symbol before each rotation, in their order, and the row of the rotation that begins with that symbol."""
    row = np.empty(len(order), np.int64)
    row[order] = np.arange(len(order))
    return c.text[c.before[order]], row[c.before[order]]


_MOST_CODES = 1 << 16  # codes of 16 bits are sorted by counting


def _steps(whole: np.ndarray, earlier: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(width, code, row) by rising width: code numbers the last width symbols before each row, in their order, and row is the row of the rotation that begins with them."""

    def numbered(x, size):
        number = np.cumsum(np.bincount(x, minlength=size) > 0) - 1
        return number[x], int(number[-1]) + 1

    code, codes = numbered(whole, 256)
    plain = [(1, code, codes, earlier)]
    out = [(1, code.astype(np.uint16), earlier)]
    while True:
        width, code, codes, row = plain[-1]
        for more, low, lows, back in reversed(plain):  # the widest step that still has few codes
            if codes * lows <= max(_MOST_CODES, 4 * len(whole)):
                break
        else:
            return out
        code, codes = numbered(code[back] * lows + low, codes * lows)
        if codes > _MOST_CODES:
            return out
        plain.append((width + more, code, codes, row[back]))
        out.append((width + more, code.astype(np.uint16), plain[-1][3]))
        if width + more >= 16:
            return out


def merge(transforms: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted shards by their transforms alone: (rows, block).

    rows is the interleave: the rows of all shards (numbered one shard after the other) in merged order; block numbers runs of rows that share their next depth symbols.
    Each round refines it: rows sorted by k symbols are read in order, and the rows that begin w symbols earlier are placed stably by those, which sorts them by k + w; w is as large as leaves few codes.
    A border appears where the symbols differ or the rows they precede lay in different blocks, so common prefixes come with the rounds; no two rotations are compared.
    """
    whole = np.concatenate([t for t, _ in transforms])
    earlier = np.concatenate([r + k for (_, r), k in zip(transforms, np.cumsum([0, *[len(t) for t, _ in transforms]]))]).astype(np.intp)
    n = len(whole)
    kind = np.int32 if n < 1 << 31 else np.int64
    rows, block = np.arange(n), np.zeros(n, kind)
    new = np.ones(n, bool)
    steps = _steps(whole, earlier) if n else []
    while depth and n:
        width, code, before = next(s for s in reversed(steps) if s[0] <= depth)
        depth -= width
        symbol = code[rows]
        place = np.argsort(symbol, kind="stable")
        s, b = symbol[place], block[place]
        np.logical_or(s[1:] != s[:-1], b[1:] != b[:-1], out=new[1:])
        rows = before[rows[place]]
        block = np.cumsum(new, dtype=kind) - 1
        if block[-1] == n - 1:  # all apart: more symbols change nothing
            break
    return rows, block


def window_owners(shards: list[list[bytes]], owner: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, first): least has, for each symbol of the strings laid out one after the other with an end mark each, the least owner of any string that has the same window of length bytes from there on; first is where each string begins."""
    held = [Collection(s) for s in shards]
    orders = [sorted_rotations(c, length) for c in held]
    rows, block = merge([transform(c, o) for c, o in zip(held, orders)], length)
    base = np.cumsum([0, *[len(c.text) for c in held]])
    position = np.concatenate([o + b for o, b in zip(orders, base)])[rows]
    first = np.concatenate([c.first + b for c, b in zip(held, base)])
    owners = np.repeat(np.concatenate(owner), np.diff(np.append(first, base[-1])))
    least = np.minimum.reduceat(owners[position], np.flatnonzero(np.diff(block, prepend=-1)))
    at = np.empty(len(position), np.int64)
    at[position] = least[block]
    return at, first


def shared_windows(shards: list[list[bytes]], owner: list[np.ndarray], length: int) -> list[list[np.ndarray]]:
    """For each shard's strings: for each start of a window of length bytes, the least owner of any string that has the same window."""
    at, first = window_owners(shards, owner, length)
    starts = iter(first.tolist())
    return [[at[f : f + max(0, len(s) - length + 1)] for s, f in zip(strings, starts)] for strings in shards]

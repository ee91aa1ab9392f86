import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from wardstone.llm import bwt
from wardstone.llm.bwt import Collection, merge, shared_windows, sorted_rotations, transform
from wardstone.llm.suffix_dedup import deduplicated, kept_text, repeated_in, stretches


def brute(rows, length):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        i, b = rows[k][0], (rows[k][1] or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], (i is None, i or 0))
    for k in order:
        i, b = rows[k][0], (rows[k][1] or "").encode()
        gone = bytearray(len(b) + 1)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < (i is None, i or 0):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for q in range(len(b)) if gone[q] and not (q and gone[q - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [50, 33])
def test_against_brute_force(frame, prose, edge, length):
    rng = random.Random(length)
    passages = [prose(30, 900 + i) for i in range(12)] + ["ab" * 60, "x" * 90, "é中😀 " * 20]
    rows = [(i, (prose(rng.randint(0, 60), i) + rng.choice(["", " "]) + rng.choice(passages)[rng.randint(0, 20) :] + prose(rng.randint(0, 30), 500 + i))) for i in range(150)]
    rows += [(200 + i, passages[i % 15][: 45 + i]) for i in range(30)] + [(300, rows[3][1]), (301, rows[3][1][:-5]), (2, "other text " * 20), (None, passages[0]), (None, passages[0]), (2, rows[2][1])]
    rows += [(400 + k, t) for k, (_, t) in enumerate(edge) if t is None or len(t) < 50_000]
    rng.shuffle(rows)
    got = sorted(map(tuple, deduplicated(frame(rows, clash=True).repartition(6), length).collect()), key=repr)
    assert got == brute(rows, length)


def test_doubled_line_before_a_shared_passage(frame):
    """The least piece may stand twice in one stretch and once in its only partner, which matches at the second place."""
    rng = random.Random(17)
    words = "north maple birch cloud amber cedar field alder quiet river harbor stone".split()
    some = lambda n: " ".join(rng.choice(words) + str(rng.randrange(100)) for _ in range(n))
    rows = []
    for k in range(120):
        line, passage = some(6)[: rng.randint(16, 35)] + "\n", some(rng.randint(4, 12))
        rows += [(2 * k, some(9) + line + line + passage + some(5)), (2 * k + 1, some(9) + line + passage + some(5))]
        if k % 2:
            rows[-2:] = [(2 * k, rows[-1][1]), (2 * k + 1, rows[-2][1])]
    got = sorted(map(tuple, deduplicated(frame(rows).repartition(4)).collect()), key=repr)
    assert got == brute(rows, 50)


def test_kept_text_and_empty(frame):
    t = "0123456789" * 8
    rows = [(1, t + "abc"), (2, "xyz" + t)]
    got = {r.doc_id: bytes(r.kept) for r in deduplicated(frame(rows), with_text=True).collect()}
    assert got == {1: (t + "abc").encode(), 2: b"xyz"}
    assert deduplicated(frame([])).count() == 0
    assert kept_text(b"abcdefgh", np.array([[1, 2], [4, 1]]), 2) == (b"agh", 5, 1)


def test_merged_transforms_sort_by_depth():
    rng = random.Random(8)
    for depth in (1, 3, 8, 20):
        shards = [[bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 5))]
        held = [Collection(s) for s in shards]
        orders = [sorted_rotations(c, depth) for c in held]
        rows, block = merge([transform(c, o) for c, o in zip(held, orders)], depth)

        def rotation(c, p):
            out = []
            for _ in range(depth):
                out.append(int(c.text[p]))
                p = c.after[p]
            return tuple(out)

        every = [rotation(c, p) for c, o in zip(held, orders) for p in o]
        merged = [every[r] for r in rows]
        assert merged == sorted(every) and sorted(rows.tolist()) == list(range(len(every)))
        assert len(set(merged)) == block[-1] + 1 and all((a == b) == (x == y) for a, b, x, y in zip(merged, merged[1:], block, block[1:]))


def test_shared_windows():
    shards = [[b"aaaabbbb", b"ccccc"], [b"xaaaabb"], [b"aaaa"]]
    got = shared_windows(shards, [np.array([5, 6]), np.array([3]), np.array([9])], 4)
    assert got[0][0].tolist() == [3, 3, 3, 5, 5] and got[1][0].tolist() == [3, 3, 3, 3] and got[2][0].tolist() == [3] and got[0][1].tolist() == [6, 6]


def _sender(texts):
    """What a sender of (doc_id, text) sends to a bucket that gets every stretch."""
    raw, offsets = b"".join(t for _, t in texts), np.cumsum([0, *[len(t) for _, t in texts]])
    row, first, windows, _ = stretches(np.frombuffer(raw, np.uint8), offsets, 50)
    ids = np.array([i for i, _ in texts])[row]
    body = b"".join([len(row).to_bytes(8, "little"), *[x.astype(np.int64).tobytes() for x in (ids, ids, ids * 0, first - offsets[row], windows)], *[raw[a : a + w + 49] for a, w in zip(first.tolist(), windows.tolist())]])
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def test_many_small_senders_take_few_shards_and_rounds(prose, monkeypatch):
    """A bucket's work follows its bytes: not its senders, whose number grows with the input, nor a round for each byte of a window."""
    passages = [prose(25, 70 + i) for i in range(9)]
    texts = [(i, f"{prose(3, i)} {passages[i % 9][i % 13 :]} {prose(3, 900 + i)}".encode()) for i in range(400)]
    blobs = [_sender([t]) for t in reversed(texts)]
    shards, rounds = [], []
    monkeypatch.setattr(bwt, "Collection", lambda s, f=bwt.Collection: shards.append(s) or f(s))
    monkeypatch.setattr(np, "argsort", lambda *a, f=np.argsort, **b: rounds.append(a) or f(*a, **b))
    for most in (1 << 20, 1 << 13):
        shards.clear(), rounds.clear()
        found = [np.stack([np.asarray(c) for c in p]) for p in repeated_in(blobs, 50, most)]
        if most == 1 << 20:
            assert 1 <= len(shards) <= 16 and len(rounds) - len(shards) <= 25
        ref, _, _, first, number = np.concatenate(found, axis=1)
        got = [(i, len(t), *kept_text(t, np.stack([first[ref == i], number[ref == i]], axis=1), 50)) for i, t in texts]
        assert sorted([(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, kept, gone, spans in got], key=repr) == brute([(i, t.decode()) for i, t in texts], 50)

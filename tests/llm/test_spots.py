import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from wardstone.llm.spots import ANCHORS, anchor_hashes, edited_fingerprints, fingerprint, likeness, near_duplicates, signature_sets


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b)


def test_edited_texts_and_order(frame, edge, prose):
    rows = sorted([(i, t) for i, t in {(i, t) for i, t in edge if i is not None}] + [(100 + i, prose(40, 50 + i)) for i in range(60)], key=lambda r: (r[0], r[1] or ""))
    got = {}
    for r in edited_fingerprints(frame(rows, clash=True).repartition(5)).collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        r = got[i][0]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest()), i
        a, b, c = signature_sets(pa.array([t, e, after]), anchor_hashes(ANCHORS))
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint(a), fingerprint(b))
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == likeness(fingerprint(a), fingerprint(c))
        assert abs(r.near_edited - jaccard(a, b)) < (0.2 if len(set(a.tolist()) | set(b.tolist())) > 128 else 1e-9)
        assert (r.fingerprint == r.edited_fingerprint) == (a.tolist() == b.tolist())
    same = {}
    for k, (i, _) in enumerate(rows):
        same.setdefault(texts[k], set()).add(got[i][0].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert sum(got[100 + i][0].near_edited > got[100 + i][0].near_next for i in range(60)) == 60


def test_all_edge_rows(frame, edge):
    out = edited_fingerprints(frame(edge)).collect()
    assert len(out) == len(edge) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


@pytest.mark.parametrize("rows", [[], [(1, "a lone text of the corpus")], [(None, "x"), (None, "x")], [(5, "same")] * 7])
def test_small_tables(frame, rows):
    out = edited_fingerprints(frame(rows)).collect()
    assert len(out) == len(rows)
    if len(rows) == 1:
        assert out[0].near_next == 1.0


def test_spots_follow_anchors():
    a, b = signature_sets(pa.array(["the quick fox of brown dogs and lazy cats", "THE, quick fox: of Brown dogs! and lazy cats."]), anchor_hashes(ANCHORS))
    assert a.tolist() == b.tolist() and 3 <= len(a) <= 9


def test_likeness_is_near_the_jaccard_similarity():
    rng = np.random.default_rng(2)
    off = []
    for k in range(300):
        pool = rng.integers(0, 2**64, 900, dtype=np.uint64)
        n = int(rng.integers(1, 900))
        a, b = np.unique(pool[: max(1, n)]), np.unique(pool[n // 3 :])
        off.append(likeness(fingerprint(a), fingerprint(b)) - jaccard(a, b))
    assert np.abs(off).max() < 0.2 and np.std(off) < 0.05 and abs(np.mean(off)) < 0.01


def test_no_text_changes_its_kind_of_signature():
    """A little edit changes few signatures, also where one word in 16 starts a spot."""
    words = [f"n{i}" for i in range(400)]
    for k in range(0, 400, 16):
        words[k] = "the"
    a, b = signature_sets(pa.array([" ".join(words), " ".join(words[:8] + ["the"] + words[8:])]), anchor_hashes(ANCHORS))
    assert jaccard(a, b) > 0.85


def test_near_duplicates_against_brute_force(frame, prose, edge):
    rng = random.Random(3)
    rows = [(i, prose(rng.randint(5, 200), i)) for i in range(60)]
    for g in range(10):
        words = prose(160, 900 + g).split()
        for k in range(6):
            w = list(words)
            for _ in range(k):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((100 + 10 * g + k, " ".join(w)))
    rows += [(300 + i, rows[70][1]) for i in range(5)] + [(400 + k, t) for k, (_, t) in enumerate(edge)]
    sets = [set(s.tolist()) for s in signature_sets(pa.array([t for _, t in rows], pa.string()), anchor_hashes(ANCHORS))]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), 1 << 60), d)
    expected = sorted((d, least[top(i)], links[i]) for i, (d, _) in enumerate(rows))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(frame(rows, clash=True), tile=16).collect())
    assert got == expected and sum(links) > 100
    assert near_duplicates(frame([])).count() == 0

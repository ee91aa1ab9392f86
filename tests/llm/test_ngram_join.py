import random

import numpy as np
import pyarrow as pa
import pytest

from wardstone.llm.kernel import shingle_sets
from wardstone.llm.ngram_join import TOKENS, all_documents, candidate_links, embed, follow, one_of_each, runs_for, sketch, tile_links


def brute(rows):
    """(class, links) of every row by comparing all pairs."""
    sets = [set(s.tolist()) for s in shingle_sets(pa.array([t for _, t in rows], pa.string()))]
    n, root = len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[top(i)] = min(least.get(top(i), 1 << 60), rows[i][0])
    return sorted([(rows[i][0], least.get(top(i)) if rows[i][0] is not None else None, links[i]) for i in range(n)], key=repr)


def _near(text, rate, rng):
    w = text.split()
    for k in range(len(w)):
        if rng.random() < rate:
            w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_against_brute_force(frame, prose, edge):
    rng = random.Random(1)
    rows = [(i, prose(rng.randint(1, 120), i)) for i in range(120)]
    for g in range(20):
        t = prose(150, 1000 + g)
        rows += [(200 + g * 10 + k, _near(t, 0.004 * k, rng)) for k in range(8)]
    rows += [(600 + i, prose(50, 5000)) for i in range(30)] + [(2000 + k, t) for k, (_, t) in enumerate(edge)] + [(None, prose(50, 5000)), (600, prose(50, 5000))]
    rng.shuffle(rows)
    got = sorted([(r.doc_id, r.class_id, r.n_links) for r in all_documents(frame(rows, clash=True)).collect()], key=repr)
    assert got == brute(rows)


def test_hot_group_is_split(frame, prose):
    """A group larger than a bucket and a tile: every link counts once."""
    rng = random.Random(2)
    t = prose(120, 7)
    rows = [(i, _near(t, 0.01, rng)) for i in range(260)] + [(1000 + i, prose(40, 300 + i)) for i in range(40)]
    got = sorted([(r.doc_id, r.class_id, r.n_links) for r in all_documents(frame(rows), small=16, tile=40).collect()], key=repr)
    assert got == brute(rows)


def test_one_of_each(frame, prose):
    rows = [(3, prose(40, 1)), (1, prose(40, 1)), (2, prose(40, 2)), (None, prose(40, 1)), (5, None), (6, "")]
    docs = frame(rows, clash=True)
    out = one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 5, 6]
    twice = one_of_each(frame([*rows, (2, prose(40, 2)), (1, prose(40, 1)), (6, ""), (6, "")], clash=True))
    assert sorted(r.doc_id or 0 for r in twice.collect()) == [0, 1, 2, 5, 6]
    assert one_of_each(frame([])).count() == 0 and all_documents(frame([])).count() == 0


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_paths_reach_the_target_recall(share):
    rng = np.random.default_rng(3)
    n, met, runs = 300, 0, runs_for(0.99, 4)
    for _ in range(n):
        k = 400
        both = int(round(2 * k * share / (1 + share)))
        pool = rng.integers(0, 2**64, 2 * k - both, dtype=np.uint64)
        tokens = np.stack([embed(np.sort(pool[:k])), embed(np.sort(pool[k - both :]))])
        owner, path = follow(tokens, np.repeat(np.arange(2), runs), np.tile(np.arange(runs, dtype=np.uint64), 2), 4, 0.8)
        met += bool(set(path[owner == 0].tolist()) & set(path[owner == 1].tolist()))
    assert met / n >= 0.93 and tokens.shape == (2, TOKENS)


def test_pairs_in_a_crowd_reach_the_target_recall(spark):
    """Pairs of a similarity of 0.81 among 800 half-alike sets, whose buckets are split."""
    rng = np.random.default_rng(5)
    some = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    crowd, rows = some(253), []
    for k in range(400):
        own = some(87)
        tokens = [embed(np.sort(np.concatenate([crowd, own, some(40)]))) for i in range(2)]
        rows += [(2 * k + i, t.tobytes(), sketch(t)) for i, t in enumerate(tokens)]
    sets = spark.createDataFrame(rows, "id long, tokens binary, bits long")
    links = {(min(r.a, r.b), max(r.a, r.b)) for r in candidate_links(sets, 0.8, 0.99, 16, []).collect()}
    assert sum((2 * k, 2 * k + 1) in links for k in range(400)) >= 0.985 * 400


def test_crowd_of_near_copies_is_one_component(spark):
    """Large buckets whose sets all look alike are linked at once, and a pair at the threshold inside one is in one component."""
    rng = np.random.default_rng(6)
    some = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    base, rows = some(300), []
    for k in range(300):
        t = embed(np.sort(np.concatenate([base[rng.random(300) < 0.93], some(15)])))
        rows.append((k, t.tobytes(), sketch(t)))
    links = candidate_links(spark.createDataFrame(rows, "id long, tokens binary, bits long"), 0.8, 0.99, 16, []).collect()
    root = list(range(300))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[max(top(r.a), top(r.b))] = min(top(r.a), top(r.b))
    assert len({top(k) for k in range(300)}) == 1


@pytest.mark.parametrize("others", [0, 20])
def test_ties_count_alike_in_small_and_large_tiles(others):
    """55 shared of 100 at 0.55: the comparison is between integers."""
    pool = np.arange(1, 101, dtype=np.uint64)
    sets = [pool[:77], pool[22:]] + [np.arange(1000 * k, 1000 * k + 77, dtype=np.uint64) for k in range(1, others + 1)]
    every = np.ones(len(sets), bool)
    i, j = tile_links(sets, every, every, 0.55)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1)]


def test_tiles_equal_pairwise_comparison():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**64, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common[rng.random(60) < 0.95], rng.integers(0, 2**64, int(rng.integers(0, 6)), dtype=np.uint64)])) for _ in range(40)]
    every = np.ones(40, bool)
    i, j = tile_links(sets, every, every, 0.8)
    expected = {(a, b) for a in range(40) for b in range(a + 1, 40) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist())) == expected and expected
    left = np.arange(40) < 20
    i, j = tile_links(sets, left, ~left, 0.8)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in expected if a < 20 <= b}

import random

import numpy as np

from wardstone.llm.licenses import TEMPLATES, aligned, license_matches


def test_planted_licenses(frame, prose):
    rng = random.Random(2)
    rows, expected = [], {}
    for i in range(120):
        name, text = TEMPLATES[i % len(TEMPLATES)]
        words = text.split()
        if i >= 60 and len(words) > 20:  # a tenth of the words is replaced
            for k in rng.sample(range(len(words)), len(words) // 10):
                words[k] = "zzz"
        a, b = prose(rng.randint(0, 200), i), prose(rng.randint(0, 200), i + 500)
        held = " ".join(words) if i % 2 else " ".join(words).upper()
        rows.append((i, f"{a} é\n{held}\n{b}"))
        expected[i] = (name, len(a) + 3, len(a) + 3 + len(held))
    rows += [(1000 + i, prose(200, 9000 + i)) for i in range(60)]
    got = {}
    for r in license_matches(frame(rows, clash=True)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(expected)
    for i, (name, start, end) in expected.items():
        assert [r.license for r in got[i]] == [name], (i, got[i])
        a, z, c = got[i][0].spans.split(",")[0].split(":")
        assert abs(int(a) - start) <= 12 and abs(int(z) - end) <= 12 and 0.75 <= float(c) <= 1


def test_short_notices_before_a_long_one(frame):
    """Every short line keeps its own span, and the full notice starts where it does."""
    short, full = TEMPLATES[0][1], TEMPLATES[1][1]
    rows = {n: f"{(short + ' ') * n}three other words {full}" for n in (0, 1, 3, 10, 1000)}
    for r in license_matches(frame(list(rows.items()))).collect():
        step, n = len(short) + 1, r.doc_id
        end = len(rows[n])
        expected = [(k * step, k * step + len(short) - 1) for k in range(n)] + [(n * step + 18, end - 1)]
        got = [tuple(map(int, x.split(":")[:2])) for x in r.spans.split(",")]
        assert r.license == "Apache-2.0" and got == expected and r.coverage == 1.0


def test_adjacent_and_worn_notices(frame):
    """Adjacent long notices, one with a stretch of words missing in the middle, are two spans."""
    full = dict(TEMPLATES)["MPL-2.0"].split()
    worn = full[:12] + full[20:]
    text = " ".join(full + worn + ["end"] + full)
    (r,) = license_matches(frame([(1, text)])).collect()
    starts = [0, len(" ".join(full)) + 1, len(" ".join(full + worn + ["end"])) + 1]
    got = [x.split(":") for x in r.spans.split(",")]
    assert [int(a) for a, _, _ in got] == starts and [float(c) > 0.99 for _, _, c in got] == [True, False, True]


def test_edge_cases(frame, edge):
    line = "Released under the MIT License. "
    out = license_matches(frame(edge + [(50, line * 500), (51, line), (51, line), (None, line)])).collect()
    assert sorted((r.doc_id or 0, r.n_spans, r.license) for r in out) == [(0, 1, "MIT"), (50, 500, "MIT"), (51, 1, "MIT"), (51, 1, "MIT")]
    assert license_matches(frame([])).count() == 0


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        t, s = [np.array([rng.randrange(5) for _ in range(rng.randint(1, 9))], np.uint64) for _ in range(2)]
        best = np.zeros((len(t) + 1, len(s) + 1), int)
        for i in range(len(t)):
            for j in range(len(s)):
                best[i + 1, j + 1] = best[i, j] + 1 if t[i] == s[j] else max(best[i, j + 1], best[i + 1, j])
        pairs = aligned(t, s, -len(t), len(s))
        assert len(pairs) == best[-1, -1] and all(t[i] == s[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))

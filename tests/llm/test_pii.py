import random
import re
import time

import pytest

from wardstone.llm.pii import KINDS, fit_pii, pii_spans, redact

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
NONE = {"bias": 0.0, "trees": [], "rate": 0.0, "from": [float("inf")] * 4}


def luhn(d):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base(t):
    out = []
    for k in KINDS:
        for m in re.finditer(PLAIN[k], t):
            g = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(g) <= 19 and luhn(g), "phone": 8 <= len(g) <= 15}[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def _card(rng, n=16):
    d = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


@pytest.fixture(scope="module")
def hard():
    rng = random.Random(7)
    bits = [lambda: "ann.b+c@mail.example.com", lambda: "a@b.c_d@e.f", lambda: "a@b.c..d@e.f", lambda: "x@y", lambda: "a@b.c@d.e", lambda: "1.2.3.4.5.6.7.8.9", lambda: "256.1.1.1", lambda: "000001.2.3.255", lambda: _card(rng), lambda: " ".join(re.findall("....", _card(rng))), lambda: "-".join(re.findall("....", _card(rng))), lambda: _card(rng, 19), lambda: _card(rng, 15), lambda: "1234567890123456", lambda: "+1 (706) 555-3138", lambda: "+49.30.1234 ", lambda: "+12", lambda: "++1 234 567 8901)", lambda: "12--34 5", lambda: "é中😀", lambda: "..@..", lambda: "-", lambda: " ", lambda: "9 ", lambda: "\n", lambda: "word "]
    return [(i, "".join(rng.choice(bits)() + rng.choice(["", " ", "", ","]) for _ in range(rng.randint(0, 14)))) for i in range(500)]


def test_base_spans_are_those_of_the_plain_patterns(frame, hard, edge):
    rows = hard + [(1000 + k, t) for k, (_, t) in enumerate(edge)]
    texts = dict(rows)
    got = pii_spans(frame(rows, clash=True), NONE).collect()
    assert len(got) == len(rows)
    for r in got:
        own = base(texts[r.doc_id] or "")
        assert r.base == ",".join(own) == r.spans, texts[r.doc_id]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x.startswith(k) for x in own) for k in KINDS]


def test_long_runs_are_read_once(frame):
    rows = [(1, "1" * 100_000), (2, "a" * 100_000), (3, "a.b" * 40_000 + "@"), (4, "1." * 50_000), (5, "+" * 50_000), (6, "1 " * 50_000), (7, "a@b" + ".c" * 50_000)]
    got = {r.doc_id: r for r in pii_spans(frame(rows), NONE).collect()}
    assert got[7].spans == "email:0:100003" and got[1].spans == got[2].spans == ""


def test_trees_add_spans_and_keep_base(frame, prose):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        n = _card(rng) if i % 2 else f"{rng.randrange(10**15, 10**16)}"
        rows.append((i, f"{prose(8, i)} {n} and +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} {prose(5, i)}"))
    rows += [(1000, "call (706) 555-3138 now"), (1001, "pay 3782 822463 10005 by card"), (1002, "plain words only")]
    model = fit_pii(frame(rows))
    assert model["trees"]
    texts = dict(rows)
    for r in pii_spans(frame(rows), model).collect():
        spans = r.spans.split(",") if r.spans else []
        assert set(base(texts[r.doc_id])) <= set(spans)
        order = [(KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)
    assert pii_spans(frame([(1002, "plain words only")]), model).first().spans == ""


def test_redaction(frame, edge):
    docs = frame([(1, "é mail a@b.co, ip 1.2.3.4!"), (2, None), (3, ""), (4, "+1 (706) 555-3138"), (5, "no data")], clash=True)
    out = redact(docs, NONE)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars, r.key) for r in out.collect()}
    assert got == {1: ("é mail [EMAIL], ip [IP]!", 24, 1), 2: (None, None, 1), 3: ("", 0, 1), 4: ("[PHONE]", 7, 1), 5: ("no data", 7, 1)}
    assert redact(frame(edge)).count() == len(edge) and pii_spans(frame([])).count() == 0


def test_no_python_in_the_plan(frame, hard):
    plan = pii_spans(frame(hard), fit_pii(frame(hard)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_hundred_thousand_spans_in_one_text(frame):
    """Sweeps are linear in spans: one text of 100,000 addresses, found, and redacted."""
    n = 100_000
    texts = [f"u{i}@a.bc, é" for i in range(n)]
    text = " ".join(texts)
    docs = frame([(1, text), (2, "mail a@b.co")])
    model = {"bias": 1.0, "trees": [], "rate": 0.0, "from": [0.0] * 4}
    began = time.monotonic()
    got = {r.doc_id: r for r in pii_spans(docs, model).collect()}
    clean = {r.doc_id: r.text for r in redact(docs, model).collect()}
    assert time.monotonic() - began < 60
    assert got[1].n_email == n and got[1].base.split(",")[-1] == f"email:{len(text) - len(texts[-1])}:{len(text) - 3}"
    assert clean == {1: " ".join(["[EMAIL], é"] * n), 2: "mail [EMAIL]"}


def test_overlapping_spans_become_one(frame):
    """Added spans that overlap others, over more than one part of a sweep, against a plain loop."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["1.2.3.4", "+1 (706) 555-3138", "12 345 6789", "a at b dot co", "x@y.zz", "3782 822463 10005", "word"]) for _ in range(rng.choice([3, 30, 400])))) for i in range(40)]
    docs = frame(rows)
    model = {"bias": 1.0, "trees": [], "rate": 0.0, "from": [0.0] * 4}
    spans = {r.doc_id: r.spans.split(",") if r.spans else [] for r in pii_spans(docs, model).collect()}
    texts = dict(rows)
    for r in redact(docs, model).collect():
        out, at, last = [], 0, None
        for a, z, k in sorted((int(a), int(z), KINDS.index(k)) for k, a, z in (s.split(":") for s in spans[r.doc_id])):
            if a >= at:
                out += [texts[r.doc_id][at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, z)
        assert r.text == "".join(out) + texts[r.doc_id][at:]

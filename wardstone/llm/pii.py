"""Personal data by candidate gradient boosting, in DataFrame functions only.

Per kind, a strict pattern with its check gives the base spans. High-recall generators propose more spans, which may overlap.
Boosted regression trees over format and context features of a candidate, and a threshold per kind that reaches the target
precision on held-out documents, select the spans added to the base ones.

Learning: a candidate is positive if it covers a base span of its kind that is alone in it, negative if it holds the shape but fails the
kind's check (digits without a Luhn sum, octets over 255). The check itself is no feature: trees tell by format and context alone. Candidates of all documents are counted by their feature cell, a
groupBy with map-side sums; there are at most CELLS of these, so the counts are of fixed size however large the corpus. Trees are fitted
on the counts and become one CASE expression.

Defined cases: a null or empty text has no spans. Positions are code points, end exclusive. Repeated rows get equal results;
other columns are kept by ``redact`` and ignored by ``pii_spans``. Without candidates no span is added. Patterns use possessive repeats and
start only where a leftmost search could, so a run of 100,000 digits or letters is read once; spans are located, labelled and
chosen by sweeps over sorted arrays, so a text of 100,000 spans takes seconds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns. \G lets a match start where the one before it ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: (kind, pattern). Each match has at most some hundred characters, but for those of strict shape.
GENERATORS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,63}+){1,6}+"),
    ("ip", r"(?<![0-9.])[0-9]{1,4}+(?:(?:\.|\[\.\]|\x20\.\x20)[0-9]{1,4}+){3}+(?![0-9])"),
    ("card", r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![\x20.-]?[0-9])"),
    ("phone", r"(?<![0-9(+])(?:\+|00)?\(?[0-9]{2,4}+\)?[\x20.-]{1,2}+\(?[0-9]{2,4}+\)?[\x20.-]{1,2}+[0-9]{3,5}+(?:[\x20.-][0-9]{2,5}+){0,2}+(?![0-9])"),
]
#: A feature has as many values as this, from 0; their product bounds the number of feature cells.
FEATURES = {"kind": 4, "digits": 6, "plain": 2, "plus": 2, "marks": 3, "before": 4, "after": 4, "word": 2}
CELLS = math.prod(FEATURES.values())
_CONTEXT = 24


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total, i):
        v = F.substring(turned, i, F.lit(1)).cast("int")
        v = F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)
        return total + v

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def octets(t: Column) -> Column:
    """All runs of digits are 255 at most; leading zeros don't count."""
    return F.forall(F.regexp_extract_all(t, F.lit("([0-9]+)"), F.lit(0)), lambda x: x.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


def _valid(kind: str, t: Column) -> Column:
    n = F.length(_digits(t))
    return {"email": F.lit(True), "ip": octets(t), "card": n.between(16, 19) & luhn(_digits(t)), "phone": n.between(8, 15)}[kind]


def _checked(kind: str):
    return lambda m: _valid(kind, m["t"])


_SHORT = 48


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(items: Column, zero: Column, add, make, state: str, item: str) -> Column:
    """array<item> of make(state, x) for each x, the state being all x before it added to zero: a fold that appends, in parts of the root of the size, as an append copies its array."""
    empty, struct = F.array().cast(f"array<{item}>"), f"struct<at:{state},out:array<{item}>>"

    def fold(part: Column, start: Column) -> Column:
        both = F.struct(start.alias("at"), empty.alias("out")).cast(struct)
        step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.array_append(acc["out"], make(acc["at"], x)).alias("out")).cast(struct)
        return F.aggregate(part, both, step, lambda acc: acc["out"])

    def long(items: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int")
        part = lambda i: F.slice(items, i * size + 1, size)
        states = f"struct<at:{state},out:array<{state}>>"
        begin = F.struct(zero.alias("at"), F.array().cast(f"array<{state}>").alias("out")).cast(states)
        whole = lambda acc, i: F.struct(F.aggregate(part(i), acc["at"], lambda at, x: add(at, x).cast(state)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")).cast(states)
        starts = F.aggregate(F.sequence(F.lit(0), size - 1), begin, whole, lambda acc: acc["out"])
        return F.flatten(F.transform(starts, lambda at, i: fold(part(i), at)))

    return let(items, lambda v: F.when(F.size(v) <= _SHORT, fold(v, zero)).otherwise(long(v)))


def located(text: Column, pattern: str, context: bool = False) -> Column:
    """array<struct<s,e,t>>: the leftmost non-overlapping matches with their code point positions, from the pieces between them; with context, the 24 characters before (l) and the one after (r)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    span = "struct<s:int,e:int,t:string" + (",l:string,r:string>" if context else ">")

    def build(pieces: Column, found: Column) -> Column:
        near = lambda m, i: [F.substring(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(pieces, i)), -_CONTEXT, _CONTEXT).alias("l"), F.substring(F.concat(F.get(pieces, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), 1, 1).alias("r")] if context else []
        both = F.transform(found, lambda m, i: F.struct(F.length(F.get(pieces, i)).alias("p"), F.length(m).alias("n"), m.alias("t"), *near(m, i)))
        place = lambda at, x: F.struct((at + x["p"]).alias("s"), (at + x["p"] + x["n"]).alias("e"), *[x[c].alias(c) for c in ("t", "l", "r")[: 3 if context else 1]])
        return scanned(both, F.lit(0), lambda at, x: at + x["p"] + x["n"], place, "int", span)

    held = F.struct(F.split(text, pattern, -1).alias("pieces"), found.alias("found"))
    return F.when(text.rlike(pattern), let(held, lambda h: build(h["pieces"], h["found"]))).otherwise(F.array().cast(f"array<{span}>"))


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """df with an array b_<kind> of base spans for each kind."""
    for kind in KINDS:
        df = df.withColumn(f"b_{kind}", F.filter(located(F.col(text), BASE[kind]), _checked(kind)))
    return df


_CANDIDATE = ("s", "e", "kind", "check", "digits", "plain", "plus", "marks", "before", "after", "word")


def candidates(df: DataFrame, text: str) -> DataFrame:
    """df with an array ``cand`` of the generators' spans and their features."""
    for g, (_, pattern) in enumerate(GENERATORS):
        df = df.withColumn(f"g_{g}", located(F.col(text), pattern, context=True))
    parts = [F.transform(f"g_{g}", _described(kind)) for g, (kind, _) in enumerate(GENERATORS)]
    return df.withColumn("cand", F.concat(*parts)).drop(*[f"g_{g}" for g in range(len(GENERATORS))])


def _described(kind: str):
    """A function of a located span with context: its features, and whether it passes its kind's check, which is no feature."""

    def of(m):
        t, d = m["t"], _digits(m["t"])
        n = F.length(d)
        side = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z0-9_=\"'/]"), 2).otherwise(3)
        check = {"email": t.contains("@"), "ip": octets(t), "card": luhn(d), "phone": n.between(8, 15)}[kind]
        given = {
            "s": m["s"], "e": m["e"], "kind": F.lit(KINDS.index(kind)), "check": check.cast("int"), "digits": F.when(n < 7, 0).when(n < 10, 1).when(n < 13, 2).when(n < 16, 3).when(n < 17, 4).otherwise(5),
            "plain": (~t.rlike(r"[\x20\[\]()]")).cast("int"), "plus": t.startswith("+").cast("int"), "marks": F.least(F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"([^A-Za-z0-9])"), F.lit(0)))), F.lit(2)),
            "before": side(F.substring(m["l"], -1, 1)), "after": side(m["r"]),
            "word": m["l"].rlike(r"(?i)(?:mail|phone|tel|call|fax|mobil|card|visa|credit|karte|tarjeta|carte|ip|address|host|server)[^A-Za-z]{0,4}(?:[a-z]{2,6}[^A-Za-z]{1,3})?$").cast("int"),
        }
        return F.struct(*[given[c].cast("int").alias(c) for c in _CANDIDATE])

    return of


def _labelled(cand: Column, base: dict[str, Column]) -> Column:
    """array<struct<c, y>> of candidates. y is 1 where one base span of the kind makes up the candidate but for 2 characters, 0 where it fails the kind's check, else null. One sweep: base spans of a kind don't overlap, so of those that start up to 2 characters further on the last decides."""
    fields = ",".join(f"{c}:int" for c in _CANDIDATE)
    event = f"struct<x:int,is:int,kind:int,s:int,e:int,c:struct<{fields}>>"
    of = lambda x, s, kind, e, c: F.struct(x.alias("x"), F.lit(0 if c is None else 1).alias("is"), kind.alias("kind"), s.alias("s"), e.alias("e"), (F.lit(None) if c is None else c).alias("c")).cast(event)
    events = F.array_sort(F.concat(*[F.transform(b, _base_event(of, i)) for i, b in enumerate(base.values())], F.transform(cand, lambda c: of(c["s"] + 2, c["s"], c["kind"], c["e"], c))))
    state = "struct<" + ",".join(f"s{i}:int,e{i}:int" for i in range(len(KINDS))) + ">"
    zero = F.struct(*[F.lit(-9).alias(f"{p}{i}") for i in range(len(KINDS)) for p in "se"]).cast(state)
    add = lambda at, x: F.struct(*[F.when((x["is"] == 0) & (x["kind"] == i), x[p]).otherwise(at[f"{p}{i}"]).alias(f"{p}{i}") for i in range(len(KINDS)) for p in "se"])

    def make(at, x):
        y = F.lit(None).cast("int")
        for i, k in enumerate(KINDS):
            own = (F.abs(at[f"s{i}"] - x["s"]) <= 2) & (F.abs(at[f"e{i}"] - x["e"]) <= 2)
            y = F.when(x["kind"] == i, F.when(own, 1).when((x["c"]["check"] == 0) if k != "email" else F.lit(False), 0)).otherwise(y)
        return F.struct(x["c"].alias("c"), y.alias("y"))

    return F.filter(scanned(events, zero, add, make, state, f"struct<c:struct<{fields}>,y:int>"), lambda v: v["c"].isNotNull() & v["y"].isNotNull())


def _base_event(of, kind: int):
    return lambda b: of(b["s"], b["s"], F.lit(kind), b["e"], None)


def counts(docs: DataFrame) -> list[dict]:
    """Candidates of all documents by feature cell, held-out half and label: at most 4 * CELLS rows."""
    df = base_spans(docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")), "text")
    df = candidates(df.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), "text")
    rows = df.where(F.size("cand") > 0).select("half", F.explode(_labelled(F.col("cand"), {k: F.col(f"b_{k}") for k in KINDS})).alias("x"))
    rows = rows.groupBy("half", F.col("x.y").alias("y"), *[F.col(f"x.c.{f}").alias(f) for f in FEATURES]).agg(F.count(F.lit(1)).alias("n"))
    return [r.asDict() for r in rows.collect()]


def _fit_tree(rows: list[dict], depth: int, lam: float = 1.0):
    """A regression tree on gradients (g) and curvatures (h) of rows: a leaf value or (feature, value, low side, high side)."""
    g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    leaf = g / (h + lam)
    if not depth or len(rows) < 2:
        return leaf
    best, most = None, g * g / (h + lam) + 1e-9
    for f, size in FEATURES.items():
        for v in range(size - 1):
            gl, hl = sum(r["g"] for r in rows if r[f] <= v), sum(r["h"] for r in rows if r[f] <= v)
            if hl > 0 and h - hl > 1e-12:
                gain = gl * gl / (hl + lam) + (g - gl) ** 2 / (h - hl + lam)
                if gain > most:
                    best, most = (f, v), gain
    if best is None:
        return leaf
    f, v = best
    low, high = [r for r in rows if r[f] <= v], [r for r in rows if r[f] > v]
    return (f, v, _fit_tree(low, depth - 1, lam), _fit_tree(high, depth - 1, lam)) if low and high else leaf


def _leaf(tree, r: dict) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if r[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(cells: list[dict], rounds: int = 20, depth: int = 3, rate: float = 0.3) -> dict:
    """{bias, trees}: logistic gradient boosting on counted cells (n, y and features)."""
    n, ones = sum(c["n"] for c in cells), sum(c["n"] for c in cells if c["y"])
    bias = math.log((ones + 1) / (n - ones + 1))
    rows, trees = [c | {"f": bias} for c in cells], []
    for _ in range(rounds if 0 < ones < n else 0):
        for r in rows:
            p = 1 / (1 + math.exp(-r["f"]))
            r["g"], r["h"] = r["n"] * (r["y"] - p), r["n"] * p * (1 - p)
        tree = _fit_tree(rows, depth)
        trees.append(tree)
        for r in rows:
            r["f"] += rate * _leaf(tree, r)
    return {"bias": bias, "trees": trees, "rate": rate}


def margin(model: dict, r: dict) -> float:
    return model["bias"] + model["rate"] * sum(_leaf(t, r) for t in model["trees"])


def thresholds(model: dict, cells: list[dict], precision: float) -> list[float]:
    """Per kind, the lowest margin from which up the held-out candidates have the precision; infinity where none has, or positives are missing."""
    out = []
    for k in range(len(KINDS)):
        own = sorted(((margin(model, c), c["n"], c["y"]) for c in cells if c["kind"] == k), reverse=True)
        best, n, ones = math.inf, 0, 0
        for i, (m, count, y) in enumerate(own):
            n, ones = n + count, ones + count * y
            if ones and ones / n >= precision and (i + 1 == len(own) or own[i + 1][0] < m - 1e-9):
                best = m - 1e-9
        out.append(best)
    return out


def fit_pii(docs: DataFrame, precision: float = 0.98, **options) -> dict:
    cells = counts(docs)
    model = boost([c for c in cells if c["half"] == 0], **options)
    return model | {"from": thresholds(model, [c for c in cells if c["half"] == 1], precision)}


def _margin(model: dict, c: Column) -> Column:
    def tree(t):
        return F.when(c[t[0]] <= t[1], tree(t[2])).otherwise(tree(t[3])) if isinstance(t, tuple) else F.lit(float(t))

    total = F.lit(float(model["bias"]))
    for t in model["trees"]:
        total = total + tree(t) * model["rate"]
    return total


#: Generators have at most some 550 characters and don't overlap within a kind, whose least sizes are 5, 7, 13 and 8: so many others can touch one.
_NEAR = 240


def _clear_of(cand: Column, base: Column, item: str) -> Column:
    """Of candidates those that touch no base span. In the order of candidates' ends and base spans' starts, the furthest end of the base spans so far tells."""
    event = f"struct<x:int,is:int,e:int,c:{item}>"
    of = lambda x, flag, e, c: F.struct(x.alias("x"), F.lit(flag).alias("is"), e.alias("e"), c.alias("c")).cast(event)
    events = F.array_sort(F.concat(F.transform(base, lambda b: of(b["s"], 1, b["e"], F.lit(None))), F.transform(cand, lambda c: of(c["e"], 0, F.lit(0), c))))
    kept = scanned(events, F.lit(-1), lambda at, x: F.greatest(at, F.when(x["is"] == 1, x["e"]).otherwise(-1)), lambda at, x: F.struct((at <= x["c"]["s"]).alias("ok"), x["c"].alias("c")), "int", f"struct<ok:boolean,c:{item}>")
    return F.transform(F.filter(kept, lambda v: v["c"].isNotNull() & v["ok"]), lambda v: v["c"])


def _spans(df: DataFrame, model: dict, text: str) -> DataFrame:
    """df with b_<kind> and ``added``: chosen candidates that touch no base span and no better candidate."""
    df = candidates(base_spans(df, text), text)
    limit = F.array(*[F.lit(x if math.isfinite(x) else 1e300) for x in model["from"]])
    item = "struct<s:int,e:int,kind:int,m:double>"
    scored = F.transform("cand", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"), _margin(model, c).alias("m")).cast(item))
    df = df.withColumn("scored", F.filter(scored, lambda c: c["m"] >= F.element_at(limit, c["kind"] + 1)))
    base = F.concat(*[F.transform(f"b_{k}", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))) for k in KINDS])
    df = df.withColumn("scored", F.when(F.size("scored") > 0, F.array_sort(_clear_of(F.col("scored"), base, item))).otherwise(F.col("scored")))
    touch = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    order = lambda c: F.struct(c["m"], c["e"] - c["s"], -c["s"], -c["kind"])
    near = lambda i: F.slice("scored", F.greatest(i + 1 - _NEAR, F.lit(1)), F.lit(2 * _NEAR + 1))
    best = F.filter("scored", lambda c, i: ~F.exists(near(i), lambda o: touch(o, c) & (order(o) > order(c))))
    return df.withColumn("added", best).drop("cand", "scored")


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def _of_kind(i: int):
    return lambda x: x["kind"] == i


def _tagged(i: int):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(i).alias("kind"))


def pii_spans(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base (kind:start:end, comma-joined), spans (with those added)."""
    model = fit_pii(docs) if model is None else model
    df = _spans(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), model, "text")
    place = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    every = [F.array_sort(F.concat(F.transform(f"b_{k}", place), F.transform(F.filter("added", _of_kind(i)), place))) for i, k in enumerate(KINDS)]
    return df.select(
        "doc_id", *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.array_join(F.concat(*[_named(k, F.col(f"b_{k}")) for k in KINDS]), ",").alias("base"), F.array_join(F.concat(*[_named(k, s) for k, s in zip(KINDS, every)]), ",").alias("spans")
    )


_SPAN = "struct<s:int,e:int,kind:int>"


def _merged(spans: Column) -> Column:
    """Of sorted spans those that don't start inside an earlier one, each ending where the last that overlaps it does: one name for all of them."""
    seen = scanned(spans, F.lit(0), lambda at, x: F.greatest(at, x["e"]), lambda at, x: F.struct((x["s"] >= at).alias("first"), F.greatest(at, x["e"]).alias("to"), x.alias("x")), "int", f"struct<first:boolean,to:int,x:{_SPAN}>")
    firsts = lambda seen: F.filter(F.transform(seen, lambda v, i: F.struct(v["first"].alias("first"), v["x"].alias("x"), i.alias("i"))), lambda v: v["first"])
    end = lambda seen, firsts, i: F.get(seen, F.coalesce(F.get(firsts, i + 1)["i"], F.size(seen)) - 1)["to"]
    return let(seen, lambda v: let(firsts(v), lambda f: F.transform(f, lambda w, i: F.struct(w["x"]["s"].alias("s"), end(v, f, i).alias("e"), w["x"]["kind"].alias("kind")).cast(_SPAN))))


def _replaced(spans: Column, text: Column, kinds: Column) -> Column:
    """text with spans, which are sorted and apart, replaced by their kinds' names: cut in parts of the root of their number first, as a cut reads its text from the start."""
    size = F.ceil(F.sqrt(F.size(spans).cast("double"))).cast("int")
    parts = F.sequence(F.lit(0), size - 1)

    def part(i: Column) -> Column:
        own = F.slice(spans, i * size + 1, size)
        start = F.when(i == 0, 0).otherwise(F.get(spans, i * size - 1)["e"])
        end = F.get(spans, F.least((i + 1) * size, F.size(spans)) - 1)["e"]
        return F.struct(own.alias("own"), start.alias("start"), F.substring(text, start + 1, end - start).alias("t"))

    def written(p: Column) -> Column:
        at = lambda k: F.when(k == 0, p["start"]).otherwise(F.get(p["own"], k - 1)["e"])
        return F.array_join(F.transform(p["own"], lambda x, k: F.concat(F.substring(p["t"], at(k) - p["start"] + 1, x["s"] - at(k)), F.element_at(kinds, x["kind"] + 1))), "")

    some = F.filter(parts, lambda i: i * size < F.size(spans))
    return F.concat(F.array_join(F.transform(F.transform(some, part), written), ""), F.substring(text, F.element_at(spans, -1)["e"] + 1, F.length(text)))


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """docs with every span replaced by its kind in brackets and n_chars (where there is one) set anew; overlapping spans become one, named after the first. Null texts stay null."""
    model = fit_pii(docs) if model is None else model
    cols = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(cols)], F.coalesce(F.col("text"), F.lit("")).alias("pii_text"))
    df = _spans(own, model, "pii_text")
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    every = F.array_sort(F.concat(*[F.transform(f"b_{k}", _tagged(i)) for i, k in enumerate(KINDS)], F.transform("added", lambda a: F.struct(a["s"].alias("s"), a["e"].alias("e"), a["kind"].alias("kind")))))
    clean = let(_merged(F.col("every")), lambda spans: _replaced(spans, F.col("pii_text"), kinds))
    df = df.withColumn("every", every).withColumn("clean", F.when(F.size("every") > 0, clean).otherwise(F.col("pii_text")))
    at = cols.index("text")
    out = {"text": F.when(F.col(f"in_{at}").isNotNull(), F.col("clean")), "n_chars": F.when(F.col(f"in_{at}").isNotNull(), F.length("clean").cast("long"))}
    return df.select(*[(out[c] if c in out else F.col(f"in_{i}")).alias(c) for i, c in enumerate(cols)])

"""URL filters: fixed host and path rules first, then association rules mined by FP-growth from labelled URLs.

``judge_urls`` returns one row per input row. Null urls and urls without ``://`` have an empty host and path and only
the token ``none``. Repeated rows are judged alike; extra columns are ignored; an empty table gives an empty result,
and without labelled rows every url that no rule fits gets the default verdict.

Size bounds: a mined rule has at most max_tokens tokens of support >= min_support, so with k tokens a url on average
there are at most (k / min_support) ** max_tokens antecedents for each verdict, however many urls there are. Their
index goes to the tasks with the function; the urls are never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released

ALLOW, BLOCK = "allow", "block"
#: (verdict, host and path).
RULES = [(ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = rest.substr(F.length(host) + 1, F.length(rest))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return empty(F.translate(host, _UPPER, _LOWER)), empty(F.regexp_extract(tail, "^[^?#]*", 0))


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Of equal rules the first in the list counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_tokens(url: str | None) -> list[str]:
    """Distinct tokens of a url: scheme, host labels, the last two labels together, words of the path, extension, query keys, fragment."""
    if url is None or "://" not in url:
        return ["none"]
    scheme, _, rest = url.partition("://")
    host = re.match(r"[^/?#]*", rest)[0]
    path, _, fragment = rest[len(host) :].partition("#")
    path, _, query = path.partition("?")
    labels = host.lower().split(".")
    out = {f"scheme:{scheme.lower()}": 0, f"top:{labels[-1]}": 0, f"site:{'.'.join(labels[-2:])}": 0}
    out |= {f"host:{x}": 0 for x in labels[:-2]}
    for part in filter(None, path.lower().split("/")):
        stem, _, ext = part.rpartition(".")
        out |= {f"ext:{ext}": 0} if stem else {}
        out[f"path:{'#' if (stem or part).isdigit() else stem or part}"] = 0
    out |= {f"key:{x.partition('=')[0].lower()}": 0 for x in filter(None, query.split("&"))}
    return [*out, *["fragment"] * bool(fragment)]


def _with_tokens(rows: DataFrame) -> DataFrame:
    def tokens(batches):
        for b in batches:
            yield b.append_column("tokens", pa.array([url_tokens(u) for u in b.column("url").to_pylist()], pa.list_(pa.string())))

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(released(tokens), f"{fields}, tokens array<string>")


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8, max_tokens: int = 3, min_count: int = 10) -> list[dict]:
    """Association rules {tokens, verdict, confidence, support} from labelled (url, verdict), the most general first.

    A rule is dropped if one with a part of its tokens, the same verdict and at least its confidence stays.
    min_count is the least number of urls that a rule rests on. Token sets are counted by Spark's FP-growth over all labelled rows.
    """
    sets = _with_tokens(labelled.where(F.col("verdict").isin(ALLOW, BLOCK)).select("url", "verdict")).select(F.concat("tokens", F.array(F.concat(F.lit("is:"), F.col("verdict")))).alias("items"))
    n = sets.count()
    if not n:
        return []
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min_confidence).fit(sets)
    found = model.associationRules.where(F.col("consequent")[0].startswith("is:") & (F.size("antecedent") <= max_tokens) & ~F.exists("antecedent", lambda t: t.startswith("is:")))
    kept: list[dict] = []
    for r in sorted(found.collect(), key=lambda r: (len(r.antecedent), sorted(r.antecedent), r.consequent)):
        own, verdict = frozenset(r.antecedent), r.consequent[0][3:]
        if not any(k["verdict"] == verdict and k["confidence"] >= r.confidence and k["tokens"] < own for k in kept):
            kept.append({"tokens": own, "verdict": verdict, "confidence": r.confidence, "support": r.support})
    model.freqItemsets.unpersist()
    return kept


class RuleIndex:
    """Mined rules by one token each, the one that fewest rules have, so few rules are tried on a url."""

    def __init__(self, rules: list[dict]):
        often: dict[str, int] = defaultdict(int)
        for r in rules:
            for t in r["tokens"]:
                often[t] += 1
        self.by: dict[str, list[dict]] = defaultdict(list)
        for r in rules:
            self.by[min(r["tokens"], key=lambda t: (often[t], t))].append(r)

    def best(self, tokens: list[str]) -> dict | None:
        """Of the rules whose tokens the url has, that with the highest confidence, then most support, then most tokens; block before allow."""
        have = set(tokens)
        fits = [r for t in have for r in self.by.get(t, ()) if r["tokens"] <= have]
        return max(fits, key=lambda r: (r["confidence"], r["support"], len(r["tokens"]), r["verdict"], sorted(r["tokens"])), default=None)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labels: DataFrame | None = None, default: str = ALLOW, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (tokens of the mined rule), confidence.

    labels (url, verdict) are what is mined; where none are given, the urls that a fixed rule fits, with its verdict.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "verdict": verdict})
    index = RuleIndex(mine_rules(base.where(F.col("verdict").isNotNull()) if labels is None else labels, **mining))

    def judged(batches):
        for b in batches:
            best = [None if v is not None else index.best(url_tokens(u)) for u, v in zip(b.column("url").to_pylist(), b.column("verdict").to_pylist())]
            verdicts = [v or (r["verdict"] if r else default) for v, r in zip(b.column("verdict").to_pylist(), best)]
            b = b.drop_columns(["url", "verdict"])
            yield b.append_column("verdict", pa.array(verdicts, pa.string())).append_column("mined", pa.array([" ".join(sorted(r["tokens"])) if r else None for r in best], pa.string())).append_column("confidence", pa.array([r["confidence"] if r else None for r in best], pa.float64()))

    kind = dict(pages.dtypes)["page_id"]
    return base.mapInArrow(released(judged), f"page_id {kind}, host string, path string, rule string, verdict string, mined string, confidence double")

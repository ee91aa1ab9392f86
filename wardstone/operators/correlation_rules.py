"""The correlation language: bounded, typed, fail-closed; selectors become columns."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.attack import SEVERITY
from ..functions.text import duration_seconds

#: Fields that selectors of each source may test, fields of groups and of relations.
DETECTION_FIELDS = {"rule_id", "rule_version", "severity", "platform", "vendor", "product", "source_type", "host_name", "user_name", "source_ip", "destination_ip", "signature_id", "protocol"}
EVENT_FIELDS = {"event_code", "event_category", "event_action", "event_kind", "platform", "vendor", "product", "source_type", "host_name", "user_name", "user_id", "source_ip", "destination_ip", "service_name", "outcome", "initiated", "protocol"}
GROUP_FIELDS = {"host_name", "user_name", "source_ip", "destination_ip", "shared_ip", "platform", "source_type", "rule_id", "signature_id"}
RELATION_FIELDS = {"host_name", "user_name", "source_ip", "destination_ip", "platform", "signature_id", "protocol", "ip_set", "local_ip_set"}
MAX = {"selectors": 8, "predicates": 16, "values": 32, "groups": 4, "window": 3600, "lateness": 86400, "threshold": 1000, "stages": 4, "stage": 100, "relations": 4}


class CorrelationError(ValueError):
    pass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise CorrelationError(what)


def _keys(doc, required: set[str], optional: set[str] = frozenset()) -> dict:
    _need(isinstance(doc, dict) and required <= set(doc) <= required | optional, f"keys must be {sorted(required | optional)}: {doc!r}"[:300])
    return doc


@dataclass(frozen=True)
class Selector:
    source: str
    where: tuple[tuple[str, str, tuple], ...]

    def holds(self, canonical: dict[str, Column] | None = None) -> Column:
        """Whether an input is of this source and meets all predicates. Hosts, users and addresses of both sides compare in canonical form."""
        col = lambda f: (canonical or {}).get(f, F.col(f))

        def same(f: str, c: Column, v) -> Column:
            if f == "host_name":
                return c == canon.canonical_host(F.lit(str(v)))
            if f in ("source_ip", "destination_ip"):
                return c == F.lit(canon.literal_ip(v))
            if f == "user_name":
                platform = F.lower(F.trim("platform"))
                who = lambda w: canon.principal_json(platform, *map(F.lit, canon.literal_principal(v, w) or (None, None, None)))
                return c == F.when(platform == "windows", who(True)).otherwise(who(False))
            if f == "platform":
                return F.lower(F.trim(c)) == str(v).strip().lower()
            return c.try_cast("bigint") == v if isinstance(v, int) else c.cast("string") == v

        def test(f, op, values) -> Column:
            c = col(f)
            if op == "exists":
                return F.trim(F.col(f).cast("string")) != ""
            return reduce(lambda a, b: a | b, [F.coalesce(same(f, c, v), F.lit(False)) for v in values])

        return F.coalesce(reduce(lambda a, b: a & b, [F.col("input_kind") == self.source, *[test(*w) for w in self.where]]), F.lit(False))

    def column(self, canonical: dict[str, Column] | None = None) -> Column:
        """holds, of valid inputs."""
        return F.col("invalid_reason").isNull() & self.holds(canonical)


@dataclass(frozen=True)
class CorrelationRule:
    id: str
    version: int
    title: str
    kind: str
    window_ms: int
    lateness_ms: int
    group_by: tuple[str, ...]
    selectors: dict[str, Selector]
    threshold: dict | None
    stages: tuple[tuple[str, int], ...]
    require: tuple[str, ...]
    relations: tuple[tuple[str, str, str, str, str], ...]
    incident: dict
    tactics: tuple[str, ...]
    techniques: tuple[str, ...]

    def plan(self) -> dict:
        """What decides results; prose, version and the order in the file don't."""
        return {
            "kind": self.kind, "window": self.window_ms, "lateness": self.lateness_ms, "group": self.group_by, "selectors": {n: [s.source, sorted(map(repr, s.where))] for n, s in sorted(self.selectors.items())},
            "threshold": self.threshold, "stages": self.stages, "require": sorted(self.require), "relations": sorted(map(list, self.relations)), "severity": self.incident["severity"], "confidence": self.incident["confidence"],
            "tactics": sorted(self.tactics), "techniques": sorted(self.techniques),
        }

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.plan(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _int(v, low: int, high: int, what: str) -> int:
    _need(isinstance(v, int) and not isinstance(v, bool) and low <= v <= high, f"{what} must be {low} to {high}")
    return v


def _selector(name: str, doc) -> Selector:
    _keys(doc, {"source", "where"})
    _need(doc["source"] in ("detection", "event"), f"{name}: unknown source")
    fields = DETECTION_FIELDS if doc["source"] == "detection" else EVENT_FIELDS
    _need(isinstance(doc["where"], list) and 1 <= len(doc["where"]) <= MAX["predicates"], f"{name}: 1 to {MAX['predicates']} predicates")
    where = []
    for p in doc["where"]:
        _keys(p, {"field", "op", "value"})
        _need(p["field"] in fields, f"{name}: unknown field {p['field']!r}")
        _need(p["op"] in ("eq", "in", "exists"), f"{name}: unknown operator {p['op']!r}")
        if p["op"] == "exists":
            _need(p["value"] is True, f"{name}: exists takes true")
            where.append((p["field"], "exists", (True,)))
            continue
        values = p["value"] if p["op"] == "in" else [p["value"]]
        _need(isinstance(values, list) and 1 <= len(values) <= MAX["values"] and all(isinstance(v, (str, int)) and not isinstance(v, bool) and v != "" for v in values), f"{name}: plain values")
        where.append((p["field"], "in", tuple(dict.fromkeys(values))))
    fields = {w[0] for w in where}
    _need(len(fields) == len(where), f"{name}: a field repeats")
    if doc["source"] == "event":
        _need("source_type" in fields and fields & {"event_category", "event_action", "event_code"}, f"{name}: an event selector needs source_type and a category, action or code")
    return Selector(doc["source"], tuple(sorted(where, key=lambda w: w[0])))


def compile_correlation(doc: dict) -> CorrelationRule:
    _keys(doc, {"schema", "id", "version", "title", "window", "allowed_lateness", "group_by", "selectors", "correlate", "incident", "mitre"}, {"status", "description", "false_positives"})
    _need(doc["schema"] == "wardstone-correlation/v1", "unknown schema")
    _need(isinstance(doc["id"], str) and re.fullmatch(r"[a-z0-9][a-z0-9-]{2,127}", doc["id"]) is not None, "bad id")
    try:
        window, late = duration_seconds(str(doc["window"])), duration_seconds(str(doc["allowed_lateness"]))
    except ValueError as e:
        raise CorrelationError(str(e)) from e
    _need(1 <= window <= MAX["window"] and late <= MAX["lateness"], "window or lateness out of bounds")
    group = doc["group_by"]
    _need(isinstance(group, list) and 1 <= len(group) <= MAX["groups"] and len(set(group)) == len(group) and set(group) <= GROUP_FIELDS, "bad group_by")
    _need(isinstance(doc["selectors"], dict) and 1 <= len(doc["selectors"]) <= MAX["selectors"], "bad selectors")
    selectors = {n: _selector(n, s) for n, s in doc["selectors"].items()}
    c = doc["correlate"]
    _need(isinstance(c, dict) and c.get("type") in ("threshold", "sequence", "join"), "unknown correlation")
    threshold, stages, require, relations = None, (), (), ()
    if c["type"] == "threshold":
        _keys(c, {"type", "selector", "min_count"}, {"distinct_by", "min_distinct"})
        _need(c["selector"] in selectors and selectors[c["selector"]].source == "detection", "a threshold counts detections")
        n = _int(c["min_count"], 2, MAX["threshold"], "min_count")
        _need(("distinct_by" in c) == ("min_distinct" in c), "distinct_by and min_distinct go together")
        distinct = _int(c["min_distinct"], 2, n, "min_distinct") if "distinct_by" in c else 1
        _need(c.get("distinct_by", "rule_id") in DETECTION_FIELDS, "unknown distinct_by")
        threshold = {"selector": c["selector"], "min_count": n, "distinct_by": c.get("distinct_by"), "min_distinct": distinct}
        used = {c["selector"]}
    elif c["type"] == "sequence":
        _keys(c, {"type", "stages"})
        _need(isinstance(c["stages"], list) and 2 <= len(c["stages"]) <= MAX["stages"], "2 to 4 stages")
        for s in c["stages"]:
            _keys(s, {"selector", "min_count"})
            _need(s["selector"] in selectors, "unknown selector of a stage")
        stages = tuple((s["selector"], _int(s["min_count"], 1, MAX["stage"], "min_count")) for s in c["stages"])
        _need(len({s for s, _ in stages}) == len(stages), "a selector is the stage of one step only")
        _need(sum(k for _, k in stages) <= MAX["threshold"], f"a sequence has at most {MAX['threshold']} inputs")
        _need(any(selectors[s].source == "detection" for s, _ in stages), "a sequence needs a detection stage")
        used = {s for s, _ in stages}
    else:
        _keys(c, {"type", "require", "relations"})
        require = tuple(c["require"])
        _need(2 <= len(require) <= 3 and len(set(require)) == len(require) and set(require) <= set(selectors), "2 or 3 required selectors")
        sources = [selectors[r].source for r in require]
        _need("detection" in sources and sources.count("event") <= 1, "a join needs a detection and has one event at most")
        _need(isinstance(c["relations"], list) and 1 <= len(c["relations"]) <= MAX["relations"], "1 to 4 relations")
        out = []
        for r in c["relations"]:
            _keys(r, {"left", "op", "right"})
            (a, _, f), (b, _, g) = r["left"].partition("."), r["right"].partition(".")
            _need(a in require and b in require and a != b and f in RELATION_FIELDS and g in RELATION_FIELDS, f"bad relation {r}")
            sets = {"ip_set", "local_ip_set"}
            _need(r["op"] in ("equals", "intersects") and (r["op"] == "intersects") == (f in sets and g in sets) and ((f in sets) == (g in sets)), f"bad relation {r}")
            out.append((a, f, r["op"], b, g))
        relations, used = tuple(out), set(require)
        _need({x for r in relations for x in (r[0], r[3])} == set(require), "a required selector has no relation")
    _need("shared_ip" not in group or any(r[2] == "intersects" for r in relations), "shared_ip needs an intersects relation")
    _need(used == set(selectors), f"unused selectors: {sorted(set(selectors) - used)}")
    i = _keys(doc["incident"], {"type", "title", "severity", "confidence", "primary"})
    _need(i["severity"] in SEVERITY, "unknown severity")
    _int(i["confidence"], 0, 100, "confidence")
    _need(set(re.findall(r"\{([^}]*)\}", i["title"])) <= set(group) | set(i["primary"].values()), "title names unknown fields")
    m = _keys(doc["mitre"], {"tactic_ids", "technique_ids"})
    return CorrelationRule(doc["id"], _int(doc["version"], 1, 2**31, "version"), doc["title"], c["type"], window * 1000, late * 1000, tuple(group), selectors, threshold, stages, require, relations, i, tuple(m["tactic_ids"]), tuple(m["technique_ids"]))


def ruleset_fingerprint(rules: list) -> str:
    """Changes with anything that decides results, of any rule."""
    return hashlib.sha256("\0".join(sorted(json.dumps(r.plan(), sort_keys=True, default=str) for r in rules)).encode()).hexdigest()

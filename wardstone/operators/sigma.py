"""Sigma-style rules compiled to columns: fail-closed parsing, all rules in one scan, deterministic detection ids."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attack import tags

#: Rule field names and the columns they stand for (looked up without regard to case).
FIELDS = {
    "EventID": "event_id", "EventCode": "event_code", "Category": "event_category", "Action": "event_action", "EventKind": "event_kind", "Platform": "platform", "Vendor": "vendor", "Product": "product", "SourceType": "source_type",
    "Computer": "host_name", "Hostname": "host_name", "User": "user_name", "UserId": "user_id", "Image": "process_path", "ProcessName": "process_name", "CommandLine": "command_line", "ParentImage": "parent_process_name",
    "ParentProcessId": "parent_process_id", "Service": "service_name", "Outcome": "outcome", "Severity": "severity", "SourceIp": "source_ip", "SourcePort": "source_port", "DestinationIp": "destination_ip", "DestinationPort": "destination_port",
    "DestinationHostname": "destination_hostname", "Protocol": "protocol", "QueryName": "domain", "Domain": "domain", "Signature": "signature", "SignatureId": "signature_id", "Url": "url", "NetworkDirection": "network_direction",
    "IngestionProtocol": "ingestion_protocol", "IngestionPath": "ingestion_path", "SyslogApplication": "syslog_application", "SyslogFacility": "syslog_facility",
}
#: What a rule's logsource asks of a row.
LOGSOURCE = {
    "product": {"windows": ("platform", "windows"), "linux": ("platform", "linux"), "network": ("platform", "network")},
    "service": {"sysmon": ("source_type", "windows_sysmon"), "linux_auditd": ("source_type", "linux_auditd"), "linux_journald": ("source_type", "linux_journald"), "suricata": ("source_type", "suricata_eve")},
}
LEVELS = ("informational", "low", "medium", "high", "critical")
OPERATORS = ("exact", "contains", "startswith", "endswith", "exists")
ROOT_KEYS = {"title", "id", "status", "description", "references", "author", "date", "modified", "tags", "logsource", "detection", "falsepositives", "level"}


class RuleError(ValueError):
    """A rule that is not understood in full is rejected as a whole."""


@dataclass(frozen=True)
class Predicate:
    """One field of a selection: any of the values by one operator."""

    column: str
    operator: str
    values: tuple

    def test(self, c: Column) -> Column:
        if self.operator == "exists":
            there = c.isNotNull() & (c.cast("string") != "")
            return there == F.lit(self.values[0])
        folded = F.lower(c.cast("string"))

        def one(v):
            if self.operator == "exact":
                return folded == v.lower() if isinstance(v, str) else F.when(F.lit(isinstance(v, bool)), c.cast("string") == str(v).lower()).otherwise(c.cast("string") == str(v))
            return {"contains": folded.contains, "startswith": folded.startswith, "endswith": folded.endswith}[self.operator](str(v).lower())

        return F.coalesce(reduce(lambda a, b: a | b, map(one, self.values)), F.lit(False))

    def matches(self, value) -> bool:
        """The same for one value, in Python (tests and dry runs)."""
        if self.operator == "exists":
            return (value is not None and value != "") == self.values[0]
        if value is None:
            return False
        for v in self.values:
            if self.operator == "exact":
                if (str(value).lower() == str(v).lower()) if isinstance(v, str) or isinstance(value, str) else value == v:
                    return True
            elif {"contains": str.__contains__, "startswith": str.startswith, "endswith": str.endswith}[self.operator](str(value).lower(), str(v).lower()):
                return True
        return False


@dataclass
class Rule:
    id: str
    title: str
    level: str
    selections: dict[str, list[Predicate]]
    condition: tuple
    logsource: list[tuple[str, str]]
    version: str = "1"
    description: str = ""
    status: str = ""
    tags: list[str] = field(default_factory=list)

    def selection(self, name: str, col: Callable[[str], Column]) -> Column:
        return reduce(lambda a, b: a & b, [p.test(col(p.column)) for p in self.selections[name]])

    def column(self, col: Callable[[str], Column] = F.col) -> Column:
        """Whether a row matches; never null."""

        def walk(node) -> Column:
            kind = node[0]
            if kind == "name":
                return self.selection(node[1], col)
            if kind == "not":
                return ~walk(node[1])
            parts = [walk(n) for n in node[1]]
            return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), parts)

        source = [F.coalesce(F.lower(col(c)) == v, F.lit(False)) for c, v in self.logsource]
        return reduce(lambda a, b: a & b, [*source, walk(self.condition)])

    def matches(self, row: dict) -> bool:
        def walk(node) -> bool:
            if node[0] == "name":
                return all(p.matches(row.get(p.column)) for p in self.selections[node[1]])
            if node[0] == "not":
                return not walk(node[1])
            return (all if node[0] == "and" else any)(walk(n) for n in node[1])

        return all(str(row.get(c) or "").lower() == v for c, v in self.logsource) and walk(self.condition)

    def evidence(self, col: Callable[[str], Column] = F.col) -> Column:
        """map of the fields of all selections that hold, by name."""
        entries = [F.when(self.selection(n, col), F.array(*[F.struct(F.lit(p.column).alias("k"), F.coalesce(col(p.column).cast("string"), F.lit("")).alias("v")) for p in ps])).otherwise(F.array().cast("array<struct<k:string,v:string>>")) for n, ps in sorted(self.selections.items())]
        return F.map_from_entries(F.array_sort(F.array_distinct(F.concat(*entries))))

    def plan(self) -> dict:
        """What the rule compiled to, for people and for fingerprints."""
        return {"id": self.id, "level": self.level, "version": self.version, "logsource": self.logsource, "selections": {n: [(p.column, p.operator, list(p.values)) for p in ps] for n, ps in sorted(self.selections.items())}, "condition": self.condition}


_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9_*]+)")


def parse_condition(text: str, names: list[str]) -> tuple:
    """or < and < not < parentheses; ``1 of`` and ``all of`` with ``them`` or ``prefix*``."""
    if not isinstance(text, str) or len(text) > 512:
        raise RuleError("condition must be text of at most 512 characters")
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise RuleError(f"condition not understood at {text[at:]!r}")
        tokens.append(m[1])
        at = m.end()
    tokens.reverse()

    def word() -> str:
        return tokens[-1].lower() if tokens else ""

    def chain(keyword: str, below) -> tuple:
        parts = [below()]
        while word() == keyword:
            tokens.pop()
            parts.append(below())
        return parts[0] if len(parts) == 1 else (keyword, parts)

    def negated() -> tuple:
        if word() == "not":
            tokens.pop()
            return ("not", negated())
        return atom()

    def atom() -> tuple:
        if not tokens:
            raise RuleError("condition ends too early")
        t = tokens.pop()
        if t == "(":
            inner = either()
            if not tokens or tokens.pop() != ")":
                raise RuleError("parenthesis not closed")
            return inner
        if t.lower() in ("1", "all") and word() == "of":
            tokens.pop()
            target = tokens.pop() if tokens else ""
            found = sorted(names if target.lower() == "them" else [n for n in names if target.endswith("*") and n.startswith(target[:-1])])
            if not found:
                raise RuleError(f"no selection fits {target!r}")
            return ("name", found[0]) if len(found) == 1 else ("or" if t == "1" else "and", [("name", n) for n in found])
        if t not in names:
            raise RuleError(f"unknown selection {t!r}")
        return ("name", t)

    def both() -> tuple:
        return chain("and", negated)

    def either() -> tuple:
        return chain("or", both)

    tree = either()
    if tokens:
        raise RuleError(f"condition goes on with {tokens[-1]!r}")
    return tree


def compile_rule(doc: dict, fields: dict[str, str] = FIELDS, logsource: dict = LOGSOURCE) -> Rule:
    """A rule from its parsed document; anything unknown is an error."""
    if not isinstance(doc, dict) or set(doc) - ROOT_KEYS:
        raise RuleError(f"unknown keys: {sorted(set(doc) - ROOT_KEYS) if isinstance(doc, dict) else doc!r}")
    for key in ("title", "id", "level", "logsource", "detection"):
        if not doc.get(key):
            raise RuleError(f"{key} is missing")
    if doc["level"] not in LEVELS:
        raise RuleError(f"unknown level {doc['level']!r}")
    found = {k.lower(): v for k, v in fields.items()}
    sources = []
    for key, value in doc["logsource"].items():
        if key not in logsource or value not in logsource[key]:
            raise RuleError(f"unknown logsource {key}: {value}")
        sources.append(logsource[key][value])
    detection = dict(doc["detection"])
    condition = detection.pop("condition", None)
    if "timeframe" in detection or not detection:
        raise RuleError("a detection has selections and a condition, no timeframe")
    selections = {}
    for name, body in detection.items():
        if not isinstance(body, dict) or not body:
            raise RuleError(f"selection {name} must be a mapping")
        predicates = []
        for key, value in body.items():
            column, _, operator = key.partition("|")
            operator = operator or "exact"
            if operator not in OPERATORS:
                raise RuleError(f"unknown modifier {operator!r}")
            if column.lower() not in found:
                raise RuleError(f"unknown field {column!r}")
            values = value if isinstance(value, list) else [value]
            if not values or any(isinstance(v, (dict, list)) or v is None for v in values):
                raise RuleError(f"{key} needs plain values")
            if operator == "exists" and (len(values) != 1 or not isinstance(values[0], bool)):
                raise RuleError("exists takes true or false")
            if operator in ("contains", "startswith", "endswith") and not all(isinstance(v, str) and v for v in values):
                raise RuleError(f"{operator} takes texts that are not empty")
            if any(isinstance(v, str) and re.search(r"[*?]", v) for v in values):
                raise RuleError("wildcards are not part of the language")
            predicates.append(Predicate(found[column.lower()], operator, tuple(values)))
        selections[name] = predicates
    tree = parse_condition(condition, list(selections))
    return Rule(str(doc["id"]), doc["title"], doc["level"], selections, tree, sources, str(doc.get("modified") or doc.get("date") or "1"), doc.get("description", ""), doc.get("status", ""), list(doc.get("tags") or []))


def compile_rules(docs: list[dict], **options) -> list[Rule]:
    rules = [compile_rule(d, **options) for d in docs]
    if len({r.id for r in rules}) != len(rules):
        raise RuleError("rule ids repeat")
    return rules


def columns_of(rules: list[Rule]) -> list[str]:
    """The event columns that the rules read."""
    found: set[str] = set()

    def col(name: str) -> Column:
        found.add(name)
        return F.col(name)

    for r in rules:
        r.column(col)
        r.evidence(col)
    return sorted(found)


def settled(events: DataFrame, columns: list[str]) -> DataFrame:
    """Those columns of computed events, each made once per row: a generator keeps the optimizer from putting their whole expressions into every condition of every rule,
    of which the driver would hold the plan many times. Stored events need none of it; it would keep conditions from their scan."""
    have = [c for c in events.columns if c in set(columns)]
    return events.select(F.explode(F.array(F.struct(*have))).alias("event")).select("event.*")


def detect(events: DataFrame, rules: list[Rule], uid: str = "event_uid", keep: list[str] | None = None) -> DataFrame:
    """A row for each event and rule that matches, from one scan of the events.

    Columns: detection_id (SHA-256 of rule id, NUL and event uid), rule_id, rule_name, rule_version, severity, mitre_tactics, mitre_techniques,
    mitre_technique_ids, source_event_uid, evidence_json and the kept event columns (default: all).
    """
    have = set(events.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    options = []
    for r in rules:
        tactics, techniques, ids = tags(r.tags)
        options.append(F.when(r.column(col), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.title).alias("rule_name"), F.lit(r.version).alias("rule_version"), F.lit(r.level).alias("severity"), texts(tactics).alias("mitre_tactics"), texts(techniques).alias("mitre_techniques"), texts(ids).alias("mitre_technique_ids"), F.to_json(r.evidence(col)).alias("evidence_json"))))
    kept = [c for c in (events.columns if keep is None else keep) if c not in ("rule_id", "rule_name", "rule_version", "severity", "mitre_tactics", "mitre_techniques", "mitre_technique_ids", "evidence_json")]
    hit = F.explode(F.filter(F.array(*options), lambda x: x.isNotNull()))
    some = reduce(lambda a, b: a | b, [r.column(col) for r in rules], F.lit(False))  # goes down to the scan, so that what follows, identities too, is of matches only
    out = events.where(some).select(*kept, F.col(uid).alias("source_event_uid"), hit.alias("hit"))
    return out.select(F.sha2(F.concat(F.col("hit.rule_id"), F.lit("\0"), F.col("source_event_uid")), 256).alias("detection_id"), "hit.*", "source_event_uid", *[c for c in kept if c != "source_event_uid"])

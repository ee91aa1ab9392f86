"""Incidents: correlation rules evaluated over typed inputs, with a decision for every candidate.

``evaluate(rule, inputs)`` gives one decision per candidate and the members that it adds; ``links`` and ``incident_table`` recompute incidents from them.
Inputs that are invalid, fit no selector or lack a part of the group are decided by columns. The others are dealt by group and, within a group, by segment:
a pause longer than the window starts a new one, since no set and no episode crosses it. A segment is read in the order (occurred, kind, id) and holds the inputs
of one window and the open episodes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon
from . import collapse, correlate
from .correlation_rules import CorrelationRule
from .episodes import Episode, GroupState, Input, JoinGroup, JoinSets, Side
from .range_join import range_join, span_ok

FIELDS = ("rule_id", "rule_version", "rule_name", "severity", "platform", "vendor", "product", "source_type", "host_name", "user_name", "user_id", "source_ip", "destination_ip", "protocol", "signature", "signature_id", "event_code", "event_category", "event_action", "event_kind", "service_name", "outcome", "initiated", "validation_id")
_MEMBERS = "array<struct<kind:string,id:string,role:string>>"
_FIELDS = ("input_kind string", "input_id string", "group_json string", "action string", "lateness string", "reason string", "incident_id string", "episode_start_ms long", "episode_end_ms long", "late_accept_until_ms long", "anchor_kind string", "anchor_id string", "anchor_ms long", "collision_count int", f"members {_MEMBERS}", "partial array<string>", "partial_start_ms long")
DECISION = ", ".join(_FIELDS)
_NAMES = [f.split()[0] for f in _FIELDS]
_CANONICAL = ("host_name", "user_name", "source_ip", "destination_ip", "platform")


def inputs_of(df: DataFrame) -> DataFrame:
    """Typed inputs from rows with any of FIELDS: missing columns are null, physical duplicates collapse, conflicting ones get an invalid_reason."""
    have = [f for f in (*FIELDS, "mitre_technique_ids") if f in df.columns]  # those that are null everywhere tell no rows apart
    aligned = df.select("input_kind", "input_id", "occurred_at", "observed_at", *[(F.col(f).cast("string") if f in FIELDS else F.col(f)).alias(f) for f in have])
    one = collapse.logical_source(aligned.withColumn("key", F.concat_ws("\0", "input_kind", F.coalesce("input_id", F.lit("")))), "key", "occurred_at", "observed_at", ["input_kind", "input_id", *have])
    given = {f: F.lit(None).cast("string") for f in FIELDS} | {"mitre_technique_ids": F.array().cast("array<string>")} | {f: F.col(f) for f in have}
    one = one.select("key", "occurred_at", "input_kind", "input_id", *[c.alias(f) for f, c in given.items()], "observed_at", "variants", "copies", "invalid_reason")
    blank = F.when(F.trim(F.coalesce("input_id", F.lit(""))) == "", "blank_input_id")
    return one.withColumn("invalid_reason", F.coalesce(blank, "invalid_reason")).drop("key")


def canonical(unicode_rules: bool = True) -> dict[str, Column]:
    principal = canon.canonical_principal(F.col("user_name"), F.col("platform"), unicode_rules)
    return {"host_name": canon.canonical_host(F.col("host_name")), "user_name": F.when(principal.isNotNull(), F.to_json(principal)), "source_ip": canon.canonical_ip(F.col("source_ip")), "destination_ip": canon.canonical_ip(F.col("destination_ip")), "platform": F.lower(F.trim("platform"))}


def _prepared(inputs: DataFrame, used: set[str] = frozenset(_CANONICAL)) -> tuple[DataFrame, dict[str, Column]]:
    """inputs with those of their canonical fields that are used in the struct ``canonical``, and those by field. A generator keeps the optimizer from repeating the expressions at each use."""
    fields = F.explode(F.array(F.struct(*[c.alias(k) for k, c in canonical().items() if k in used]))).alias("canonical")
    return inputs.select("*", fields), {k: F.col(f"canonical.{k}") for k in _CANONICAL if k in used}


def _used(rule: CorrelationRule) -> set[str]:
    """The canonical fields that a rule looks at."""
    sides = {f for r in rule.relations for f in (r[1], r[4])} | {w[0] for s in rule.selectors.values() for w in s.where} | set(rule.group_by) | {rule.threshold["distinct_by"] if rule.threshold else None}
    addresses = {"source_ip", "destination_ip"} if sides & {"ip_set", "local_ip_set", "shared_ip"} else set()
    return {"platform"} | addresses | (sides & set(_CANONICAL))


def grouped(inputs: DataFrame, rule: CorrelationRule) -> DataFrame:
    """inputs with their roles, the group of the rule (null where a part is missing) and clocks in milliseconds."""
    rows, canonical_columns = _prepared(inputs, _used(rule))
    roles = F.filter(F.array(*[F.when(s.column(canonical_columns), F.lit(n)) for n, s in rule.selectors.items()]), lambda x: x.isNotNull())
    by = rule.threshold["distinct_by"] if rule.threshold else None
    distinct = canonical_columns.get(by, F.col(by)) if by else F.lit(None).cast("string")
    group = canon.group_json({g: canonical_columns.get(g, F.col(g)) for g in rule.group_by if g != "shared_ip"}) if set(rule.group_by) != {"shared_ip"} else F.lit("{}")
    chosen = F.coalesce(F.array_max(F.array(*[s.holds(canonical_columns) for s in rule.selectors.values()])), F.lit(False))
    return rows.withColumns({"roles": roles, "group_json": group, "candidate": (F.col("input_kind") == "detection") | chosen, "distinct_value": distinct.cast("string"), "occurred_ms": F.unix_millis(F.col("occurred_at").cast("timestamp")), "observed_ms": F.unix_millis(F.col("observed_at").cast("timestamp"))})


def _decided(rows: DataFrame, rule: CorrelationRule) -> DataFrame:
    """Decisions that need no other input: invalid ones, and those without a role or a group."""
    late = F.col("observed_ms") > F.col("occurred_ms") + rule.window_ms + rule.lateness_ms
    bad = F.col("invalid_reason").isNotNull()
    given = {
        "input_kind": F.col("input_kind"), "input_id": F.col("input_id"), "group_json": F.col("group_json"), "action": F.when(bad, "invalid_input").otherwise("no_match"), "lateness": F.when(~bad & late, "late_outside_boundary").otherwise("not_applicable"),
        "reason": F.when(bad, F.col("invalid_reason")).when(late, "outside_reconciliation_horizon").otherwise("condition_not_satisfied"), "members": F.array().cast(_MEMBERS), "partial": F.array().cast("array<string>"),
    }
    return rows.select(*[given.get(f.split()[0], F.lit(None)).cast(f.split(" ", 1)[1]).alias(f.split()[0]) for f in _FIELDS])


def segmented(rows: DataFrame, at: str, window_ms: int, by: str = "group_json") -> DataFrame:
    """rows with ``segment``: the time of the first row after a pause of the group that is longer than the window."""
    w = Window.partitionBy(by).orderBy(at)
    before = F.lag(at).over(w)
    fresh = F.when(before.isNull() | (F.col(at) - before > window_ms), F.col(at))
    return rows.withColumn("fresh_segment", fresh).withColumn("segment", F.max("fresh_segment").over(w)).drop("fresh_segment")


def _states(rule: CorrelationRule, states, closures) -> list[Episode]:
    return [Episode(e["incident_id"], e["start"], e["end"], e["deadline"], (e["anchor_kind"], e["anchor_id"]), e["anchor_at"], (closures or {}).get(e["incident_id"]), e["collisions"], {(m["kind"], m["id"]): m["role"] for m in e["members"]}) for e in states if e is not None] if states is not None else []


def _run(rule: CorrelationRule, tuples: bool, apart: bool = False):
    """One pass over sorted segments. Rows with fresh = false were evaluated before: they are context, on both sides of an input."""

    def closed(r) -> dict:
        return {c["incident_id"]: c["closed_ms"] for c in r.closed} if r.closed is not None else {}

    def decide(state: GroupState, c: Input, sets, later) -> dict:
        try:
            return state.add(c, sets, later)
        except (ValueError, TypeError, KeyError, IndexError, OverflowError) as e:  # of one input: it stays to be evaluated, the others go on
            return state._decision(c, None, "failed", "not_applicable", f"{type(e).__name__}: {e}"[:200])

    def segments(batches: Iterator[pd.DataFrame]):
        key, rows = None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.group_json, r.segment) != key:
                    if rows:
                        yield key[0], rows
                    key, rows = (r.group_json, r.segment), []
                rows.append(r)
        if rows:
            yield key[0], rows

    def incremental(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, rows in segments(batches):
            state = GroupState(rule, group, closed(rows[0]), _states(rule, rows[0].states, closed(rows[0])))
            items, out = [_input(r) for r in rows], []
            seen = [p for p in items if not p.fresh]
            clocks, passed = [p.occurred for p in seen], 0
            for c in items:
                if c.fresh:
                    later = seen[passed : bisect_right(clocks, c.occurred + rule.window_ms)]
                    out.append(decide(state, c, None, later) | {"group_json": group})
                else:
                    passed += 1
                    state.seen(c)
            yield pd.DataFrame(out, columns=_NAMES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.group_json, r.segment) != key:
                    key = (r.group_json, r.segment)
                    state = GroupState(rule, key[0], closed(r), apart=apart)
                if tuples:
                    members = sorted((Input(m["kind"], m["id"], int(m["occurred"]), int(m["observed"]), ("member",)) for m in r.found), key=lambda m: m.order)
                    out.append(decide(state, members[-1], [members], ()) | {"group_json": key[0]})
                else:
                    out.append(decide(state, _input(r), None, ()) | {"group_json": key[0]})
            yield pd.DataFrame(out, columns=_NAMES)

    return run, incremental


def _input(r) -> Input:
    return Input(r.input_kind, r.input_id, int(r.occurred_ms), int(r.observed_ms), tuple(r.roles), r.distinct_value, bool(r.fresh))


def _with_closures(rows: DataFrame, closures: DataFrame | None) -> DataFrame:
    """rows with ``closed``: the closures (incident_id, group_json, closed_ms) of their group."""
    if closures is None:
        return rows.withColumn("closed", F.lit(None).cast("array<struct<incident_id:string,closed_ms:bigint>>"))
    return rows.join(closures.groupBy("group_json").agg(F.collect_list(F.struct("incident_id", F.col("closed_ms").cast("bigint").alias("closed_ms"))).alias("closed")), "group_json", "left")


def _ip_sets(columns: dict[str, Column]) -> dict[str, Column]:
    able = lambda *cs: F.array_distinct(F.filter(F.array(*cs), lambda x: x.isNotNull() & canon.ownable(x)))
    return {"ip_set": able(columns["source_ip"], columns["destination_ip"]), "local_ip_set": able(columns["source_ip"])}


def join_tuples(inputs: DataFrame, rule: CorrelationRule) -> DataFrame:
    """(group_json, found, last_ms) of all sets of required inputs within the window whose relations hold; by band joins on the relations' keys."""
    rows = grouped(inputs, rule)
    canonical_columns = {k: F.col(f"canonical.{k}") for k in _used(rule)}
    canonical_columns |= _ip_sets(canonical_columns)
    sides, meets = {}, next((r for r in rule.relations if r[2] == "intersects"), None)
    for n in rule.require:
        part = rows.where(F.array_contains("roles", n))
        fields = {f for r in rule.relations for a, f in ((r[0], r[1]), (r[3], r[4])) if a == n} | {g for g in rule.group_by if g != "shared_ip"}
        own = F.struct(F.col("input_kind").alias("kind"), F.col("input_id").alias("id"), F.col("occurred_ms").alias("occurred"), F.col("observed_ms").alias("observed"))
        sides[n] = part.select(own.alias(f"{n}_in"), F.col("occurred_at").cast("timestamp").alias(f"{n}_at"), *[canonical_columns.get(f, F.col(f)).alias(f"{n}_{f}") for f in sorted(fields)])
    done = [rule.require[0]]
    out = sides[done[0]]
    left = [r for r in rule.relations]
    while len(done) < len(rule.require):
        r = next((r for r in left if (r[0] in done) != (r[3] in done)), None)
        a, f, op, b, g = r if r[0] in done else (r[3], r[4], r[2], r[0], r[1])
        left.remove(r)
        new = sides[b]
        if op == "intersects":  # explode both sets: an equi-join on members, the least shared address last
            l, m = out.withColumn("_k", F.explode(f"{a}_{f}")), new.withColumn("_k", F.explode(f"{b}_{g}"))
        else:
            l, m = out.withColumn("_k", F.col(f"{a}_{f}").cast("string")), new.withColumn("_k", F.col(f"{b}_{g}").cast("string"))
        out = range_join(l, m, ["_k"], f"{a}_at", f"{b}_at", rule.window_ms)
        out = out.withColumnRenamed("_k", "shared_ip") if op == "intersects" else out.drop("_k")
        done.append(b)
    for a, f, op, b, g in left:
        both = F.arrays_overlap(f"{a}_{f}", f"{b}_{g}") if op == "intersects" else F.col(f"{a}_{f}") == F.col(f"{b}_{g}")
        out = out.where(both)
    out = out.where(span_ok([F.col(f"{n}_at") for n in rule.require], rule.window_ms))
    ins = [F.col(f"{n}_in") for n in rule.require]
    out = out.where(F.size(F.array_distinct(F.array(*[F.struct(i["kind"], i["id"]) for i in ins]))) == len(ins))
    related = {(r[0], r[1]): True for r in rule.relations} | {(r[3], r[4]): True for r in rule.relations}
    groups = {}
    for name in rule.group_by:
        if name == "shared_ip":
            groups[name] = F.col("shared_ip")
        else:
            first = [n for n in rule.require if (n, name) in related] or list(rule.require)
            groups[name] = F.coalesce(*[F.col(f"{n}_{name}") for n in first])
    found = F.array(*ins)
    if meets is not None:
        keys = [i for n in rule.require for i in (F.col(f"{n}_in.kind").alias(f"{n}_k"), F.col(f"{n}_in.id").alias(f"{n}_i"))]
        out = out.groupBy(*keys).agg(F.min_by(F.struct(*out.columns), "shared_ip").alias("r")).select("r.*")
    return out.select(canon.group_json(groups).alias("group_json"), found.alias("found"), F.array_max(F.transform(found, lambda i: i["occurred"])).alias("last_ms")).where("group_json IS NOT NULL")


def parts_of_roles(rule: CorrelationRule) -> dict[str, list[str]] | None:
    """The parts of the group that each required selector's inputs have, if the sets of a group are all combinations of its inputs within the window, else None: relations are equal parts, and
    addresses that meet one local address at most, and some selector has all parts."""
    meets = [r for r in rule.relations if r[2] == "intersects"]
    equal = [r for r in rule.relations if r[2] == "equals"]
    if len(meets) != 1 or "local_ip_set" not in (meets[0][1], meets[0][4]) or any(r[1] != r[4] for r in equal) or {r[1] for r in equal} | {"shared_ip"} != set(rule.group_by):
        return None
    has = {n: [g for g in rule.group_by if (n in (meets[0][0], meets[0][3]) if g == "shared_ip" else any(r[1] == g and n in (r[0], r[3]) for r in equal))] for n in rule.require}
    joined = all(len([r for r in equal if r[1] == g]) >= sum(g in p for p in has.values()) - 1 for g in rule.group_by if g != "shared_ip")
    return has if joined and any(len(p) == len(rule.group_by) for p in has.values()) else None


def _sides(inputs: DataFrame, rule: CorrelationRule, has: dict[str, list[str]], keep: Callable[[DataFrame], DataFrame], more: dict[str, Column]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The inputs of each selector with the parts of the group that they have, their role (the number of the selector) and the columns more; and the groups that lack no selector."""
    columns = {k: F.col(f"canonical.{k}") for k in _used(rule)}
    columns |= _ip_sets(columns)
    meets = next(r for r in rule.relations if r[2] == "intersects")
    ips = {meets[0]: meets[1], meets[3]: meets[4]}
    fields = [columns.get(f, F.col(f)).alias(f"own_{f}") for f in sorted({g for g in rule.group_by if g != "shared_ip"} | set(ips.values()))]
    rows = keep(grouped(inputs, rule).where(F.size("roles") > 0).select("input_kind", "input_id", "occurred_ms", "observed_ms", "roles", *[c.alias(k) for k, c in more.items()], *fields))
    sides = {}
    for i, n in enumerate(rule.require):
        parts = [(F.explode(f"own_{ips[n]}") if g == "shared_ip" else F.col(f"own_{g}").cast("string")).alias(f"part_{g}") for g in has[n]]
        sides[n] = rows.where(F.array_contains("roles", n)).select("input_kind", "input_id", "occurred_ms", "observed_ms", F.lit(i).alias("role"), *more, *parts).dropna(subset=[f"part_{g}" for g in has[n]])
    base = next(n for n in rule.require if len(has[n]) == len(rule.group_by))
    groups = sides[base].select(*[f"part_{g}" for g in rule.group_by]).distinct()
    for n in rule.require:  # groups that lack a selector have no set
        if n != base:
            groups = groups.join(sides[n].select(*[f"part_{g}" for g in has[n]]).distinct(), [f"part_{g}" for g in has[n]], "left_semi")
    return sides, groups


def join_inputs(inputs: DataFrame, rule: CorrelationRule, has: dict[str, list[str]], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The inputs of a join by group: group_json, input_kind, input_id, occurred_ms, observed_ms, role (the number of the selector). has: parts_of_roles."""
    sides, groups = _sides(inputs, rule, has, keep, {})
    out = None
    for n in rule.require:
        side = sides[n].join(groups, [f"part_{g}" for g in has[n]])
        side = side.select(canon.group_json({g: F.col(f"part_{g}") for g in rule.group_by}).alias("group_json"), "input_kind", "input_id", "occurred_ms", "observed_ms", "role")
        out = side if out is None else out.unionByName(side)
    return out


#: Groups of a hub that go to a task with one copy of what they share.
HUB_GROUPS = 128


def dealt_inputs(inputs: DataFrame, rule: CorrelationRule, has: dict[str, list[str]], keep: Callable[[DataFrame], DataFrame], more: dict[str, Column]) -> DataFrame:
    """The inputs of a join by hub, which is the parts of the group that the selector with the fewest has: hub, segment, bucket, group_json and the columns of an input.

    An input with no more parts than those goes once to each bucket of groups of its hub (its group_json is null), not to each group: an address with m alerts and n hosts is m * n / HUB_GROUPS rows.
    """
    every = list(rule.group_by)
    hub = min((has[n] for n in rule.require), key=len)
    json = lambda gs: canon.group_json({g: F.col(f"part_{g}") for g in gs})
    sides, groups = _sides(inputs, rule, has, keep, more)
    counts = groups.groupBy(*[f"part_{g}" for g in hub]).agg(F.ceil(F.count(F.lit(1)) / HUB_GROUPS).alias("buckets"))
    bucket = F.pmod(F.xxhash64(*[f"part_{g}" for g in every]), F.col("buckets")).cast("int")
    groups = keep(groups.join(counts, [f"part_{g}" for g in hub]).select(*[f"part_{g}" for g in every], json(hub).alias("hub"), json(every).alias("group_json"), "buckets", bucket.alias("bucket")))
    hubs = groups.select(*[f"part_{g}" for g in hub], "hub", "buckets").distinct()
    out = None
    for n in rule.require:
        shared = len(has[n]) == len(hub) < len(every) and set(has[n]) == set(hub)
        side = sides[n].join(hubs if shared else groups, [f"part_{g}" for g in has[n]])
        own = (F.lit(None).cast("string").alias("group_json"), F.lit(None).cast("int").alias("bucket")) if shared else ("group_json", "bucket")
        side = side.select("hub", "buckets", *own, "input_kind", "input_id", "occurred_ms", "observed_ms", "role", *more)
        out = side if out is None else out.unionByName(side)
    out = segmented(out, "occurred_ms", rule.window_ms, "hub")
    buckets = F.when(F.col("bucket").isNull(), F.sequence(F.lit(0), (F.col("buckets") - 1).cast("int"))).otherwise(F.array("bucket"))
    return out.withColumn("bucket", F.explode(buckets)).drop("buckets")


def _chunks(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with the same values of by."""
    key, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        differs = np.zeros(b.num_rows - 1, bool)
        for n in by:
            codes = b.column(n).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            differs |= codes[1:] != codes[:-1]
        cut = np.concatenate([[0], np.flatnonzero(differs) + 1, [b.num_rows]]).tolist()
        for a, z in zip(cut[:-1], cut[1:]):
            own = tuple(b.column(n)[a].as_py() for n in by)
            if own != key and parts:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = own
            parts.append(b.slice(a, z - a))
    if parts:
        yield key, pa.Table.from_batches(parts)


_COUNTS = "incident_id string, group_json string, episode_start_ms long, episode_end_ms long, first_us long, last_us long, profiles array<struct<profile:string,n:bigint>>"


def _counted(rule: CorrelationRule, apart: bool):
    """Incidents with how many members of each profile they have, from dealt_inputs in order."""
    schema = pa.schema([("incident_id", pa.string()), ("group_json", pa.string()), *[(n, pa.int64()) for n in ("episode_start_ms", "episode_end_ms", "first_us", "last_us")], ("profiles", pa.list_(pa.struct([("profile", pa.string()), ("n", pa.int64())])))])
    roles, reach = range(len(rule.require)), rule.window_ms + rule.lateness_ms

    def sides_of(t: pa.Table) -> dict[int, tuple]:
        """Of each role: its Side, the number of each input's profile, the profiles, clocks in microseconds and whether some input has several roles."""
        role, out = t.column("role").to_numpy(), {}
        for r in np.unique(role).tolist():
            at = np.flatnonzero(role == r)
            own = t.slice(int(at[0]), len(at)) if at[-1] - at[0] + 1 == len(at) else t.take(pa.array(at))
            col = lambda n: own.column(n).combine_chunks()  # noqa: B023, E731
            profile = col("profile").dictionary_encode()
            side = Side(col("input_kind").to_pylist(), col("input_id").to_pylist(), col("occurred_ms").to_numpy(), col("observed_ms").to_numpy(), reach)
            out[r] = side, profile.indices.to_numpy(), profile.dictionary.to_pylist(), col("occurred_us").to_numpy(), bool((col("n_roles").to_numpy() > 1).any())
        return out

    def twice(sides: list[Side]) -> bool:
        return len({m for s in sides for m in zip(s.kind, s.id)}) < sum(len(s.id) for s in sides)

    def by_sets(group: str, closures: dict, sides: list[Side]):
        """Episodes and their members by role, of sides that have inputs in common: each such input counts once."""
        rows = sorted((*s.order(i), r, i) for r, s in enumerate(sides) for i in range(len(s.id)))
        joined = JoinGroup(rule, group, closures, apart, [x[1] for x in rows], [x[2] for x in rows], np.array([x[0] for x in rows]), np.array([int(sides[x[3]].observed[x[4]]) for x in rows]), np.array([x[3] for x in rows]))
        found: dict[str, tuple] = {}
        for e, _, members in joined.gains():
            found.setdefault(e.incident, (e, {}))[1].update({rows[m][1:3]: rows[m][3:] for m in members.tolist()})
        for e, members in found.values():
            yield e, [np.array([i for q, i in members.values() if q == r], np.int64) for r in roles]

    def incidents_of(group: str, closures: dict, columns: list[tuple]):
        sides = [c[0] for c in columns]
        if any(c[4] for c in columns) and twice(sides):
            episodes = by_sets(group, closures, sides)
        else:
            episodes = ((e, [np.concatenate(x) for x in zip(a, b)]) for e, a, b in JoinSets(rule, group, closures, apart, sides).gains())
        for e, members in episodes:
            n, first, last = {}, [], []
            for at, (_, codes, profiles, us, _) in zip(members, columns):
                if len(at):
                    for p, k in zip(profiles, np.bincount(codes[at], minlength=len(profiles)).tolist()):
                        if k:
                            n[p] = n.get(p, 0) + k
                    first.append(int(us[at].min()))
                    last.append(int(us[at].max()))
            yield {"incident_id": e.incident, "group_json": group, "episode_start_ms": e.start, "episode_end_ms": e.end, "first_us": min(first), "last_us": max(last), "profiles": [{"profile": p, "n": k} for p, k in n.items()]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shared, rows = None, {}, []
        for (*own, group), t in _chunks(batches, ["hub", "segment", "bucket", "group_json"]):
            if own != key:
                key, shared = own, {}
            if group is None:
                shared = sides_of(t)
                continue
            columns = shared | sides_of(t)
            if len(columns) == len(roles):
                closed = t.column("closed")[0].as_py()
                rows.extend(incidents_of(group, {c["incident_id"]: c["closed_ms"] for c in closed or ()}, [columns[r] for r in roles]))
            if len(rows) > 5000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def join_rollup(rule: CorrelationRule, inputs: DataFrame, closures: DataFrame | None = None, apart: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """incident_table of a join's evaluate(gains=True), but for revision and late_update_count. Where a group's sets are all combinations of its inputs, members are counted by what the table tells of
    them (their profile) where they are found, and no link is written: their number is that of groups times what these share."""
    if (has := parts_of_roles(rule)) is None:
        rows = keep(inputs)
        return incident_table(rule, keep(evaluate(rule, rows, closures, apart, True, keep)), rows).drop("revision", "late_update_count")
    profile = F.to_json(F.struct("input_kind", "severity", "source_type", "rule_id", "mitre_technique_ids"))
    more = {"profile": profile, "occurred_us": F.unix_micros(F.col("occurred_at").cast("timestamp")), "n_roles": F.size("roles")}
    rows = _with_closures(dealt_inputs(inputs, rule, has, keep, more), closures)
    by = ["hub", "segment", "bucket"]
    found = rows.repartition(*by).sortWithinPartitions(*by, F.col("group_json").asc_nulls_first(), "role", "occurred_ms", "input_kind", "input_id").mapInArrow(_counted(rule, apart), _COUNTS)
    told = F.transform("profiles", lambda p: F.struct(F.from_json(p["profile"], "input_kind string, severity string, source_type string, rule_id string, mitre_technique_ids array<string>").alias("of"), p["n"].alias("n")))
    found = found.select("*", F.explode(F.array(told)).alias("told"))
    each = lambda c: F.transform("told", lambda p: c(p["of"]))
    total = lambda keep: F.aggregate(F.filter("told", keep), F.lit(0).cast("bigint"), lambda n, p: n + p["n"])
    distinct = lambda c: F.array_sort(F.array_distinct(F.filter(each(c), lambda x: x.isNotNull())))
    rank = F.greatest(F.lit(correlate.SEVERITY[rule.incident["severity"]]), F.array_max(each(lambda p: correlate.severity_rank(p["severity"]))))
    rules = distinct(lambda p: p["rule_id"])
    return found.select(
        "incident_id", total(lambda p: F.lit(True)).alias("input_count"), total(lambda p: p["of"]["input_kind"] == "detection").alias("detection_count"), total(lambda p: p["of"]["input_kind"] == "event").alias("event_count"), rank.alias("severity_rank"),
        F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen"), F.size(rules).cast("bigint").alias("distinct_rule_count"), F.size(distinct(lambda p: correlate.source_family(p["source_type"]))).cast("bigint").alias("source_family_count"), rules.alias("rule_ids"),
        F.array_sort(F.array_distinct(F.concat(F.flatten(F.filter(each(lambda p: p["mitre_technique_ids"]), lambda x: x.isNotNull())), F.array(*[F.lit(t) for t in rule.techniques]).cast("array<string>")))).alias("mitre_technique_ids"),
        "group_json", "episode_start_ms", "episode_end_ms", correlate.severity_name(rank).alias("severity"), F.lit(rule.incident["confidence"]).alias("confidence"), F.lit(rule.incident["type"]).alias("incident_type"), title(rule).alias("incident_title"), F.lit("new").alias("status"),
    )


def _gains(rule: CorrelationRule, apart: bool):
    """Decisions that add members, from the inputs of join groups in order."""
    schema = pa.schema([("input_kind", pa.string()), ("input_id", pa.string()), ("group_json", pa.string()), ("action", pa.string()), ("lateness", pa.string()), ("reason", pa.string()), ("incident_id", pa.string()), *[(n, pa.int64()) for n in ("episode_start_ms", "episode_end_ms", "late_accept_until_ms")], ("anchor_kind", pa.string()), ("anchor_id", pa.string()), ("anchor_ms", pa.int64()), ("collision_count", pa.int32()), ("members", pa.list_(pa.struct([("kind", pa.string()), ("id", pa.string()), ("role", pa.string())]))), ("partial", pa.list_(pa.string())), ("partial_start_ms", pa.int64())])

    def decided(parts: list[pa.RecordBatch]) -> tuple[list[dict], list[pa.Array]]:
        t = pa.Table.from_batches(parts)
        col = lambda n: t.column(n).combine_chunks()
        group, closed = t.column("group_json")[0].as_py(), t.column("closed")[0].as_py()
        kinds, ids, seen = col("input_kind"), col("input_id"), col("observed_ms").to_numpy()
        state = JoinGroup(rule, group, {c["incident_id"]: c["closed_ms"] for c in closed or ()}, apart, kinds.to_pylist(), ids.to_pylist(), col("occurred_ms").to_numpy(), seen, col("role").to_numpy())
        rows, members = [], []
        for e, action, at in state.gains():
            last = int(at[-1])
            roles = pa.concat_arrays([pa.repeat("supporting", len(at) - 1), pa.array(["trigger" if (state.kind[last], state.id[last]) == e.anchor else "supporting"])])
            members.append(pa.StructArray.from_arrays([kinds.take(pa.array(at)), ids.take(pa.array(at)), roles], ["kind", "id", "role"]))
            rows.append({
                "input_kind": state.kind[last], "input_id": state.id[last], "group_json": group, "action": action, "lateness": "late_within_boundary" if int(seen[last]) > e.end else "on_time", "reason": "matched", "incident_id": e.incident, "episode_start_ms": e.start,
                "episode_end_ms": e.end, "late_accept_until_ms": e.deadline, "anchor_kind": e.anchor[0], "anchor_id": e.anchor[1], "anchor_ms": e.anchor_at, "collision_count": e.collisions, "partial": [],
            })
        return rows, members

    def batch(rows: list[dict], members: list[pa.Array]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, members)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(members))
        return pa.RecordBatch.from_arrays([lists if f.name == "members" else pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, rows, members, size = None, [], [], [], 0

        def close():
            nonlocal size
            if parts:
                a, b = decided(parts)
                rows.extend(a)
                members.extend(b)
                size += sum(map(len, b)) + len(a)

        for b in batches:
            if not b.num_rows:
                continue
            group, segment = b.column("group_json"), b.column("segment").to_numpy()
            differs = np.asarray(pc.not_equal(group[1:], group[:-1])) | (segment[1:] != segment[:-1])
            cut = np.concatenate([[0], np.flatnonzero(differs) + 1, [b.num_rows]])
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
                own = (group[a].as_py(), int(segment[a]))
                if own != key:
                    close()
                    key, parts = own, []
                    if size > 50_000:
                        yield batch(rows, members)
                        rows, members, size = [], [], 0
                parts.append(b.slice(a, z - a))
        close()
        if rows:
            yield batch(rows, members)

    return run


def evaluate(rule: CorrelationRule, inputs: DataFrame, closures: DataFrame | None = None, apart: bool = False, gains: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Decisions (DECISION): one row per candidate, which is every detection and every event that a selector chooses, or per set of a join rule. inputs: inputs_of's rows; closures: (incident_id, group_json, closed_ms). apart: a group's episodes don't overlap.
    gains: of a join, the set that begins an episode and one row for all that later sets add to it: the same incidents and links, but revisions and late updates aren't counted set by set. Sets then aren't made one by one, where a group's are all combinations of its inputs (parts_of_roles). keep stores a table that is read several times."""
    if rule.kind == "join":
        if gains and (has := parts_of_roles(rule)) is not None:
            rows = _with_closures(segmented(join_inputs(inputs, rule, has, keep), "occurred_ms", rule.window_ms), closures)
            return rows.repartition("group_json", "segment").sortWithinPartitions("group_json", "segment", "occurred_ms", "input_kind", "input_id", "role").mapInArrow(_gains(rule, apart), DECISION)
        rows = _with_closures(segmented(join_tuples(inputs, rule), "last_ms", rule.window_ms), closures)
        return rows.repartition("group_json", "segment").sortWithinPartitions("group_json", "segment", "last_ms", F.to_json("found")).mapInPandas(_run(rule, True, apart)[0], DECISION)
    rows = grouped(inputs, rule).where("candidate")
    plain = F.col("invalid_reason").isNotNull() | (F.size("roles") == 0) | F.col("group_json").isNull()
    dealt = segmented(rows.where(~plain).select(*DEALT, F.lit(True).alias("fresh")), "occurred_ms", rule.window_ms)
    ordered = _with_closures(dealt, closures).repartition("group_json", "segment").sortWithinPartitions("group_json", "segment", "occurred_ms", "input_kind", "input_id")
    return ordered.mapInPandas(_run(rule, False, apart)[0], DECISION).unionByName(_decided(rows.where(plain), rule))


DEALT = ("group_json", "input_kind", "input_id", "occurred_ms", "observed_ms", "roles", "distinct_value")


def evaluate_new(rule: CorrelationRule, rows: DataFrame, states: DataFrame, closures: DataFrame | None = None) -> DataFrame:
    """Decisions on the fresh ones of rows (DEALT and fresh), which hold the context of their groups too; states: group_json, states (the open episodes of the group)."""
    dealt = segmented(rows, "occurred_ms", rule.window_ms)
    first = F.col("occurred_ms") == F.col("segment")  # the episodes, with all their members, go with the first rows of a segment only
    dealt = dealt.alias("d").join(states.alias("s"), (F.col("d.group_json") == F.col("s.group_json")) & first, "left").select("d.*", "s.states")
    ordered = _with_closures(dealt, closures).repartition("group_json", "segment").sortWithinPartitions("group_json", "segment", "occurred_ms", "input_kind", "input_id")
    return ordered.mapInPandas(_run(rule, False)[1], DECISION)


def links(decisions: DataFrame) -> DataFrame:
    """incident_id, input_kind, input_id, relationship, link_id: each input once per incident, by its strongest role."""
    m = decisions.select("incident_id", F.explode("members").alias("m"))
    rank = F.when(F.col("m.role") == "trigger", 0).when(F.col("m.role") == "supporting", 1).otherwise(2)
    one = m.groupBy("incident_id", F.col("m.kind").alias("input_kind"), F.col("m.id").alias("input_id")).agg(F.min_by("m.role", rank).alias("relationship"))
    return one.withColumn("link_id", correlate.link_identity(F.col("incident_id"), F.col("input_kind"), F.col("input_id")))


def incident_table(rule: CorrelationRule, decisions: DataFrame, inputs: DataFrame) -> DataFrame:
    """Incidents recomputed from their links: counts, severity, techniques, first and last seen, late updates."""
    rows = links(decisions).join(inputs, ["input_kind", "input_id"])
    rolled = correlate.incident_rollup(rows, "incident_id", correlate.SEVERITY[rule.incident["severity"]])
    techniques = rows.groupBy("incident_id").agg(F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list("mitre_technique_ids")), F.array(*[F.lit(t) for t in rule.techniques]).cast("array<string>")))).alias("mitre_technique_ids"))
    own = decisions.where("action IN ('created', 'updated', 'enriched_closed')").groupBy("incident_id").agg(F.min("group_json").alias("group_json"), F.min("episode_start_ms").alias("episode_start_ms"), F.min("episode_end_ms").alias("episode_end_ms"), F.count_if(F.col("lateness") == "late_within_boundary").alias("late_update_count"), F.count(F.lit(1)).alias("revision"))
    return rolled.join(techniques, "incident_id").join(own, "incident_id").withColumns({"severity": correlate.severity_name(F.col("severity_rank")), "confidence": F.lit(rule.incident["confidence"]), "incident_type": F.lit(rule.incident["type"]), "incident_title": title(rule), "status": F.lit("new")})


def title(rule: CorrelationRule) -> Column:
    out = F.lit(rule.incident["title"])
    for g in rule.group_by:
        value = F.get_json_object("group_json", f"$.{g}")
        if g == "user_name":
            value = canon.display_principal(F.from_json(value, "platform string, namespace string, realm string, account string"))
        out = F.replace(out, F.lit("{" + g + "}"), F.coalesce(value, F.lit("")))
    return out

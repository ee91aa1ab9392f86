"""Episodes of one group of one rule: the least qualifying set of an input, owners, lateness and closure.

Inputs come in the order (occurred, kind, id). Of all sets that hold an input the least by the tags of its members, in order, counts; it is built member by
member, each the least that still leaves a whole set, so nothing is enumerated: a threshold costs one pass over the window, whatever its count.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np

from .correlation_rules import CorrelationRule


@dataclass(eq=False)
class Input:
    kind: str
    id: str
    occurred: int
    observed: int
    roles: tuple[str, ...]
    distinct: str | None = None
    fresh: bool = True

    def __post_init__(self):
        self.tag = (self.kind, self.id)
        self.key = json.dumps(f"{self.kind}\0{self.id}")
        self.order = (self.occurred, self.kind, self.id)


@dataclass(eq=False)
class Episode:
    incident: str
    start: int
    end: int
    deadline: int
    anchor: tuple[str, str]
    anchor_at: int
    closed: int | None = None
    collisions: int = 0
    members: dict = field(default_factory=dict)

    def takes(self, p: Input) -> bool:
        """Whether the deadline and a closure let a new member in."""
        return p.observed <= self.deadline and (self.closed is None or p.occurred <= self.closed)


def least_subsequence(items: list[Input], r: int) -> list[Input]:
    """The least r items by their keys, in the order they have: one pass with a stack."""
    out: list[Input] = []
    spare = len(items) - r
    for x in items:
        while out and spare and out[-1].key > x.key:
            out.pop()
            spare -= 1
        out.append(x)
    return out[:r]


def _distinct_ahead(tail: list[Input], start: int, seen: set) -> list[tuple[int, set]]:
    """For each index from start: how many values beyond seen come after it, and whether its own is among them."""
    after: set = set()
    out = [(0, False)] * len(tail)
    for i in range(len(tail) - 1, start - 1, -1):
        v = tail[i].distinct
        out[i] = (len(after), v in after)
        if v is not None and v not in seen:
            after.add(v)
    return out


def fill(head: Input, tail: list[Input], c: Input, r: int, values: int) -> list[Input] | None:
    """The least r items of tail that make up a set with head: c is in it, and it has so many distinct values."""
    out, seen, at, wanted = [head], {head.distinct} - {None}, 0, c is not head
    place = next((i for i, x in enumerate(tail) if x is c), -1)
    if len(tail) < r or (wanted and (place < 0 or not r)):
        return None
    while r:
        if len(seen) >= values and (not wanted or place == len(tail) - 1):
            rest = least_subsequence(tail[at:], r) if not wanted else [*least_subsequence(tail[at:place], r - 1), c]
            return out + rest
        last = min(len(tail) - r, place) if wanted else len(tail) - r
        ahead = _distinct_ahead(tail, at, seen) if len(seen) < values else None
        best = None
        for i in range(at, last + 1):
            x = tail[i]
            if wanted and r == 1 and x is not c:
                continue
            if ahead is not None:
                fresh = x.distinct is not None and x.distinct not in seen
                have, more = len(seen) + fresh, ahead[i][0] - (fresh and ahead[i][1])
                free = r - 1
                if wanted and x is not c and (c.distinct is None or c.distinct in seen or c.distinct == x.distinct):
                    free -= 1  # c takes a place without a new value
                if have + min(free, more) < values:
                    continue
            if best is None or x.key < tail[best].key:
                best = i
        if best is None:
            return None
        x = tail[best]
        out.append(x)
        seen |= {x.distinct} - {None}
        wanted, at, r = wanted and x is not c, best + 1, r - 1
    return out if len(seen) >= values and not wanted else None


class GroupState:
    """One group of one rule."""

    def __init__(self, rule: CorrelationRule, group_json: str = "", closures: dict[str, int] | None = None, episodes: list[Episode] = (), apart: bool = False):
        """apart: an episode begins after the ones before have ended, so what they left over of their time is in none."""
        self.rule, self.group, self.closures, self.apart = rule, group_json, closures or {}, apart
        self.recent: deque[Input] = deque()
        #: Those of recent that no episode had when they were decided.
        self.loose: deque[Input] = deque()
        self.episodes: list[Episode] = list(episodes)
        self.owner = {m: e for e in self.episodes for m in e.members}

    def incident(self, anchor: tuple[str, str]) -> str:
        """The same as correlate.incident_identity."""
        parts = ("wardstone-incident-v1", self.rule.id, str(self.rule.version), self.rule.fingerprint, self.group, f"{anchor[0]}:{anchor[1]}")
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()

    # --- the least set that holds an input

    def least(self, c: Input, items: list[Input], allowed, natural: bool) -> list[Input] | None:
        """items: the window's, in order, with c. natural: no owner, so every member must be observed within the first one's window and lateness."""
        return self._threshold(c, items, allowed, natural) if self.rule.threshold else self._sequence(c, items, allowed, natural, self.rule.stages)

    def _limit(self, first: Input, natural: bool):
        end = first.occurred + self.rule.window_ms
        seen = end + self.rule.lateness_ms
        return (lambda p: p.occurred <= end and p.observed <= seen) if natural else (lambda p: p.occurred <= end)

    def _threshold(self, c, items, allowed, natural):
        t = self.rule.threshold
        if t["selector"] not in c.roles:
            return None
        w, values = self.rule.window_ms, t["min_distinct"] if t["distinct_by"] else 0
        own = [p for p in items if p is c or (t["selector"] in p.roles and abs(p.occurred - c.occurred) <= w and allowed(p))]
        if len(own) < t["min_count"] or (values and len({p.distinct for p in own} - {None}) < values):
            return None
        firsts = [(p.key, i) for i, p in enumerate(own) if p.order <= c.order]
        heapq.heapify(firsts)
        while firsts:
            i = heapq.heappop(firsts)[1]
            ok = self._limit(own[i], natural)
            if not ok(own[i]) or not ok(c):
                continue
            found = fill(own[i], [p for p in own[i + 1 :] if ok(p)], c, t["min_count"] - 1, values)
            if found:
                return found
        return None

    def _sequence(self, c, items, allowed, natural, stages, forced: bool = True):
        """The least sequence of stages; forced: with c in one of them."""
        best = None
        for j in [j for j, (s, _) in enumerate(stages) if s in c.roles] if forced else [-1]:
            pools = [[p for p in items if s in p.roles and ((p is c) == (i == j) if p is c and forced else allowed(p))] for i, (s, _) in enumerate(stages)]
            found = self._staged(pools, [k for _, k in stages], c if forced else None, j, natural)
            if found and (best is None or [p.key for p in found] < [p.key for p in best]):
                best = found
        return best

    def _staged(self, pools, counts, c, j, natural):
        def possible(i, need, after, since, ok, has):
            """Whether the stages from i on can be filled, the earliest inputs first: need more of stage i after the order key, all later than since."""
            while True:
                rest = [p for p in pools[i] if p.occurred > since and (after is None or p.order > after) and ok(p)]
                if i == j and not has:
                    if c not in rest or need < 1:
                        return False
                    taken = [p for p in rest if p is not c][: need - 1]
                    if len(taken) < need - 1:
                        return False
                    top = max([c.occurred, *[p.occurred for p in taken]])
                else:
                    taken = rest[:need]
                    if len(taken) < need:
                        return False
                    top = taken[-1].occurred if taken else (after[0] if after else since)
                since, after, i = max(since, top), None, i + 1
                if i == len(counts):
                    return True
                need = counts[i]

        every = lambda p: True
        if not possible(0, counts[0], None, -1 << 62, every, False):
            return None
        firsts = [(p.key, n) for n, p in enumerate(pools[0])]
        heapq.heapify(firsts)
        while firsts:
            first = pools[0][heapq.heappop(firsts)[1]]
            ok = self._limit(first, natural)
            if not ok(first) or (c is not None and not ok(c)):
                continue
            out, i, left, after, since, has = [first], 0, counts[0] - 1, first.order, -1 << 62, first is c
            if not possible(0, left, after, since, ok, has):
                continue
            while True:
                if not left:
                    since = max(p.occurred for p in out)
                    i += 1
                    if i == len(counts):
                        return out
                    left, after = counts[i], None
                cands = [(p.key, n) for n, p in enumerate(pools[i]) if p.occurred > since and (after is None or p.order > after) and ok(p)]
                heapq.heapify(cands)
                while True:
                    p = pools[i][heapq.heappop(cands)[1]]
                    if possible(i, left - 1, p.order, since, ok, has or p is c):
                        break
                out.append(p)
                has, left, after = has or p is c, left - 1, p.order
        return None

    # --- decisions

    def seen(self, p: Input) -> None:
        """An input that was evaluated before, in order."""
        self.recent.append(p)
        if p.tag not in self.owner:
            self.loose.append(p)

    def add(self, c: Input, sets: list[list[Input]] | None = None, later: list[Input] = ()) -> dict:
        """The decision on c. sets: the sets to choose from (joins); later: inputs after c that were evaluated before."""
        rule = self.rule
        for line in (self.recent, self.loose):
            while line and line[0].occurred < c.occurred - rule.window_ms:
                line.popleft()
        live = [e for e in self.episodes if e.end >= c.occurred - rule.window_ms]
        if not later:
            self.episodes = live
            if len(self.owner) > 4 * sum(len(e.members) for e in live) + 1024:
                self.owner = {m: e for e in live for m in e.members}
        mine = self.owner.get(c.tag)
        owners = sorted((e for e in live if e.start <= c.occurred <= e.end or e is mine), key=lambda e: (abs(c.occurred - e.anchor_at), e.incident))
        if sets is None and len(owners) == 1 and self._joins(c, owners[0], later):
            added = []
            self.recent.append(c)
            self._own(owners[0], c, "supporting", added)
            return self._taken(c, owners[0], "updated", added)
        pool, items = [*self.recent, *later], [*self.recent, c, *later]
        self.recent.append(c)
        out = self._chosen(c, sets, pool, items, live, owners)
        if len(out["members"]) > 1:
            self.loose = deque(p for p in self.loose if p.tag not in self.owner)
        if c.tag not in self.owner:
            self.loose.append(c)
        return out

    def _joins(self, c: Input, e: Episode, later: list[Input]) -> bool:
        """Whether c is all that a threshold's only episode around c gains: with the set that made the episode c makes another one, and nothing else waits to be taken.
        Of an input without a value, which may take the place of one that counts, the sets are looked at."""
        t = self.rule.threshold
        if not t or t["selector"] not in c.roles or (t["distinct_by"] and c.distinct is None) or c.tag in self.owner or not e.start <= c.occurred <= e.end or not e.takes(c):
            return False
        waits = lambda p: p.tag not in self.owner and e.start <= p.occurred <= e.end and p.roles and e.takes(p)
        for p in reversed(self.loose):
            if p.occurred < e.start:
                break
            if waits(p):
                return False
        return not any(map(waits, later))

    def _chosen(self, c: Input, sets, pool: list[Input], items: list[Input], live: list[Episode], owners: list[Episode]) -> dict:
        """The decision by the least of all sets that hold c."""
        rule, found = self.rule, []
        for n, e in enumerate(owners if sets is None or owners else []):
            fits = lambda p, e=e: self.owner.get(p.tag) is e or (p.tag not in self.owner and e.takes(p))
            if fits(c):
                for s in [self.least(c, items, fits, False)] if sets is None else [x for x in sets if all(map(fits, x))]:
                    if s and not any(all(self.owner.get(p.tag) is o or o.takes(p) for p in s) for o in owners[:n]):
                        found.append(((0, e.incident, [p.key for p in s]), e, s))
        if not owners and c.tag not in self.owner:
            until = max(e.end for e in live) if self.apart and live else None
            free = lambda p: p.tag not in self.owner and (until is None or p.occurred > until)
            for s in [self.least(c, items, free, True)] if sets is None else [x for x in sets if all(map(free, x)) and all(map(self._limit(min(x, key=lambda p: p.order), True), x))]:
                if s:
                    found.append(((1, "", [p.key for p in s]), None, s))
        if not found:
            return self._unmatched(c, items, owners)
        _, owner, members = min(found, key=lambda x: x[0])
        members = sorted(members, key=lambda p: p.order)
        action, added = "updated", []
        if owner is None:
            action = "created"
            last = rule.stages[-1][0] if rule.stages else None
            anchor = [p for p in members if last is None or last in p.roles][-1]
            incident, end = self.incident(anchor.tag), members[0].occurred + rule.window_ms
            closed = self.closures.get(incident)
            owner = Episode(incident, members[0].occurred, end, (end if closed is None else closed) + rule.lateness_ms, anchor.tag, anchor.occurred, closed)
            self.episodes.append(owner)
            self._own(owner, anchor, "trigger", added)
        owner.collisions += max(0, len([e for e in owners if e.start <= c.occurred <= e.end]) - 1)
        for p in members:
            if owner.start <= p.occurred <= owner.end:
                self._own(owner, p, "supporting", added)
        if "shared_ip" not in rule.group_by:  # the rest of the window that a selector approves
            for p in pool:
                if p.roles and owner.start <= p.occurred <= owner.end and owner.takes(p) and p.tag not in self.owner:
                    self._own(owner, p, "context", added)
        return self._taken(c, owner, action, added)

    def _taken(self, c: Input, owner: Episode, action: str, added: list) -> dict:
        if action == "updated" and owner.closed is not None and c.observed > owner.closed:
            action = "enriched_closed"
        return self._decision(c, owner, action, "late_within_boundary" if c.observed > owner.end else "on_time", "matched", added)

    def _own(self, e: Episode, p: Input, role: str, added: list) -> None:
        if p.tag not in e.members:
            e.members[p.tag] = role
            self.owner[p.tag] = e
            added.append({"kind": p.kind, "id": p.id, "role": role})

    def _unmatched(self, c: Input, items: list[Input], owners: list[Episode]) -> dict:
        late = "late_outside_boundary"
        if owners and not any(self.owner.get(c.tag) is e or e.takes(c) for e in owners):
            return self._decision(c, None, "no_match", late, late) | {"incident_id": owners[0].incident}
        if c.observed > c.occurred + self.rule.window_ms + self.rule.lateness_ms:
            return self._decision(c, None, "no_match", late, "outside_reconciliation_horizon")
        prefix = [] if owners else self.partial(c, items)
        return self._decision(c, None, "no_match", "not_applicable", "condition_not_satisfied") | {"partial": [f"{p.kind}:{p.id}" for p in prefix], "partial_start_ms": prefix[0].occurred if prefix else None}

    def partial(self, c: Input, items: list[Input]) -> list[Input]:
        """The longest run of complete leading stages that holds c, by the least tags."""
        stages, free = self.rule.stages, lambda p: p.tag not in self.owner
        for n in range(len(stages) - 1, 0, -1):
            found = self._sequence(c, items, free, True, stages[:n], forced=False) if n > 1 else self._first_stage(items, free)
            if found:
                return found if c in found else []
        return []

    def _first_stage(self, items: list[Input], free) -> list[Input]:
        role, k = self.rule.stages[0]
        own = [p for p in items if role in p.roles and free(p)]
        for first in sorted(own, key=lambda p: p.key) if len(own) >= k else []:
            ok = self._limit(first, True)
            found = ok(first) and fill(first, [p for p in own if p.order > first.order and ok(p)], first, k - 1, 0)
            if found:
                return found
        return []

    @staticmethod
    def _decision(c: Input, e: Episode | None, action: str, lateness: str, reason: str, added: list = ()) -> dict:
        return {
            "input_kind": c.kind, "input_id": c.id, "action": action, "lateness": lateness, "reason": reason, "incident_id": e and e.incident, "episode_start_ms": e and e.start, "episode_end_ms": e and e.end,
            "late_accept_until_ms": e and e.deadline, "anchor_kind": e and e.anchor[0], "anchor_id": e and e.anchor[1], "anchor_ms": e and e.anchor_at, "collision_count": e and e.collisions, "members": list(added), "partial": [], "partial_start_ms": None,
        }


def json_key(kind: str, id: str) -> str:
    """Sorts inputs as the JSON does that Spark writes of them."""
    if id.isalnum():
        return f'{kind}"{id}"'
    quoted = json.dumps(id, ensure_ascii=False)[1:]
    return f'{kind}"' + (re.sub(r"(\\u00)([01][0-9a-f])|\\\\", lambda m: m[1] + m[2].upper() if m[1] else m[0], quoted) if "\\u00" in quoted else quoted)


class Side:
    """Inputs of one role in the order (occurred, kind, id). rank: the order of their JSON."""

    def __init__(self, kind: list, id: list, occurred: np.ndarray, observed: np.ndarray, reach: int):
        self.kind, self.id, self.occurred, self.observed = kind, id, occurred, observed
        keys = list(map(json_key, kind, id))
        self.rank = np.empty(len(keys), np.int64)
        self.rank[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
        #: Those that can be in a set without an owner.
        self.near = observed - occurred <= reach

    def order(self, i: int) -> tuple:
        return int(self.occurred[i]), self.kind[i], self.id[i]


class JoinSets:
    """One group of a join whose sets are all that have one input per role within the window: what the sets, in the order (last, JSON), add to episodes, without a look at each of them.

    No input has two roles. While an episode covers the time, which inputs fit it does not change, so the sets up to its end add all inputs that are in a set of such; between episodes the first set
    of free inputs counts. sides are not changed, so several groups may share one.
    """

    def __init__(self, rule: CorrelationRule, group: str, closures: dict[str, int], apart: bool, sides: list[Side]):
        self.rule, self.state, self.apart, self.sides = rule, GroupState(rule, group, closures, apart=apart), apart, sides
        self.free = [np.ones(len(s.rank), bool) for s in sides]
        self.able = [s.near.copy() for s in sides]
        self.until = -1 << 62

    def gains(self):
        """(episode, positions by role of the set that begins it, those of what its later sets add)."""
        while (chosen := self._next()) is not None:
            inputs = sorted((s.order(i), r) for r, (s, i) in enumerate(zip(self.sides, chosen)))
            start, (at, *anchor) = inputs[0][0][0], inputs[-1][0]
            incident, end = self.state.incident(tuple(anchor)), start + self.rule.window_ms
            closed = self.state.closures.get(incident)
            e = Episode(incident, start, end, (end if closed is None else closed) + self.rule.lateness_ms, tuple(anchor), at, closed)
            first = [np.array([i]) for i in chosen]
            self._take(first)
            more = self._added(e, chosen)
            self._take(more)
            yield e, first, more
            self.until = end

    def _take(self, found: list[np.ndarray]) -> None:
        for free, able, at in zip(self.free, self.able, found):
            free[at] = able[at] = False

    def _first(self, r: int, low: int) -> int | None:
        """The time of the first free input of a role from low on."""
        t, able = self.sides[r].occurred, self.able[r]
        i = int(t.searchsorted(low))
        i += int(able[i:].argmax()) if i < len(t) else 0
        return int(t[i]) if i < len(t) and able[i] else None

    def _next(self) -> list[int] | None:
        """The first set of free inputs that ends after the episodes so far."""
        w, roles, at = self.rule.window_ms, range(len(self.sides)), self.until
        floor = at + 1 if self.apart else -1 << 62
        while True:
            last = min((x for r in roles if (x := self._first(r, at + 1)) is not None), default=None)
            if last is None:
                return None
            while True:  # the first time whose window has all roles
                low = max(last - w, floor)
                firsts = [self._first(r, low) for r in roles]
                if None in firsts:
                    return None
                if max(firsts) <= last:
                    break
                last = max(firsts)
            found = self._least(last, low)
            if found is not None:
                return found
            at = last

    def _least(self, last: int, low: int) -> list[int] | None:
        """The least set by JSON that ends at last and is observed within its first input's window and lateness."""
        reach, pools = self.rule.window_ms + self.rule.lateness_ms, []
        for s, able in zip(self.sides, self.able):
            part = slice(int(s.occurred.searchsorted(low)), int(s.occurred.searchsorted(last, "right")))
            pools.append(np.flatnonzero(able[part]) + part.start)
        ends = [bool(len(p)) and s.occurred[p[-1]] == last for s, p in zip(self.sides, pools)]

        def by_rank(rank: np.ndarray):
            if len(rank):
                yield int(rank.argmin())
                yield from np.argsort(rank)[1:].tolist()

        def pick(r: int, chosen: list[int], low: int, high: int, ended: bool):
            if r == len(pools):
                return chosen
            s, able = self.sides[r], pools[r]
            t = s.occurred
            if chosen:
                first = np.minimum(t[able], low) + reach
                able = able[(s.observed[able] <= first) & (high <= first)]
            if not ended and not any(ends[r + 1 :]):
                able = able[t[able] == last]
            for n in by_rank(s.rank[able]):
                i = int(able[n])
                found = pick(r + 1, [*chosen, i], min(low, int(t[i])), max(high, int(s.observed[i])), ended or t[i] == last)
                if found:
                    return found
            return None

        return pick(0, [], 1 << 62, -1 << 62, False)

    def _added(self, e: Episode, chosen: list[int]) -> list[np.ndarray]:
        """What the sets after chosen, up to the end of its episode e, add to it.

        A window that ends after the anchor, but within the episode, has chosen in it: all that fits there is in a set, and so is all before it, once another role has an input after the anchor.
        """
        roles, until = range(len(self.sides)), e.end if e.closed is None else min(e.end, e.closed)
        fits, late = [], []
        for s, free in zip(self.sides, self.free):
            part = slice(int(s.occurred.searchsorted(e.start)), int(s.occurred.searchsorted(until, "right")))
            at = np.flatnonzero(free[part] & (s.observed[part] <= e.deadline)) + part.start
            fits.append(at)
            late.append(at[int(s.occurred[at].searchsorted(e.anchor_at, "right")) :])
        whole = [any(len(late[k]) for k in roles if k != r) for r in roles]
        if all(whole):
            return fits
        found = [[fits[r] if whole[r] else late[r]] for r in roles]
        for r, at in self._beside(e, chosen):
            found[r].append(at[self.sides[r].occurred[at] >= e.start])
        return [np.unique(np.concatenate(f)) for f in found]

    def _beside(self, e: Episode, chosen: list[int]):
        """(role, positions) of free inputs in sets that end with the anchor and come after chosen: up to a role they are chosen's, there a greater one."""
        roles, last, now = range(len(self.sides)), e.anchor_at, []
        for s, free in zip(self.sides, self.free):
            part = slice(int(s.occurred.searchsorted(last - self.rule.window_ms)), int(s.occurred.searchsorted(last if e.closed is None else min(last, e.closed), "right")))
            now.append(np.flatnonzero(free[part] & (s.observed[part] <= e.deadline)) + part.start)
        ends = lambda r, at: bool((self.sides[r].occurred[at] == last).any())
        own = [self.sides[r].occurred[chosen[r]] == last for r in roles]
        for r in roles:
            rank = self.sides[r].rank
            greater = now[r][rank[now[r]] > rank[chosen[r]]]
            if not len(greater):
                continue
            pools = [None] * r + [greater, *now[r + 1 :]]
            edge = [*own[:r], ends(r, greater), *[own[k] or ends(k, now[k]) for k in roles[r + 1 :]]]
            for k in roles[r:]:
                at = pools[k]
                yield k, at if any(edge[j] for j in roles if j != k) else at[self.sides[k].occurred[at] == last]


class JoinGroup:
    """JoinSets over the columns of one group in the order (occurred, kind, id); role numbers the required selectors. Sets of inputs that have two roles are looked at one by one."""

    def __init__(self, rule: CorrelationRule, group: str, closures: dict[str, int], apart: bool, kind: list, id: list, occurred: np.ndarray, observed: np.ndarray, role: np.ndarray):
        self.rule, self.group, self.closures, self.apart = rule, group, closures, apart
        self.kind, self.id, self.occurred, self.observed, self.role = kind, id, occurred, observed, role

    def gains(self):
        """(episode, action, members in order) of every set that begins an episode, and once for all that its later sets add."""
        if len(set(zip(self.kind, self.id))) < len(self.role):
            yield from self._one_by_one()
            return
        at = [np.flatnonzero(self.role == r) for r in range(len(self.rule.require))]
        sides = [Side([self.kind[i] for i in p.tolist()], [self.id[i] for i in p.tolist()], self.occurred[p], self.observed[p], self.rule.window_ms + self.rule.lateness_ms) for p in at]
        for e, *found in JoinSets(self.rule, self.group, self.closures, self.apart, sides).gains():
            first, more = (np.sort(np.concatenate([p[f] for p, f in zip(at, fs)])) for fs in found)
            yield e, "created", first
            if len(more):
                yield e, "enriched_closed" if e.closed is not None and int(self.observed[more].max()) > e.closed else "updated", more

    def _one_by_one(self):
        t, w, state = self.occurred, self.rule.window_ms, GroupState(self.rule, self.group, self.closures, apart=self.apart)
        keys = list(map(json_key, self.kind, self.id))
        of: dict[tuple, int] = {}
        inputs = [Input(k, i, int(a), int(b), ("member",)) for k, i, a, b in zip(self.kind, self.id, t, self.observed)]
        for last in np.unique(t):
            near = np.flatnonzero((t >= last - w) & (t <= last)).tolist()
            sets = (s for s in itertools.product(*[sorted((i for i in near if self.role[i] == r), key=keys.__getitem__) for r in range(len(self.rule.require))]) if max(t[i] for i in s) == last and len({inputs[i].tag for i in s}) == len(s))
            for s in sets:
                members = sorted((inputs[i] for i in s), key=lambda p: p.order)
                of |= {inputs[i].tag: i for i in s}
                out = state.add(members[-1], [members])
                if out["members"]:
                    e = next(e for e in state.episodes if e.incident == out["incident_id"])
                    yield e, out["action"], np.array(sorted(of[m["kind"], m["id"]] for m in out["members"]))

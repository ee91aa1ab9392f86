"""Incident status changes: new, acknowledged, closed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEXT = {"new": {"acknowledged", "closed"}, "acknowledged": {"closed"}, "closed": set()}


class TransitionError(ValueError):
    pass


@dataclass(frozen=True)
class Incident:
    status: str = "new"
    revision: int = 1
    window_end_ms: int = 0
    late_accept_until_ms: int = 0
    acknowledged_at_ms: int | None = None
    closed_at_ms: int | None = None
    transitions: tuple[tuple[str, str], ...] = ()


def transition(incident: Incident, id: str, to: str, at_ms: int) -> Incident:
    """The incident after a change; the same id again, or the status it has, changes nothing. Closing moves the deadline for late inputs to the same distance after the closure."""
    seen = dict(incident.transitions)
    if not id.strip():
        raise TransitionError("a transition needs an id")
    if id in seen:
        if seen[id] != to:
            raise TransitionError("the same id asked for another status")
        return incident
    if to == incident.status:
        return incident
    if to not in NEXT.get(incident.status, set()):
        raise TransitionError(f"{incident.status} can't become {to}")
    late = incident.late_accept_until_ms - incident.window_end_ms
    return replace(
        incident, status=to, revision=incident.revision + 1, transitions=(*incident.transitions, (id, to)), acknowledged_at_ms=at_ms if to == "acknowledged" else incident.acknowledged_at_ms,
        closed_at_ms=at_ms if to == "closed" else incident.closed_at_ms, late_accept_until_ms=at_ms + late if to == "closed" else incident.late_accept_until_ms,
    )


def accepts(incident: Incident, occurred_ms: int, observed_ms: int) -> bool:
    """Whether an input may still join: by its observation, and not after a closure."""
    return observed_ms <= incident.late_accept_until_ms and (incident.closed_at_ms is None or occurred_ms <= incident.closed_at_ms)


def replayed(audit: DataFrame, incident: str, transition: str, to: str, at: str) -> DataFrame:
    """incident, status, revision, refused: every incident's transitions in the order (at, id). A transition counts once; what its status can't become is refused. One grouping and a fold per incident."""
    once = audit.groupBy(incident, transition).agg(F.min(F.struct(F.col(at).alias("at"), F.col(to).alias("to"))).alias("t"))
    asked = once.groupBy(incident).agg(F.array_sort(F.collect_list(F.struct(F.col("t.at").alias("at"), F.col(transition).alias("id"), F.col("t.to").alias("to")))).alias("asked"))
    state = "struct<status:string,revision:int,refused:int>"
    start = F.struct(F.lit("new").alias("status"), F.lit(1).alias("revision"), F.lit(0).alias("refused")).cast(state)
    allowed = lambda old, new: F.concat_ws(">", old, new).isin(*[f"{a}>{b}" for a, bs in NEXT.items() for b in sorted(bs)])

    def step(acc, x):
        goes, same = allowed(acc["status"], x["to"]), acc["status"] == x["to"]
        return F.struct(F.when(goes, x["to"]).otherwise(acc["status"]).alias("status"), (acc["revision"] + goes.cast("int")).alias("revision"), (acc["refused"] + (~goes & ~same).cast("int")).alias("refused")).cast(state)

    return asked.select(incident, F.aggregate("asked", start, step).alias("s")).select(incident, "s.*")

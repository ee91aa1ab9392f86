"""Ledger-backed incremental evaluation: what is still to be evaluated, in which order, and idempotent writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrolled(events: DataFrame, floor, occurred: str = "event_time", observed: str | None = "ingested_at") -> DataFrame:
    """Events that a scope's fixed floor lets in, by either clock."""
    late = F.col(observed) >= floor if observed else F.lit(False)
    return events.where((F.col(occurred) >= floor) | late)


def unevaluated(events: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Events without a ledger row. An anti join needs no distinct ledger: the ledger's keys are shuffled once, or not at all where it is stored by them."""
    return events.join(ledger.select(*keys), keys, "left_anti")


def unevaluated_or_conflicting(events: DataFrame, ledger: DataFrame, keys: list[str], invalid: str = "invalid_reason", recorded: str = "reason_code") -> DataFrame:
    """Events without a ledger row, or that conflict now while the ledger doesn't say so."""
    seen = ledger.groupBy(*keys).agg(F.max(F.coalesce(F.col(recorded), F.lit(""))).alias("seen_reason"))
    rows = events.join(seen, keys, "left")
    conflict = F.col(invalid).isNotNull() & (F.col("seen_reason") != F.col(invalid))
    return rows.where(F.col("seen_reason").isNull() | conflict).drop("seen_reason")


def backlog(events: DataFrame, ledger: DataFrame, keys: list[str], occurred: str) -> DataFrame:
    """One row: unevaluated events and the oldest of them."""
    return unevaluated(events, ledger, keys).agg(F.count(F.lit(1)).alias("unevaluated_count"), F.min(occurred).alias("oldest_unevaluated"))


def rotating_page(rows: DataFrame, order: list[str], cursor: tuple | None, size: int) -> DataFrame:
    """The next rows after the cursor in the given order, starting again at the front: a failing row can't hold up the others."""
    if cursor is None:
        return rows.orderBy(*order).limit(size)
    place = F.struct(*[F.col(c).alias(c) for c in order])
    at = F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(c) for c, v in zip(order, cursor)])
    return rows.orderBy(F.when(place <= at, 1).otherwise(0), *order).limit(size)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """``LIMIT 1 BY``: the first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


class TooMany(RuntimeError):
    pass


def at_most(rows: DataFrame, cap: int) -> DataFrame:
    """rows, or an error if there are more than cap."""
    if rows.limit(cap + 1).count() > cap:
        raise TooMany(f"more than {cap} rows")
    return rows


class Conflict(RuntimeError):
    pass


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Of incoming rows those whose key is not stored yet, once each; an error if a key has other content there or among themselves."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    fresh = incoming.withColumn("_c", digest)
    twice = fresh.groupBy(*keys).agg(F.min("_c").alias("a"), F.max("_c").alias("b")).where("a <> b")
    other = fresh.join(stored.withColumn("_s", digest).select(*keys, "_s"), keys).where("_c <> _s")
    if not twice.isEmpty() or not other.isEmpty():
        raise Conflict("immutable content differs for the same key")
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def integrity_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one side only, both ways (set semantics), with the side they are on."""
    return expected.subtract(actual).withColumn("side", F.lit("expected")).union(actual.subtract(expected).withColumn("side", F.lit("actual")))


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], field: str, other: str) -> DataFrame:
    """Rows of both sides with equal keys whose field and other differ, nulls included."""
    return left.join(right, keys).where(~F.col(field).eqNullSafe(F.col(other)))


def coverage(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """expected with ``covered``: whether present has its keys."""
    return expected.join(present.select(*keys).distinct().withColumn("covered", F.lit(True)), keys, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def merged_status(schedule: DataFrame, integrity: DataFrame, keys: list[str], zeros: list[str]) -> DataFrame:
    """The state of every scope that either side knows; counts that a side lacks are 0."""
    out = schedule.join(integrity, keys, "full_outer")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros})


def ensure(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """rows; reading one for which the condition doesn't hold is an error."""
    checked = F.assert_true(F.coalesce(condition, F.lit(False)), message)
    return rows.where(checked.isNull())


def integrity_summary(events: DataFrame) -> DataFrame:
    """Integrity events by rule and kind: how many, how many different inputs, a sample of two projections, first and last time."""
    return events.groupBy("correlation_rule_id", "violation_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("input_kind", "input_id")).alias("inputs"), F.slice(F.array_sort(F.collect_set("projection_name")), 1, 2).alias("projections"), F.min("detected_at").alias("first_at"), F.max("detected_at").alias("last_at")
    )


def validate(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, the others with ``failed_checks``). A null check fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("failed_checks", failed)
    return marked.where(F.size("failed_checks") == 0).drop("failed_checks"), marked.where(F.size("failed_checks") > 0)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)

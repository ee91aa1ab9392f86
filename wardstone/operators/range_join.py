"""Joins on keys within a time window, as hash joins on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, window_ms: int, residual: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows with equal keys whose times differ by window_ms at most (inclusive).

    Each left row goes to its bucket of window_ms, each right row to its own and both neighbours, so pairs meet in exactly one bucket of the left row and
    the join is an equi-join on (keys, bucket): a hot key is spread over its buckets, and AQE can split the rest. Column names of the sides must differ but for keys.
    """
    w = max(1, window_ms)
    l = left.withColumn("_lt", _millis(F.col(left_time))).withColumn("_b", F.floor(F.col("_lt") / w))
    r = right.withColumn("_rt", _millis(F.col(right_time))).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_rt") / w) - 1, F.floor(F.col("_rt") / w) + 1)))
    near = F.abs(F.col("_lt") - F.col("_rt")) <= window_ms
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "_b"]] + [near] + ([residual] if residual is not None else [])
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = l.alias("l").join(r.alias("r"), cond, how)
    if how in ("left_semi", "left_anti"):
        return out.drop("_lt", "_b")
    return out.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def span_ok(times: list[Column], window_ms: int) -> Column:
    """Whether the latest and earliest of the times lie within the window."""
    ms = [_millis(t) for t in times]
    return F.greatest(*ms) - F.least(*ms) <= window_ms if len(ms) > 1 else F.lit(True)


def overlap_join(left: DataFrame, right: DataFrame, left_set: str, right_set: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, shared): pairs whose sets meet, with the sorted common members; by explode and equi-join, not by pairs."""
    l = left.select(left_id, F.explode(F.array_distinct(left_set)).alias("_m"))
    r = right.select(right_id, F.explode(F.array_distinct(right_set)).alias("_m"))
    return l.join(r, "_m").groupBy(left_id, right_id).agg(F.array_sort(F.collect_set("_m")).alias("shared"))

"""Bounded correlation: threshold, sequence and join over typed inputs, episodes, lateness, incidents.

Qualification (does a set exist around this input?) is plain window functions and band joins. Episodes depend on the order of inputs within a group;
they are assigned per group by one ordered pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attack import SEVERITY
from ..functions.canon import identity
from .range_join import range_join

_MS = "_occurred_ms"


def _with_ms(df: DataFrame, occurred: str) -> DataFrame:
    return df.withColumn(_MS, F.unix_millis(F.col(occurred).cast("timestamp")))


def threshold_qualified(inputs: DataFrame, group: list[str], occurred: str, window_ms: int, min_count: int, distinct_by: str | None = None, min_distinct: int = 1) -> DataFrame:
    """Inputs that end a set of at least min_count inputs (min_distinct values of distinct_by) of their group within the inclusive window, with n and n_distinct of the frame."""
    w = Window.partitionBy(*group).orderBy(_MS).rangeBetween(-window_ms, 0)
    out = _with_ms(inputs, occurred).withColumn("n", F.count(F.lit(1)).over(w))
    out = out.withColumn("n_distinct", F.size(F.collect_set(distinct_by).over(w)).cast("long") if distinct_by else F.lit(1).cast("long"))
    return out.where((F.col("n") >= min_count) & (F.col("n_distinct") >= min_distinct)).drop(_MS)


def sequence_qualified(inputs: DataFrame, group: list[str], occurred: str, window_ms: int, stages: list[tuple[Column, int]]) -> DataFrame:
    """Inputs of the last stage that complete the sequence, with sequence_start_ms: each stage has its count of inputs, all strictly before the next stage's, within the window.

    An input of a stage knows the latest start of a chain that is done before it; of a stage's last k inputs the one k back decides. That is a lag among the
    stage's inputs and a running maximum over all earlier ones, so memory stays constant and every step shares the group's partitioning. The last stage takes one input.
    """
    if stages[-1][1] != 1 or len(stages) < 2:
        raise ValueError("two stages at least, the last with one input")
    out = _with_ms(inputs, occurred)
    before = Window.partitionBy(*group).orderBy(_MS).rangeBetween(Window.unboundedPreceding, -1)
    start = F.col(_MS)
    for i, (is_stage, k) in enumerate(stages[:-1]):
        out = out.withColumn("_is", is_stage).withColumn("_own", F.when(F.col("_is"), start))
        out = out.withColumn("_kth", F.lag("_own", k - 1).over(Window.partitionBy(*group, "_is").orderBy(_MS)) if k > 1 else F.col("_own"))
        out = out.withColumn(f"_start{i}", F.max(F.when(F.col("_is"), F.col("_kth"))).over(before))
        start = F.col(f"_start{i}")
    done = out.where(stages[-1][0] & start.isNotNull() & (F.col(_MS) - start <= window_ms)).withColumn("sequence_start_ms", start)
    return done.drop(_MS, "_is", "_own", "_kth", *[f"_start{i}" for i in range(len(stages) - 1)])


def sequence_progress(inputs: DataFrame, group: list[str], occurred: str, window_ms: int, stages: list[tuple[Column, int]]) -> DataFrame:
    """For each group, how many leading stages its inputs have completed within the window that ends with its last input (all but the last stage can be partial state), and that input's time."""
    out = _with_ms(inputs, occurred)
    upto = Window.partitionBy(*group).orderBy(_MS).rangeBetween(Window.unboundedPreceding, 0)
    before = upto.rangeBetween(Window.unboundedPreceding, -1)
    start, done = F.col(_MS), []
    for i, (is_stage, k) in enumerate(stages):
        out = out.withColumn("_is", is_stage).withColumn("_own", F.when(F.col("_is"), start))
        out = out.withColumn("_kth", F.lag("_own", k - 1).over(Window.partitionBy(*group, "_is").orderBy(_MS)) if k > 1 else F.col("_own"))
        out = out.withColumn(f"_done{i}", F.max(F.when(F.col("_is"), F.col("_kth"))).over(upto)).withColumn(f"_start{i}", F.max(F.when(F.col("_is"), F.col("_kth"))).over(before))
        start = F.col(f"_start{i}")
        done.append(F.col(f"_done{i}").isNotNull() & (F.col(_MS) - F.col(f"_done{i}") <= window_ms))
    n = F.lit(0)
    for i in range(len(done)):
        whole = done[0]
        for d in done[1 : i + 1]:
            whole = whole & d
        n = n + whole.cast("int")
    out = out.withColumn("stages_done", n)
    return out.groupBy(*group).agg(F.max_by("stages_done", F.struct(F.col(_MS), F.col("stages_done"))).alias("stages_done"), F.max(occurred).alias("last_at"))


def join_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, window_ms: int) -> DataFrame:
    """Pairs with equal keys within the window, inclusive at both ends."""
    return range_join(left, right, keys, left_time, right_time, window_ms)


def ownership(pairs: DataFrame, context: DataFrame, keys: list[str], pair_time: str, context_time: str, window_ms: int, pair_id: list[str], context_id: str) -> DataFrame:
    """Context inputs from the pair's time to the end of its window, as a sorted set per pair."""
    near = range_join(pairs, context, keys, pair_time, context_time, window_ms).where(F.col(context_time) >= F.col(pair_time))
    return near.groupBy(*pair_id).agg(F.array_sort(F.collect_set(context_id)).alias("related"), F.count_distinct(context_id).alias("n_related"))


def episodes(inputs: DataFrame, group: list[str], occurred: str, window_ms: int, id: str) -> DataFrame:
    """inputs with episode_start: the first input of a group opens an episode of a fixed, inclusive window; the first one after it opens the next.

    Neither tumbling nor session windows give this: each start depends on the one before. One ordered pass per group, streamed from sorted partitions, holds one row at a time.
    """
    fields = inputs.withColumn("episode_start", F.col(occurred).cast("timestamp"))
    names = inputs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start = None, None
        for pdf in batches:
            starts = []
            times = pd.to_datetime(pdf[occurred], utc=True)
            ms = times.astype("int64") // (1000 if str(times.dtype).startswith("datetime64[us") else 1_000_000)
            for k, t, own in zip(pdf[group].itertuples(index=False, name=None), ms, times):
                if k != key or t > start[0] + window_ms:
                    key, start = k, (t, own)
                starts.append(start[1])
            out = pdf[names].copy()
            out["episode_start"] = pd.Series(starts, index=pdf.index, dtype=times.dtype)
            yield out

    ordered = inputs.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, occurred, id)
    return ordered.mapInPandas(run, fields.schema)


def lateness(occurred: Column, observed: Column, window_end: Column, allowed_ms: int) -> Column:
    """on_time, late_within_boundary or late_outside_boundary; both ends inclusive."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return F.when(occurred.isNull() | observed.isNull(), "not_applicable").when(ms(observed) <= ms(window_end), "on_time").when(ms(observed) <= ms(window_end) + allowed_ms, "late_within_boundary").otherwise("late_outside_boundary")


def within_horizon(occurred: Column, observed: Column, window_ms: int, allowed_ms: int) -> Column:
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return ms(observed) <= ms(occurred) + window_ms + allowed_ms


def severity_rank(c: Column) -> Column:
    """1 to 4 for low to critical; null for informational and anything else, which never raise an incident."""
    out = F.lit(None).cast("int")
    for name, rank in SEVERITY.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, n in SEVERITY.items():
        out = F.when(rank == n, name).otherwise(out)
    return out


def source_family(source_type: Column) -> Column:
    return F.when(source_type.startswith("windows"), "windows").when(source_type.startswith("linux"), "linux").when(source_type.startswith("suricata"), "network").when(source_type == "", None).otherwise(source_type)


def incident_rollup(members: DataFrame, incident: str, base_rank: int = 1) -> DataFrame:
    """Incident fields recomputed from members: counts, the highest severity, first and last seen, sources, rules."""
    return members.groupBy(incident).agg(
        F.count(F.lit(1)).alias("input_count"), F.count_if(F.col("input_kind") == "detection").alias("detection_count"), F.count_if(F.col("input_kind") == "event").alias("event_count"),
        F.greatest(F.lit(base_rank), F.max(severity_rank(F.col("severity")))).alias("severity_rank"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"),
        F.count_distinct("rule_id").alias("distinct_rule_count"), F.count_distinct(source_family(F.col("source_type"))).alias("source_family_count"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
    )


def incident_identity(rule_id: Column, version: Column, scope: Column, group_json: Column, anchor_kind: Column, anchor_id: Column) -> Column:
    return identity("wardstone-incident-v1", rule_id, version, scope, group_json, F.concat_ws(":", anchor_kind, anchor_id))


def link_identity(incident: Column, kind: Column, id: Column) -> Column:
    return identity("wardstone-incident-link-v1", incident, kind, id)


def evaluation_identity(engine: Column, rule_id: Column, version: Column, scope: Column, kind: Column, id: Column) -> Column:
    return identity("wardstone-evaluation-v1", engine, rule_id, version, scope, kind, id)


def episode_identity(engine: Column, rule_id: Column, version: Column, scope: Column, group_json: Column, kind: Column, id: Column) -> Column:
    """An episode is told by its earliest input."""
    return identity("wardstone-episode-v1", engine, rule_id, version, scope, group_json, kind, id)


def cycle_statistics(decisions: DataFrame, by: list[str]) -> DataFrame:
    """What a cycle did: candidates, matches, created and updated incidents, new links, invalid, late and failed inputs."""
    action = F.col("action")
    return decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(action.isin("created", "updated", "enriched_closed")).alias("matched"), F.count_if(action == "created").alias("created"), F.count_if(action.isin("updated", "enriched_closed")).alias("updated"),
        F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("links"), F.count_if(action == "invalid_input").alias("invalid"), F.count_if(F.col("lateness") == "late_outside_boundary").alias("late_outside"), F.count_if(F.col("reason") == "outside_reconciliation_horizon").alias("outside_horizon"), F.count_if(action == "failed").alias("failed"),
    )


def nearest_anchor(candidates: DataFrame, input_id: str, distance: Column, incident: str, episode: str) -> DataFrame:
    """For each input the owner with the smallest distance, then incident id, then episode id."""
    return candidates.groupBy(input_id).agg(F.min(F.struct(distance.alias("distance"), F.col(incident).alias(incident), F.col(episode).alias(episode))).alias("o")).select(input_id, "o.*")

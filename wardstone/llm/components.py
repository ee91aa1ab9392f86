"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node (summed map-side, so a hub is one row before its shuffle) and an equi-join back, whose hot partitions AQE
splits. Each pair of steps is one job, written to the shared folder; nothing is collected but a count and a hash sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60, scratch: list[DataFrame] | None = None) -> DataFrame:
    """(node, root): every node of an edge and the smallest node of its component. Loops and nulls are ignored. The table behind the result goes to scratch."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = written(e, "components")
    state = None
    for _ in range(most):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("shuffle_merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("shuffle_merge"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        seen = Observation()
        small = written(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "components")
        drop_written(e)
        e = small
        now = (seen.get.get("n"), seen.get.get("h"))
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    if scratch is not None:
        scratch.append(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

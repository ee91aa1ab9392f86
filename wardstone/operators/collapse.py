"""Logical source collapse: physical duplicates become one row, conflicting ones are told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def logical_source(rows: DataFrame, id: str, occurred: str, observed: str, fields: list[str]) -> DataFrame:
    """One row per id: the earliest observation, the whole first row by (observed, content in the order of its fields), the number of variants and why the id is invalid, if so.

    invalid_reason: blank_input_id, missing_occurrence_time, conflicting_immutable_values or null. Two groupings with map-side partial results, by (id, content) and by id.
    """
    content = F.struct(F.col(occurred).alias(occurred), *[F.col(f).alias(f) for f in fields])
    # 16 bytes stand for a row's content, so that duplicates of a hot id are counted and dropped before the shuffle by id alone
    hashed = rows.select(id, F.col(observed).alias("_observed"), content.alias("_row"), F.unhex(F.md5(F.to_json(content))).alias("_hash"))
    each = hashed.groupBy(id, "_hash").agg(F.min(F.struct("_observed", "_row")).alias("_least"), F.count(F.lit(1)).alias("_n"))
    out = each.groupBy(id).agg(F.min("_least").alias("_least"), F.count(F.lit(1)).alias("variants"), F.sum("_n").alias("copies"))
    out = out.select(id, F.col("_least._observed").alias(observed), F.col("_least._row").alias("row"), "variants", "copies")
    missing = F.col(f"row.{occurred}").isNull() | (F.unix_micros(F.col(f"row.{occurred}").cast("timestamp")) == 0)
    reason = F.when(F.col(id).isNull() | (F.trim(F.col(id).cast("string")) == ""), "blank_input_id").when(missing, "missing_occurrence_time").when(F.col("variants") > 1, "conflicting_immutable_values")
    return out.select(id, "row.*", observed, "variants", "copies", reason.alias("invalid_reason"))


def fingerprint(rows: DataFrame, keys: list[str], members: list[str]) -> DataFrame:
    """SHA-256 over each group's sorted members, repeats included, joined by NUL: independent of the order of rows."""
    one = F.concat_ws("|", *[F.col(m).cast("string") for m in members])
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\0"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))

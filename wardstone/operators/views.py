"""Serving views: latest revisions, earliest introductions, confirmed rows, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_revision(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by the order columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_logical_rank", F.row_number().over(w)).where("_logical_rank = 1").drop("_logical_rank")


def earliest_introduction(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_logical_rank", F.row_number().over(w)).where("_logical_rank = 1").drop("_logical_rank")


def replacing(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The whole row of each key with the highest version, by one aggregate without a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), F.to_json(F.struct(*rest)))).alias("r")).select(*keys, "r.*")


def confirmed(rows: DataFrame, ledger: DataFrame, token: str, ledger_token: str = "evaluation_token", blank_ok: bool = False) -> DataFrame:
    """Rows whose token the ledger has (blank tokens too, if allowed): a revision is visible once its evaluation is recorded."""
    seen = confirmed_by(rows, ledger.select(F.col(ledger_token).alias(token)), [token])
    return seen.unionByName(rows.where(F.col(token) == "")) if blank_ok else seen


def confirmed_by(rows: DataFrame, audit: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the audit has by all keys: of a bootstrap (scope, token, hash, revision), a transition (incident, transition, revision) or an effect (token, hash)."""
    return rows.join(audit.select(*keys), keys, "left_semi")


#: Columns of the history of inputs, of which the fingerprint is made.
HISTORY = ("input_kind", "input_id", "occurred_at", "observed_at", "rule_id", "rule_version", "severity", "platform", "vendor", "product", "source_type", "host_name", "user_name", "source_ip", "destination_ip", "protocol", "signature_id", "event_code", "event_category", "event_action")


def input_history(inputs: DataFrame) -> DataFrame:
    """What an input was when it came, with the fingerprint of its content (all but the time of its observation)."""
    have = set(inputs.columns)
    cols = [(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in HISTORY]
    content = F.struct(*[c for c in HISTORY if c != "observed_at"])
    return inputs.select(*cols).withColumn("semantic_fingerprint", F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256))


EVIDENCE = ("input_kind", "input_id", "occurred_at", "observed_at", "rule_id", "severity", "source_type", "host_name", "user_name", "source_ip")


def evidence(inputs: DataFrame, summary: str = "rule_name", most: int = 512) -> DataFrame:
    """The snapshot of an input that its link keeps: ten fields and a summary of at most 512 characters."""
    have = set(inputs.columns)
    pick = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    said = F.coalesce(pick(summary), pick("event_action"), F.lit(""))
    return inputs.select(*[pick(c).alias(c) for c in EVIDENCE], F.substring(said, 1, most).alias("summary"))


def with_links(incidents: DataFrame, links: DataFrame, id: str, member: str, name: str) -> DataFrame:
    """incidents with the sorted set of their link ids; none is an empty array."""
    sets = links.groupBy(id).agg(F.array_sort(F.collect_set(member)).alias(name))
    return incidents.join(sets, id, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def timeline(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of several sources, each with its ``entry_kind``, aligned by name."""
    out = None
    for kind, df in parts:
        df = df.withColumn("entry_kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out

"""Incremental correlation of one rule: batches of inputs against a ledger, with effects that show only once the ledger has them.

A batch is decided against the stored inputs of its groups within a window and the groups' open episodes, written down once, and then takes effect in order: incidents, links,
read-back, ledger, schedule. Effects carry the token of the evaluated input and the hash of its decision; a row shows if the ledger has both. So a batch that breaks off anywhere leaves
rows that nobody sees, and the next one decides the same inputs anew. Inputs whose evaluation fails stay out of the ledger and hold up no others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correlate, incidents, incremental, lifecycle, views
from ..operators.correlation_rules import CorrelationRule
from ..operators.range_join import range_join
from .store import Store

_SCOPE = "engine_id string, rule_id string, rule_version int, scope string"
_EFFECT = "token string, state_hash string"
LEDGER = f"{_SCOPE}, input_kind string, input_id string, occurred_at timestamp, observed_at timestamp, group_json string, action string, lateness string, reason_code string, incident_id string, {_EFFECT}, evaluated_at timestamp"
REVISION = f"{_SCOPE}, incident_id string, group_json string, action string, lateness string, episode_start_ms long, episode_end_ms long, late_accept_until_ms long, anchor_kind string, anchor_id string, anchor_ms long, collision_count int, occurred_ms long, {_EFFECT}"
LINK = f"{_SCOPE}, incident_id string, input_kind string, input_id string, relationship string, link_id string, {_EFFECT}"
SCHEDULE = f"{_SCOPE}, batch long, evaluated long, matched long, created long, updated long, links long, invalid long, late_outside long, outside_horizon long, failed long, blocked boolean, updated_at timestamp"
VIOLATION = "correlation_rule_id string, violation_type string, input_kind string, input_id string, projection_name string, detected_at timestamp"
TRANSITION = "incident_id string, group_json string, transition_id string, to_status string, closed_ms long, revision int"


class BrokenOff(RuntimeError):
    pass


class CorrelationEngine:
    def __init__(self, spark: SparkSession, store: Store, rule: CorrelationRule, engine_id: str = "correlation", floor=None):
        """floor: a timestamp from which on inputs count, by either clock; kept from the first time that the scope is seen."""
        if rule.kind == "join":
            raise ValueError("joins are evaluated in batches: incidents.evaluate")
        self.spark, self.store, self.rule, self.engine_id = spark, store, rule, engine_id
        self.scope = {"engine_id": engine_id, "rule_id": rule.id, "rule_version": rule.version, "scope": rule.fingerprint}
        self.floor = None
        if floor is not None:
            self.floor = store.enrolled_since(self.scope, spark.createDataFrame([(floor,)], "at timestamp"), "at")

    def _own(self, name: str, schema: str) -> DataFrame:
        return self.store.read(name, schema).where(incremental.all_of(*[F.col(k) == v for k, v in self.scope.items()]))

    def ledger(self) -> DataFrame:
        return self._own("correlation_ledger", LEDGER)

    def confirmed(self, name: str, schema: str) -> DataFrame:
        return views.confirmed_by(self._own(name, schema), self.ledger(), ["token", "state_hash"])

    def _scoped(self, rows: DataFrame, schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        return rows.withColumns({k: F.lit(v) for k, v in self.scope.items()}).select(*[F.col(n).cast(c.split(" ", 1)[1]).alias(n) for n, c in zip(names, schema.split(", "))])

    def preflight(self, expected: DataFrame, actual: DataFrame, projection: str, keys: tuple[str, str] = ("input_kind", "input_id")) -> bool:
        """Whether two projections hold the same inputs. Differences are recorded, and a batch of a blocked scope changes nothing."""
        found = incremental.integrity_differences(expected.select(*keys), actual.select(*keys))
        if found.isEmpty():
            return True
        self.store.append("integrity_events", found.select(F.lit(self.rule.id).alias("correlation_rule_id"), F.concat(F.lit("only_in_"), "side").alias("violation_type"), *keys, F.lit(projection).alias("projection_name"), F.current_timestamp().alias("detected_at")))
        return False

    def _states(self) -> DataFrame:
        """group_json, states: the confirmed episodes of each group, with their members, as of their last revision."""
        members = self.confirmed("links", LINK).groupBy("incident_id").agg(F.collect_list(F.struct(F.col("input_kind").alias("kind"), F.col("input_id").alias("id"), F.col("relationship").alias("role"))).alias("members"))
        last = views.latest_revision(self.confirmed("incidents", REVISION), ["incident_id"], ["collision_count", "occurred_ms", "token"])
        one = F.struct("incident_id", F.col("episode_start_ms").alias("start"), F.col("episode_end_ms").alias("end"), F.col("late_accept_until_ms").alias("deadline"), "anchor_kind", "anchor_id", F.col("anchor_ms").alias("anchor_at"), F.col("collision_count").alias("collisions"), "members")
        return last.join(members, "incident_id").groupBy("group_json").agg(F.collect_list(one).alias("states"))

    def closures(self) -> DataFrame:
        return self.store.read("transitions", TRANSITION).where("to_status = 'closed'").groupBy("incident_id", "group_json").agg(F.min("closed_ms").alias("closed_ms"))

    def _decide(self, inputs: DataFrame, staging: str) -> DataFrame:
        """Decisions on what the ledger lacks, with clocks, token and hash. Canonical fields and groups are made once, in a staged table: the plan reads its rows five times."""
        rows = incidents.grouped(inputs, self.rule).where("candidate")
        if self.floor is not None:
            rows = incremental.enrolled(rows, F.lit(self.floor), "occurred_at", "observed_at")
        rows = rows.select(*incidents.DEALT, "occurred_at", "observed_at", "invalid_reason")
        self.store.append(staging, rows)
        rows = self.store.read(staging, rows.schema)
        todo = incremental.unevaluated_or_conflicting(rows, self.ledger(), ["input_kind", "input_id"])
        plain = F.col("invalid_reason").isNotNull() | (F.size("roles") == 0) | F.col("group_json").isNull()
        fresh = todo.where(~plain).select(*incidents.DEALT)
        seen = incremental.unevaluated(rows.where(~plain).select(*incidents.DEALT), fresh, ["input_kind", "input_id"])
        near = range_join(seen.withColumn("_at", F.timestamp_millis("occurred_ms")), fresh.select("group_json", F.timestamp_millis("occurred_ms").alias("_new")).distinct(), ["group_json"], "_at", "_new", self.rule.window_ms, how="left_semi").drop("_at", "_lt", "_b")
        dealt = fresh.withColumn("fresh", F.lit(True)).unionByName(near.select(*incidents.DEALT).withColumn("fresh", F.lit(False)))
        out = incidents.evaluate_new(self.rule, dealt, self._states(), self.closures()).unionByName(incidents._decided(todo.where(plain), self.rule))
        clocks = todo.select("input_kind", "input_id", "occurred_ms", "occurred_at", "observed_at").dropDuplicates(["input_kind", "input_id"])
        lit = lambda k: F.lit(self.scope[k]).cast("string")
        token = correlate.evaluation_identity(lit("engine_id"), lit("rule_id"), lit("rule_version"), lit("scope"), F.col("input_kind"), F.col("input_id"))
        return out.withColumn("state_hash", F.sha2(F.to_json(F.struct(*out.columns)), 256)).join(clocks, ["input_kind", "input_id"]).withColumn("token", token)

    def run_batch(self, inputs: DataFrame, batch: int = 0, fail_after: str | None = None, intact: bool = True) -> dict:
        """Evaluate what the ledger lacks of inputs (inputs_of's rows: all that are stored). fail_after names the step after which to break off (tests)."""

        def step(name: str) -> None:
            if fail_after == name:
                raise BrokenOff(f"broken off after {name}")

        if not intact:
            self._schedule(self.spark.createDataFrame([], incidents.DECISION), batch, True)
            return {"batch": batch, "blocked": True}
        staging = f"staging/{uuid.uuid4().hex}"
        try:
            decisions = self._decide(inputs, f"{staging}/rows")
            self.store.append(f"{staging}/decisions", decisions)
            decisions = self.store.read(f"{staging}/decisions", decisions.schema)
            matched = decisions.where("action IN ('created', 'updated', 'enriched_closed')")
            revisions = self._scoped(matched, REVISION)
            self._add("incidents", revisions, ["incident_id", "token", "state_hash"])
            step("incidents")
            made = matched.select("incident_id", F.explode("members").alias("m"), "token", "state_hash").select("incident_id", F.col("m.kind").alias("input_kind"), F.col("m.id").alias("input_id"), F.col("m.role").alias("relationship"), "token", "state_hash")
            links = self._scoped(made.withColumn("link_id", correlate.link_identity(F.col("incident_id"), F.col("input_kind"), F.col("input_id"))), LINK)
            self._add("links", links, ["link_id", "token", "state_hash"])
            step("links")
            self.store.confirm("incidents", revisions, ["incident_id", "token", "state_hash"])
            self.store.confirm("links", links, ["link_id", "token", "state_hash"])
            step("confirmation")
            done = decisions.where("action <> 'failed'").withColumns({"reason_code": F.col("reason"), "evaluated_at": F.current_timestamp()})
            self._add("correlation_ledger", self._scoped(done, LEDGER), ["token", "state_hash"])
            step("ledger")
            return self._schedule(decisions, batch, False)
        finally:
            self.store.drop(staging)

    def _add(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        self.store.append(name, incremental.unevaluated(rows, self.store.read(name, rows.schema), keys))

    def _schedule(self, decisions: DataFrame, batch: int, blocked: bool) -> dict:
        stats = correlate.cycle_statistics(decisions, []).first().asDict()
        row = {**self.scope, "batch": batch, **stats, "blocked": blocked}
        self.store.append("schedule", self.spark.createDataFrame([row], SCHEDULE.rsplit(", ", 1)[0]).withColumn("updated_at", F.current_timestamp()))
        return row

    def incidents(self, inputs: DataFrame) -> DataFrame:
        """The confirmed incidents, recomputed from their confirmed links."""
        rows = self.confirmed("links", LINK).select("incident_id", "input_kind", "input_id").distinct().join(inputs, ["input_kind", "input_id"])
        rolled = correlate.incident_rollup(rows, "incident_id", correlate.SEVERITY[self.rule.incident["severity"]])
        own = self.confirmed("incidents", REVISION).groupBy("incident_id").agg(F.min("group_json").alias("group_json"), F.min("episode_start_ms").alias("episode_start_ms"), F.min("episode_end_ms").alias("episode_end_ms"), F.max("collision_count").alias("collision_count"), F.count(F.lit(1)).alias("revision"))
        status = self.store.read("transitions", TRANSITION).groupBy("incident_id").agg(F.max_by("to_status", "revision").alias("status"))
        return rolled.join(own, "incident_id").join(status, "incident_id", "left").withColumn("status", F.coalesce("status", F.lit("new")))

    def transition(self, incident_id: str, transition_id: str, to: str, at_ms: int) -> lifecycle.Incident:
        """Change the status of one incident; asked for again it changes nothing."""
        own = views.latest_revision(self.confirmed("incidents", REVISION).where(F.col("incident_id") == incident_id), ["incident_id"], ["token"]).first()
        if own is None:
            raise lifecycle.TransitionError(f"unknown incident {incident_id}")
        now = lifecycle.Incident(window_end_ms=own.episode_end_ms, late_accept_until_ms=own.late_accept_until_ms)
        for r in sorted(self.store.read("transitions", TRANSITION).where(F.col("incident_id") == incident_id).collect(), key=lambda r: r.revision):
            now = lifecycle.transition(now, r.transition_id, r.to_status, r.closed_ms or 0)
        new = lifecycle.transition(now, transition_id, to, at_ms)
        if new is not now:
            self.store.append("transitions", self.spark.createDataFrame([(incident_id, own.group_json, transition_id, to, at_ms if to == "closed" else None, new.revision)], TRANSITION))
        return new

    def status(self, inputs: DataFrame) -> dict:
        rows = incidents.grouped(inputs, self.rule).where("candidate")
        left = incremental.backlog(rows, self.ledger(), ["input_kind", "input_id"], "occurred_at").first()
        return {**self.scope, "evaluated": self.ledger().count(), "backlog": left.unevaluated_count, "oldest": left.oldest_unevaluated, "incidents": self.confirmed("incidents", REVISION).select("incident_id").distinct().count()}

"""Queries over the driver's tables, one per operator, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canon, text
from ..operators import collapse, correlate, incremental, range_join, sigma, views
from ..sources.telemetry import EVENTS_SQL, events, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
T = f"WITH t AS ({EVENTS_SQL}) "
MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _rule(detection: dict, id: str = "rule", level: str = "medium", **more) -> sigma.Rule:
    fields = {"Text": "text", "Lang": "lang", "Source": "source", "Url": "url", "Html": "html", "Action": "event_action", "User": "user_name", "Host": "host_name", "Severity": "severity", "Value": "attr", "Prio": "o_orderpriority", "Status": "o_orderstatus"}
    return sigma.compile_rule({"title": id, "id": id, "level": level, "logsource": {"product": "any"}, "detection": detection, **more}, fields, {"product": {"any": ("_any", "any")}})


def _match(df: DataFrame, detection: dict) -> DataFrame:
    rule = _rule(detection)
    rule.logsource.clear()
    return df.where(rule.column())


# --- predicates (F1-F12, F18-F28)


@query("SELECT doc_id, lang, source FROM documents WHERE lower(lang) IN ('de', 'fr')")
def sigma_exact(spark, sf_dir):
    return _match(table(spark, sf_dir, "documents"), {"s": {"Lang": ["DE", "fr"]}, "condition": "s"}).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token =')")
def sigma_contains(spark, sf_dir):
    return _match(table(spark, sf_dir, "documents"), {"s": {"Text|contains": ["License", "token ="]}, "condition": "s"}).select("doc_id", "lang")


@query("SELECT page_id, url FROM pages WHERE starts_with(lower(url), 'https://blog.')")
def sigma_startswith(spark, sf_dir):
    return _match(table(spark, sf_dir, "pages"), {"s": {"Url|startswith": "HTTPS://blog."}, "condition": "s"}).select("page_id", "url")


@query("SELECT page_id, url FROM pages WHERE ends_with(lower(url), '.html') OR ends_with(lower(url), '#top')")
def sigma_endswith(spark, sf_dir):
    return _match(table(spark, sf_dir, "pages"), {"s": {"Url|endswith": [".HTML", "#top"]}, "condition": "s"}).select("page_id", "url")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def sigma_exists(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rule = sigma.Predicate("quality", "exists", (True,))
    return df.where(rule.test(F.col("quality"))).select("doc_id", "quality")


@query(T + "SELECT event_id, event_action, host_name FROM t WHERE (event_action = 'error' OR event_action = 'purchase') AND NOT host_name = 'host-3' AND (severity = 'high' OR severity = 'medium')")
def sigma_condition(spark, sf_dir):
    detection = {"sel_a": {"Action": "ERROR"}, "sel_b": {"Action": "purchase"}, "filter": {"Host": "host-3"}, "sev_1": {"Severity": "high"}, "sev_2": {"Severity": "medium"}, "condition": "(sel_a or sel_b) and not filter and 1 of sev_*"}
    return _match(events(spark, sf_dir), detection).select("event_id", "event_action", "host_name")


@query(T + "SELECT event_id FROM t WHERE event_action = 'click' AND starts_with(user_name, 'user-1') AND ends_with(user_name, '7')")
def sigma_quantifier_all(spark, sf_dir):
    detection = {"a1": {"Action": "click"}, "a2": {"User|startswith": "user-1"}, "a3": {"User|endswith": "7"}, "condition": "all of them"}
    return _match(events(spark, sf_dir), detection).select("event_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderstatus = 'O') OR o_orderpriority IN ('1-URGENT')")
def sigma_not_precedence(spark, sf_dir):
    detection = {"f": {"Status": "F"}, "o": {"Status": "O"}, "u": {"Prio": "1-URGENT"}, "condition": "not (f or o) or u"}
    return _match(table(spark, sf_dir, "orders"), detection).select("o_orderkey", "o_orderstatus")


RULES = [
    {"title": "Error burst value", "id": "error-high-value", "level": "high", "tags": ["attack.execution", "attack.t1059"], "logsource": {"service": "linux_journald"}, "detection": {"a": {"Action": "error"}, "s": {"Severity": "high"}, "condition": "a and s"}},
    {"title": "Purchase by watched users", "id": "purchase-watched", "level": "medium", "tags": ["attack.credential_access", "attack.t1110"], "logsource": {"service": "linux_journald"}, "detection": {"a": {"Action": "purchase"}, "u": {"User|startswith": "user-1"}, "condition": "a and u"}},
    {"title": "Signup outside", "id": "signup-other", "level": "low", "tags": [], "logsource": {"product": "linux"}, "detection": {"a": {"Action": "signup"}, "u": {"Hostname": ["host-1", "host-2"]}, "condition": "a and not u"}},
]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["event_id", "occurred_at", "host_name", "user_name", "source_type", "platform", "event_action"]
    return sigma.detect(events(spark, sf_dir), sigma.compile_rules(RULES), keep=keep)


_HITS = """, r AS (SELECT 'error-high-value' AS rule_id, 'Error burst value' AS rule_name, 'high' AS rule_severity, ['Execution'] AS mitre_tactics, ['T1059'] AS ids, t.* FROM t WHERE event_action = 'error' AND severity = 'high'
 UNION ALL SELECT 'purchase-watched', 'Purchase by watched users', 'medium', ['Credential Access'], ['T1110'], t.* FROM t WHERE event_action = 'purchase' AND starts_with(user_name, 'user-1')
 UNION ALL SELECT 'signup-other', 'Signup outside', 'low', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), t.* FROM t WHERE event_action = 'signup' AND host_name NOT IN ('host-1', 'host-2'))"""
D = T.rstrip() + _HITS + " "


@query(D + "SELECT sha256(rule_id || chr(0) || event_uid) AS detection_id, rule_id, rule_severity AS severity, event_id, host_name FROM r")
def detect_multi_rule(spark, sf_dir):
    return detections(spark, sf_dir).select("detection_id", "rule_id", "severity", "event_id", "host_name")


@query(D + "SELECT rule_severity AS severity, date_trunc('hour', occurred_at) AS bucket, count(*) AS n FROM r GROUP BY ALL")
def detections_by_severity_hour(spark, sf_dir):
    return detections(spark, sf_dir).groupBy("severity", F.date_trunc("hour", F.col("occurred_at")).cast("timestamp_ntz").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(D + "SELECT tactic, count(*) AS n FROM (SELECT unnest(mitre_tactics) AS tactic FROM r) GROUP BY tactic")
def detections_by_tactic(spark, sf_dir):
    return detections(spark, sf_dir).select(F.explode("mitre_tactics").alias("tactic")).groupBy("tactic").agg(F.count(F.lit(1)).alias("n"))


@query(D + "SELECT DISTINCT unnest(ids) AS technique_id FROM r")
def detections_distinct_techniques(spark, sf_dir):
    return detections(spark, sf_dir).select(F.explode("mitre_technique_ids").alias("technique_id")).distinct()


@query(D + "SELECT event_id, rule_id FROM r WHERE len(list_filter(mitre_tactics, lambda x: regexp_matches(x, '^Exec'))) > 0")
def array_exists_match(spark, sf_dir):
    return detections(spark, sf_dir).where(F.exists("mitre_tactics", lambda x: x.rlike("^Exec"))).select("event_id", "rule_id")


@query(D + """SELECT rule_id, event_id, CASE rule_id WHEN 'error-high-value' THEN '{"event_action":"error","severity":"high"}' WHEN 'purchase-watched' THEN '{"event_action":"purchase","user_name":"' || user_name || '"}' ELSE '{"event_action":"signup"}' END AS evidence_json FROM r""")
def detection_evidence(spark, sf_dir):
    return detections(spark, sf_dir).select("rule_id", "event_id", "evidence_json")


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://(www|blog)[.]')")
def regex_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").rlike(r"^https?://(www|blog)[.]")).select("page_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'released under')")
def contains_case_insensitive(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(text.contains_fold(F.col("text"), "Released Under")).select("doc_id")


@query(T + "SELECT event_id FROM t WHERE occurred_at >= TIMESTAMP '2024-01-20 00:00:00' OR occurred_at + attr * INTERVAL 1 HOUR >= TIMESTAMP '2024-01-20 00:00:00'")
def enrollment_floor(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("seen_at", F.col("occurred_at") + F.make_dt_interval(F.lit(0), F.col("attr").cast("int")))
    return incremental.enrolled(e, F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")), "occurred_at", "seen_at").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31' AND o_orderpriority NOT IN ('5-LOW')")
def time_range_not_in(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderdate").between(F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("1996-03-31 00:00:00"))) & ~F.col("o_orderpriority").isin("5-LOW")).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) <= (300, 5000)")
def tuple_comparison(spark, sf_dir):
    place = F.struct(F.col("o_custkey"), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").where(place <= F.struct(F.lit(300).cast("bigint"), F.lit(5000).cast("bigint"))).select("o_orderkey", "o_custkey")


# --- joins (J1-J18)

_LEDGER = ", ledger AS (SELECT event_uid, 'engine' AS engine_id FROM t WHERE event_id % 3 <> 0) "


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_id") % 3 != 0).select("event_uid", F.lit("engine").alias("engine_id"))


@query(T.rstrip() + _LEDGER + "SELECT event_id, event_uid FROM t ANTI JOIN ledger USING (event_uid)")
def ledger_anti_join(spark, sf_dir):
    return incremental.unevaluated(events(spark, sf_dir), ledger_rows(spark, sf_dir), ["event_uid"]).select("event_id", "event_uid")


@query(T.rstrip() + _LEDGER + "SELECT count(*) AS unevaluated_count, min(occurred_at) AS oldest_unevaluated FROM t ANTI JOIN ledger USING (event_uid)")
def ledger_backlog(spark, sf_dir):
    return incremental.backlog(events(spark, sf_dir), ledger_rows(spark, sf_dir), ["event_uid"], "occurred_at")


@query(T.rstrip() + ", s AS (SELECT event_uid, CASE WHEN event_id % 7 = 0 THEN 'conflict' END AS invalid_reason, event_id FROM t), l AS (SELECT event_uid, CASE WHEN event_id % 14 = 0 THEN 'conflict' ELSE '' END AS reason_code FROM s WHERE event_id % 5 <> 0) SELECT s.event_id FROM s LEFT JOIN l USING (event_uid) WHERE l.event_uid IS NULL OR (invalid_reason IS NOT NULL AND reason_code <> invalid_reason)")
def unevaluated_or_conflicting(spark, sf_dir):
    s = events(spark, sf_dir).select("event_uid", "event_id", F.when(F.col("event_id") % 7 == 0, "conflict").alias("invalid_reason"))
    l = s.where(F.col("event_id") % 5 != 0).select("event_uid", F.when(F.col("event_id") % 14 == 0, "conflict").otherwise("").alias("reason_code"))
    return incremental.unevaluated_or_conflicting(s, l, ["event_uid"]).select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R')")
def semi_join_seed(spark, sf_dir):
    seed = table(spark, sf_dir, "lineitem").where("l_quantity >= 49 AND l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(seed, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query(D + "SELECT sha256(rule_id || chr(0) || event_uid) AS detection_id FROM r WHERE event_id % 2 = 1")
def existing_ids_removed(spark, sf_dir):
    d = detections(spark, sf_dir)
    return d.join(d.where(F.col("event_id") % 2 == 0).select("detection_id"), "detection_id", "left_anti").select("detection_id")


@query(T.rstrip() + ", l AS (SELECT DISTINCT event_uid AS token FROM t WHERE event_action = 'view') SELECT event_id FROM t WHERE event_uid IN (SELECT token FROM l)")
def confirmation_join(spark, sf_dir):
    e = events(spark, sf_dir)
    ledger = e.where("event_action = 'view'").select(F.col("event_uid").alias("evaluation_token"))
    return views.confirmed(e, ledger, "event_uid").select("event_id")


@query("SELECT c_custkey, coalesce(k.orders, CAST([] AS VARCHAR[])) AS order_keys FROM customer LEFT JOIN (SELECT o_custkey, list_sort(list(DISTINCT CAST(o_orderkey AS VARCHAR))) AS orders FROM orders GROUP BY o_custkey) k ON c_custkey = o_custkey")
def left_join_link_sets(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("order_key"))
    return views.with_links(table(spark, sf_dir, "customer").select("c_custkey"), links, "c_custkey", "order_key", "order_keys")


@query("SELECT o_orderkey, o_totalprice, total FROM orders JOIN (SELECT l_orderkey, max(l_extendedprice) AS total FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey WHERE o_totalprice IS DISTINCT FROM total")
def mismatch_join(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("total"))
    return incremental.mismatches(table(spark, sf_dir, "orders"), l, ["o_orderkey"], "o_totalprice", "total").select("o_orderkey", "o_totalprice", "total")


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.errors, 0) AS errors, coalesce(b.purchases, 0) AS purchases FROM (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS purchases FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.user_id = b.user_id")
def full_outer_merge(spark, sf_dir):
    of = lambda kind, name: events(spark, sf_dir).where(F.col("event_action") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    return incremental.merged_status(of("error", "errors"), of("purchase", "purchases"), ["user_id"], ["errors", "purchases"])


@query(T + "SELECT event_id, event_uid IN (SELECT event_uid FROM t WHERE event_id % 3 <> 0) AS covered FROM t")
def projection_coverage(spark, sf_dir):
    return incremental.coverage(events(spark, sf_dir), ledger_rows(spark, sf_dir), ["event_uid"]).select("event_id", "covered")


@query("SELECT o_orderkey AS k, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def ledger_source_coverage(spark, sf_dir):
    source = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    ledger = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return incremental.coverage(source, ledger, ["k"]).where("covered").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = l.l_linestatus AND o.o_custkey % 7 = l.l_suppkey % 7)")
def bootstrap_confirmation(spark, sf_dir):
    """A row shows if the audit has it by all of several keys."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("scope"), F.col("l_linestatus").alias("hash"), (F.col("l_suppkey") % 7).alias("revision"))
    audit = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scope"), F.col("o_orderstatus").alias("hash"), (F.col("o_custkey") % 7).alias("revision"))
    return views.confirmed_by(rows, audit, ["scope", "hash", "revision"]).select("l_orderkey", "l_linenumber")


@query(T + "SELECT event_uid AS input_id, sha256('{\"input_kind\":\"event\",\"input_id\":\"' || event_uid || '\",\"occurred_at\":null,\"rule_id\":null,\"rule_version\":null,\"severity\":\"' || severity || '\",\"platform\":\"linux\",\"vendor\":null,\"product\":null,\"source_type\":\"linux_journald\",\"host_name\":\"' || host_name || '\",\"user_name\":\"' || user_name || '\",\"source_ip\":null,\"destination_ip\":null,\"protocol\":null,\"signature_id\":null,\"event_code\":null,\"event_category\":null,\"event_action\":\"' || event_action || '\"}') AS semantic_fingerprint FROM t")
def input_history(spark, sf_dir):
    e = events(spark, sf_dir).select(F.lit("event").alias("input_kind"), F.col("event_uid").alias("input_id"), F.lit(None).cast("string").alias("occurred_at"), "severity", "platform", "source_type", "host_name", "user_name", "event_action")
    return views.input_history(e).select("input_id", "semantic_fingerprint")


@query("SELECT CAST(doc_id AS VARCHAR) AS input_id, source AS host_name, substring(coalesce(text, ''), 1, 512) AS summary FROM documents")
def evidence_snapshot(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("event").alias("input_kind"), F.col("doc_id").cast("string").alias("input_id"), F.col("source").alias("host_name"), "text")
    return views.evidence(d, "text").select("input_id", "host_name", "summary")


@query(T + "SELECT a.event_id AS error_id, b.event_id AS click_id FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_action = 'error' AND b.event_action = 'click' AND abs(epoch_ms(a.occurred_at) - epoch_ms(b.occurred_at)) <= 3600000")
def corr_join_equals(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.where("event_action = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("occurred_at").alias("error_at"))
    right = e.where("event_action = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("occurred_at").alias("click_at"))
    return correlate.join_pairs(left, right, ["user_id"], "error_at", "click_at", HOUR).select("error_id", "click_id")


@query(T + """SELECT a.event_id AS a_id, b.event_id AS b_id, c.event_id AS c_id FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_action = 'error' AND b.event_action = 'click' JOIN t c ON a.user_id = c.user_id AND c.event_action = 'purchase'
 WHERE greatest(epoch_ms(a.occurred_at), epoch_ms(b.occurred_at), epoch_ms(c.occurred_at)) - least(epoch_ms(a.occurred_at), epoch_ms(b.occurred_at), epoch_ms(c.occurred_at)) <= 14400000""")
def corr_join_three(spark, sf_dir):
    e = events(spark, sf_dir)
    part = lambda action, p: e.where(F.col("event_action") == action).select("user_id", F.col("event_id").alias(f"{p}_id"), F.col("occurred_at").alias(f"{p}_at"))
    two = range_join.range_join(part("error", "a"), part("click", "b"), ["user_id"], "a_at", "b_at", 4 * HOUR)
    three = range_join.range_join(two, part("purchase", "c"), ["user_id"], "a_at", "c_at", 4 * HOUR)
    return three.where(range_join.span_ok([F.col("a_at"), F.col("b_at"), F.col("c_at")], 4 * HOUR)).select("a_id", "b_id", "c_id")


@query(T.rstrip() + """, s AS (SELECT user_id, list(DISTINCT attr) AS attrs FROM t WHERE event_action = 'error' GROUP BY user_id), u AS (SELECT host_name, list(DISTINCT attr) AS attrs FROM t WHERE event_action = 'signup' GROUP BY host_name)
 SELECT user_id, host_name, list_sort(list_intersect(s.attrs, u.attrs)) AS shared FROM s JOIN u ON list_has_any(s.attrs, u.attrs)""")
def corr_join_intersects(spark, sf_dir):
    e = events(spark, sf_dir)
    s = e.where("event_action = 'error'").groupBy("user_id").agg(F.collect_set("attr").alias("a"))
    u = e.where("event_action = 'signup'").groupBy("host_name").agg(F.collect_set("attr").alias("b"))
    return range_join.overlap_join(s, u, "a", "b", "user_id", "host_name")


@query(T.rstrip() + """, p AS (SELECT a.event_id AS error_id, b.event_id AS click_id, a.user_id, a.occurred_at AS at FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_action = 'error' AND b.event_action = 'click' AND abs(epoch_ms(a.occurred_at) - epoch_ms(b.occurred_at)) <= 3600000)
 SELECT error_id, click_id, list_sort(list(DISTINCT c.event_id)) AS related, count(DISTINCT c.event_id) AS n_related FROM p JOIN t c ON c.user_id = p.user_id AND c.event_action = 'view' AND epoch_ms(c.occurred_at) - epoch_ms(p.at) BETWEEN 0 AND 86400000 GROUP BY error_id, click_id""")
def ownership_expand(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.where("event_action = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("occurred_at").alias("error_at"))
    right = e.where("event_action = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("occurred_at").alias("click_at"))
    pairs = correlate.join_pairs(left, right, ["user_id"], "error_at", "click_at", HOUR).select("user_id", "error_id", "click_id", "error_at")
    context = e.where("event_action = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("occurred_at").alias("view_at"))
    return correlate.ownership(pairs, context, ["user_id"], "error_at", "view_at", DAY, ["error_id", "click_id"], "view_id")


# --- aggregates (A1-A24)


@query("SELECT count(*) AS n FROM events")
def count_all(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"))


@query(T + "SELECT user_name, count(*) AS n FROM t GROUP BY user_name ORDER BY n DESC, user_name LIMIT 10")
def top_k(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_name").limit(10)


@query(T + "SELECT time_bucket(INTERVAL '6 hours', occurred_at, TIMESTAMP '1970-01-01') AS bucket, event_action, count(*) AS n FROM t GROUP BY ALL")
def time_bucket(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy(F.window("occurred_at", "6 hours").start.alias("bucket"), "event_action").agg(F.count(F.lit(1)).alias("n"))


@query(T + "SELECT host_name, count(*) FILTER (event_action = 'error') AS errors, count(*) FILTER (severity IN ('high', 'medium')) AS severe, count(*) AS n FROM t GROUP BY host_name")
def count_if(spark, sf_dir):
    return events(spark, sf_dir).groupBy("host_name").agg(F.count_if(F.col("event_action") == "error").alias("errors"), F.count_if(F.col("severity").isin("high", "medium")).alias("severe"), F.count(F.lit(1)).alias("n"))


@query(T + "SELECT host_name, count(DISTINCT user_id) AS users, count(DISTINCT (user_id, event_action)) AS user_actions, count(DISTINCT user_id) FILTER (event_action = 'error') AS users_with_error FROM t GROUP BY host_name")
def uniq_exact(spark, sf_dir):
    return events(spark, sf_dir).groupBy("host_name").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.struct("user_id", "event_action")).alias("user_actions"), F.count_distinct(F.when(F.col("event_action") == "error", F.col("user_id"))).alias("users_with_error"))


@query(T + "SELECT min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, min(attr) FILTER (event_action = 'none') AS none, max(value) AS top FROM t")
def min_max_or_null(spark, sf_dir):
    return events(spark, sf_dir).agg(F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.min(F.when(F.col("event_action") == "none", F.col("attr"))).alias("none"), F.max("value").alias("top"))


@query(T + "SELECT user_id, arg_max(event_action, (occurred_at, event_id)) AS last_action, arg_min(event_action, (occurred_at, event_id)) AS first_action FROM t GROUP BY user_id")
def arg_max_min(spark, sf_dir):
    at = F.struct("occurred_at", "event_id")
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_action", at).alias("last_action"), F.min_by("event_action", at).alias("first_action"))


@query(T + "SELECT host_name, list_sort(list(DISTINCT event_action)) AS actions, len(list(DISTINCT user_id)) AS n_users FROM t GROUP BY host_name")
def sorted_set_agg(spark, sf_dir):
    return events(spark, sf_dir).groupBy("host_name").agg(F.array_sort(F.collect_set("event_action")).alias("actions"), F.size(F.collect_set("user_id")).cast("bigint").alias("n_users"))


@query(T + "SELECT host_name, sha256(array_to_string(list_sort(list(event_action || '|' || user_id)), chr(0))) AS fingerprint, count(*) AS n FROM t GROUP BY host_name")
def group_fingerprint(spark, sf_dir):
    return collapse.fingerprint(events(spark, sf_dir), ["host_name"], ["event_action", "user_id"])


@query("SELECT c_mktsegment, CAST(coalesce(sum(CAST(c_acctbal AS DECIMAL(18,2))) FILTER (c_acctbal < -990), 0) AS DECIMAL(28,2)) AS low_sum, coalesce(max(c_acctbal) FILTER (c_acctbal > 99999), 0.0) AS top FROM customer GROUP BY c_mktsegment")
def sum_or_zero(spark, sf_dir):
    low = F.sum(F.when(F.col("c_acctbal") < -990, F.col("c_acctbal").cast("decimal(18,2)")))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.coalesce(low, F.lit(0).cast("decimal(18,2)")).alias("low_sum"), F.coalesce(F.max(F.when(F.col("c_acctbal") > 99999, F.col("c_acctbal"))), F.lit(0.0)).alias("top"))


@query(T + "SELECT user_id, bool_or(event_action = 'error') AS had_error FROM t GROUP BY user_id HAVING count(*) >= 60")
def any_having(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.bool_or(F.col("event_action") == "error").alias("had_error"), F.count(F.lit(1)).alias("n")).where("n >= 60").select("user_id", "had_error")


_RAW = """, raw AS (SELECT event_action || '-' || (event_id % 500) AS input_id, occurred_at AS observed_at, CASE WHEN event_id % 97 = 0 THEN NULL ELSE TIMESTAMP '2024-02-01' END AS happened, CASE WHEN event_id % 11 = 0 THEN host_name ELSE 'h' END AS host FROM t)"""


@query(T.rstrip() + _RAW + " SELECT input_id, min(observed_at) AS observed_at, arg_min(host, observed_at) AS host, count(*) AS copies, count(DISTINCT coalesce(CAST(happened AS VARCHAR), '') || '|' || host) AS variants, CASE WHEN bool_or(first_at IS NULL) THEN 'missing_occurrence_time' WHEN count(DISTINCT coalesce(CAST(happened AS VARCHAR), '') || '|' || host) > 1 THEN 'conflicting_immutable_values' END AS invalid_reason FROM (SELECT *, first_value(happened) OVER (PARTITION BY input_id ORDER BY observed_at) AS first_at FROM raw) GROUP BY input_id")
def logical_source_collapse(spark, sf_dir):
    e = events(spark, sf_dir)
    raw = e.select(F.concat_ws("-", "event_action", (F.col("event_id") % 500).cast("string")).alias("input_id"), F.col("occurred_at").alias("observed_at"), F.when(F.col("event_id") % 97 != 0, F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))).alias("happened"), F.when(F.col("event_id") % 11 == 0, F.col("host_name")).otherwise("h").alias("host"))
    return collapse.logical_source(raw, "input_id", "happened", "observed_at", ["host"]).select("input_id", "observed_at", "host", "copies", "variants", "invalid_reason")


_MEMBERS = D.rstrip() + """, m AS (SELECT user_id AS incident, 'detection' AS input_kind, rule_severity AS severity, rule_id, source_type, occurred_at FROM r UNION ALL SELECT user_id, 'event', '', NULL, 'windows_sysmon', occurred_at FROM t WHERE event_action = 'view') """


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).select(F.substring("user_name", 6, 20).cast("bigint").alias("incident"), F.lit("detection").alias("input_kind"), "severity", "rule_id", "source_type", "occurred_at")
    v = events(spark, sf_dir).where("event_action = 'view'").select(F.col("user_id").alias("incident"), F.lit("event").alias("input_kind"), F.lit("").alias("severity"), F.lit(None).cast("string").alias("rule_id"), F.lit("windows_sysmon").alias("source_type"), "occurred_at")
    return d.unionByName(v)


@query(_MEMBERS + """SELECT incident, count(*) AS input_count, count(*) FILTER (input_kind = 'detection') AS detection_count, count(*) FILTER (input_kind = 'event') AS event_count,
 greatest(1, max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END)) AS severity_rank, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, count(DISTINCT rule_id) AS distinct_rule_count,
 count(DISTINCT CASE WHEN starts_with(source_type, 'windows') THEN 'windows' WHEN starts_with(source_type, 'linux') THEN 'linux' ELSE source_type END) AS source_family_count, list_sort(coalesce(list(DISTINCT rule_id) FILTER (rule_id IS NOT NULL), CAST([] AS VARCHAR[]))) AS rule_ids FROM m GROUP BY incident""")
def incident_rollup(spark, sf_dir):
    return correlate.incident_rollup(members(spark, sf_dir), "incident")


# --- windows (W1-W6), order, sets (O1-O12)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_revision(spark, sf_dir):
    return views.latest_revision(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def earliest_introduction(spark, sf_dir):
    return views.earliest_introduction(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def replacing_final(spark, sf_dir):
    return views.replacing(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_date, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS any_f FROM orders")
def window_min_any(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.min("o_orderdate").over(w).alias("first_date"), F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).over(w).alias("any_f"))


@query(T + "SELECT event_action, event_id FROM t QUALIFY row_number() OVER (PARTITION BY event_action, user_id ORDER BY occurred_at, event_id) = 1")
def limit_one_by(spark, sf_dir):
    return incremental.first_per_key(events(spark, sf_dir), ["event_action", "user_id"], ["occurred_at", "event_id"]).select("event_action", "event_id")


@query("SELECT o_custkey, o_orderkey FROM orders ORDER BY CASE WHEN (o_custkey, o_orderkey) <= (700, 8000) THEN 1 ELSE 0 END, o_custkey, o_orderkey LIMIT 200")
def rotating_page(spark, sf_dir):
    cursor = (F.lit(700).cast("bigint"), F.lit(8000).cast("bigint"))
    return incremental.rotating_page(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], cursor, 200)


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT c_nationkey FROM customer")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).union(table(spark, sf_dir, "customer").select("c_nationkey"))


@query("SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("(SELECT p_partkey AS k, 'expected' AS side FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)) UNION (SELECT o_custkey, 'actual' FROM orders WHERE o_custkey NOT IN (SELECT p_partkey FROM part))")
def parity_except(spark, sf_dir):
    return incremental.integrity_differences(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT range AS n FROM range(1001) UNION ALL SELECT 0")
def numbers(spark, sf_dir):
    return spark.range(1001).select(F.col("id").alias("n")).union(spark.sql("SELECT CAST(0 AS BIGINT)"))


@query("WITH a AS (SELECT max(o_totalprice) AS top FROM orders) SELECT o_orderkey, o_totalprice, (SELECT top FROM a) AS top FROM orders WHERE o_totalprice >= 0.999 * (SELECT top FROM a)")
def scalar_subquery(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("ws_orders")
    return spark.sql("WITH a AS (SELECT max(o_totalprice) AS top FROM ws_orders) SELECT o_orderkey, o_totalprice, (SELECT top FROM a) AS top FROM ws_orders WHERE o_totalprice >= 0.999D * (SELECT top FROM a)")


@query(T + "SELECT 'event' AS entry_kind, event_id AS id, occurred_at FROM t UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders")
def timeline(spark, sf_dir):
    a = events(spark, sf_dir).select(F.col("event_id").alias("id"), "occurred_at")
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("occurred_at"))
    return views.timeline([("event", a), ("order", b)]).select("entry_kind", "id", "occurred_at")


# --- correlation (A18, ST5-ST10)


@query(T + "SELECT event_id, n, n_distinct FROM (SELECT event_id, count(*) OVER w AS n, len(list_distinct(list(event_action) OVER w)) AS n_distinct FROM (SELECT *, epoch_ms(occurred_at) AS ms FROM t) WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)) WHERE n >= 2 AND n_distinct >= 2")
def corr_threshold(spark, sf_dir):
    return correlate.threshold_qualified(events(spark, sf_dir), ["user_id"], "occurred_at", HOUR, 2, "event_action", 2).select("event_id", "n", "n_distinct")


@query(T + "SELECT b.event_id FROM t b JOIN t a ON a.user_id = b.user_id AND b.event_action = 'purchase' AND a.event_action = 'error' AND epoch_ms(a.occurred_at) < epoch_ms(b.occurred_at) AND epoch_ms(b.occurred_at) - epoch_ms(a.occurred_at) <= 172800000 GROUP BY b.event_id HAVING count(*) >= 2")
def corr_sequence(spark, sf_dir):
    stages = [(F.col("event_action") == "error", 2), (F.col("event_action") == "purchase", 1)]
    return correlate.sequence_qualified(events(spark, sf_dir), ["user_id"], "occurred_at", 2 * DAY, stages).select("event_id")


@query(T + """SELECT DISTINCT c.event_id FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_action = 'error' AND b.event_action = 'click' AND epoch_ms(a.occurred_at) < epoch_ms(b.occurred_at) JOIN t c ON c.user_id = b.user_id AND c.event_action = 'purchase' AND epoch_ms(b.occurred_at) < epoch_ms(c.occurred_at)
 WHERE epoch_ms(c.occurred_at) - epoch_ms(a.occurred_at) <= 86400000""")
def corr_sequence_three(spark, sf_dir):
    stages = [(F.col("event_action") == "error", 1), (F.col("event_action") == "click", 1), (F.col("event_action") == "purchase", 1)]
    return correlate.sequence_qualified(events(spark, sf_dir), ["user_id"], "occurred_at", DAY, stages).select("event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, min(ts) AS start FROM events GROUP BY user_id UNION ALL SELECT e.user_id, (SELECT min(ts) FROM events x WHERE x.user_id = e.user_id AND epoch_ms(x.ts) > epoch_ms(e.start) + 86400000) FROM e WHERE (SELECT min(ts) FROM events x WHERE x.user_id = e.user_id AND epoch_ms(x.ts) > epoch_ms(e.start) + 86400000) IS NOT NULL)
 SELECT user_id, start AS episode_start, (SELECT count(*) FROM events x WHERE x.user_id = e.user_id AND epoch_ms(x.ts) BETWEEN epoch_ms(e.start) AND epoch_ms(e.start) + 86400000) AS n FROM e""")
def episode_assign(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    out = correlate.episodes(e, ["user_id"], "at", DAY, "event_id")
    return out.groupBy("user_id", F.col("episode_start").cast("timestamp_ntz").alias("episode_start")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN epoch_ms(ts) + attr <= epoch_ms(ts) + 40 THEN 'on_time' WHEN epoch_ms(ts) + attr <= epoch_ms(ts) + 80 THEN 'late_within_boundary' ELSE 'late_outside_boundary' END AS lateness FROM (SELECT event_id, date_trunc('millisecond', ts) AS ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS attr FROM events)")
def lateness_status(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.date_trunc("millisecond", F.col("occurred_at").cast("timestamp")).alias("at"), "attr")
    after = lambda ms: F.timestamp_millis(F.unix_millis("at") + ms)
    return e.select("event_id", correlate.lateness(F.col("at"), after(F.col("attr")), after(F.lit(40)), 40).alias("lateness"))


@query(T + "SELECT user_id, arg_min(event_uid, (abs(epoch_ms(occurred_at) - epoch_ms(TIMESTAMP '2024-01-15')), host_name, event_uid)) AS owner FROM t WHERE event_action = 'error' GROUP BY user_id")
def nearest_anchor(spark, sf_dir):
    e = events(spark, sf_dir).where("event_action = 'error'")
    distance = F.abs(F.unix_millis(F.col("occurred_at").cast("timestamp")) - F.lit(1705276800000))
    return correlate.nearest_anchor(e, "user_id", distance, "host_name", "event_uid").select("user_id", F.col("event_uid").alias("owner"))


# --- scalar functions and identities


@query("SELECT page_id, regexp_replace(url, '^.*[\\\\/]', '') AS base, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages")
def basename_and_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("base"), F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)).alias("host"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS stamp, strftime(ts, '%Y%m') AS yyyymm FROM events")
def json_and_time_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"), text.stamp(F.col("ts")).alias("stamp"), F.date_format("ts", "yyyyMM").alias("yyyymm"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE lower(replace(s_name, '#', '-')) END AS host FROM supplier")
def canonical_host(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.lit("bad..host")).otherwise(F.concat(F.lit(" "), F.replace(F.col("s_name"), F.lit("#"), F.lit("-")), F.lit(". ")))
    return s.select("s_suppkey", canon.canonical_host(raw).alias("host"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'dom\\' || lower(c_name) WHEN 1 THEN lower(c_name) || '@dom' WHEN 2 THEN lower(c_name) ELSE c_name END AS principal FROM customer")
def canonical_principal(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("DOM\\"), F.col("c_name"))).when(k == 1, F.concat(F.col("c_name"), F.lit("@Dom"))).otherwise(F.col("c_name"))
    return c.select("c_custkey", canon.display_principal(canon.canonical_principal(raw, F.when(k == 3, "linux").otherwise("windows"))).alias("principal"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '10.' || (o_orderkey % 256) || '.' || (o_custkey % 256) || '.7' END AS ip, o_orderkey % 5 <> 0 AS internal FROM orders")
def canonical_address(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = F.concat(F.when(F.col("o_orderkey") % 5 == 0, F.lit("300.")).when(F.col("o_orderkey") % 5 == 1, F.lit("::ffff:10.")).otherwise("10."), F.col("o_orderkey") % 256, F.lit("."), F.col("o_custkey") % 256, F.lit(".7"))
    ip = canon.canonical_ipv4(raw)
    return o.select("o_orderkey", ip.alias("ip"), F.coalesce(~canon.external_ip(ip), F.lit(False)).alias("internal"))


@query(T + """SELECT event_id, '{"host_name":"' || host_name || '","user_name":"' || user_name || '"}' AS group_json, sha256('{"host_name":"' || host_name || '","user_name":"' || user_name || '"}') AS group_hash FROM t""")
def group_identity(spark, sf_dir):
    e = events(spark, sf_dir)
    g = canon.group_json({"host_name": F.col("host_name"), "user_name": F.col("user_name")})
    return e.select("event_id", g.alias("group_json"), F.sha2(g, 256).alias("group_hash"))


@query(T + "SELECT event_id, sha256('wardstone-incident-v1' || chr(0) || 'r' || chr(0) || '1' || chr(0) || 'scope' || chr(0) || host_name || chr(0) || 'event:' || event_uid) AS incident_id FROM t")
def deterministic_identity(spark, sf_dir):
    i = correlate.incident_identity(F.lit("r"), F.lit("1"), F.lit("scope"), F.col("host_name"), F.lit("event"), F.col("event_uid"))
    return events(spark, sf_dir).select("event_id", i.alias("incident_id"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN ['status'] ELSE CAST([] AS VARCHAR[]) END || CASE WHEN o_totalprice <= 1000 THEN ['price'] ELSE CAST([] AS VARCHAR[]) END AS failed_checks FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR o_totalprice <= 1000")
def check_constraints(spark, sf_dir):
    _, bad = incremental.validate(table(spark, sf_dir, "orders"), {"status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice") > 1000})
    return bad.select("o_orderkey", "failed_checks")

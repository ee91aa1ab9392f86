import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardstone.operators import incidents, lifecycle, sigma
from wardstone.operators.correlation_rules import CorrelationError, compile_correlation
from wardstone.sources.rules import DocumentError, fixture, parse_strict, shipped

LAB = {"platform": "windows", "source_type": "windows_sysmon", "event_id": 1}
CASES = {
    "linux-authentication-failure": ({"platform": "linux", "source_type": "linux_journald", "event_category": "authentication", "outcome": "failure", "user_name": "ann"}, {"user_name": ""}),
    "linux-download-execute": ({"platform": "linux", "source_type": "linux_auditd", "process_path": "/usr/bin/curl", "command_line": "curl https://x | sh"}, {"command_line": "curl https://x"}),
    "linux-sudo-shell": ({"platform": "linux", "source_type": "linux_auditd", "event_action": "sudo_command", "command_line": "/bin/BASH"}, {"command_line": "/usr/bin/id"}),
    "network-dynamic-dns-query": ({"platform": "network", "source_type": "suricata_eve", "event_category": "dns", "domain": "a.DUCKDNS.org"}, {"domain": "example.com"}),
    "network-lab-signature": ({"platform": "network", "source_type": "suricata_eve", "event_kind": "alert", "signature_id": "9000001", "signature": "LAB TEST 1"}, {"signature_id": "1"}),
    "network-high-severity-alert": ({"platform": "network", "source_type": "suricata_eve", "event_kind": "alert", "severity": "Critical", "signature": "s"}, {"severity": "low"}),
    "windows-encoded-powershell": (LAB | {"process_path": "C:\\W\\powershell.exe", "command_line": "powershell.exe -NoProfile -enc VwBy"}, {"command_line": "powershell.exe -Command Get-Date"}),
    "windows-command-shell-chain": (LAB | {"process_path": "C:\\W\\cmd.exe", "command_line": "cmd /c certutil -urlcache -f x"}, {"command_line": "cmd /c certutil -urlcache LAB-ALLOW-TEST"}),
    "windows-proxy-execution": (LAB | {"process_path": "C:\\W\\mshta.exe", "command_line": "mshta.exe https://lab.invalid/a.hta"}, {"event_id": 3}),
}
COLUMNS = sorted({k for a, b in CASES.values() for k in [*a, *b]})


def test_shipped_rules_match_their_cases(spark):
    rules = sigma.compile_rules(shipped("detection"))
    assert {r.id for r in rules} == set(CASES)
    rows = [(f"{name}{'+' if good else '-'}", *[None if (v := (a if good else a | b).get(c)) is None else str(v) for c in COLUMNS]) for name, (a, b) in CASES.items() for good in (True, False)]
    df = spark.createDataFrame(rows, ", ".join(["event_uid string", *[f"{c} string" for c in COLUMNS]])).withColumn("event_id", F.col("event_id").cast("int"))
    got = {(r.rule_id, r.source_event_uid) for r in sigma.detect(df, rules, keep=["event_uid"]).collect()}
    assert got == {(n, f"{n}+") for n in CASES}
    assert all(r.matches(CASES[r.id][0]) and not r.matches(CASES[r.id][0] | CASES[r.id][1]) for r in rules)


@pytest.mark.parametrize("change", [{"Text|contains": "a*"}, {"Nope": "a"}, {"Image|re": "a"}, {"Image|contains|all": "a"}, {"Image": []}, {"Image": None}, {"User|exists": "yes"}, {"Image|contains": ""}, {"Image|startswith": 1}, {"Image|endswith": ["a", ""]}])
def test_rules_fail_closed(change):
    doc = {"title": "t", "id": "i", "level": "low", "logsource": {"product": "linux"}, "detection": {"s": change, "condition": "s"}}
    with pytest.raises(sigma.RuleError):
        sigma.compile_rule(doc)


@pytest.mark.parametrize("condition", ["", "s and", "(s", "s t", "1 of x*", "nope", "s; s", "a" * 600])
def test_bad_conditions(condition):
    with pytest.raises(sigma.RuleError):
        sigma.parse_condition(condition, ["s"])


def test_compiled_column_equals_interpreter(spark):
    rng = random.Random(1)
    values = [None, "", "Alpha", "alphabet", "beta", "10", "0"]
    rows = [(i, *[rng.choice(values) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a string, b string, c string")
    fields = {"A": "a", "B": "b", "C": "c"}
    detections = [{"x": {f"{rng.choice('ABC')}|{op}" if op != "exact" else rng.choice("ABC"): rng.choice([True, False]) if op == "exists" else rng.choice(["alpha", ["BETA", "1"], 10 if op == "exact" else "a"])}, "y": {"B": ["beta", ""]}, "condition": rng.choice(["x", "not x", "x and not y", "1 of them", "all of them or not (x or y)"])} for op in sigma.OPERATORS for _ in range(6)]
    cols = []
    for n, d in enumerate(detections):
        rule = sigma.compile_rule({"title": "t", "id": str(n), "level": "low", "logsource": {"p": "q"}, "detection": d}, fields, {"p": {"q": ("a", "a")}})
        rule.logsource.clear()
        cols.append((rule, rule.column().alias(f"m{n}")))
    for r in df.select("*", *[c for _, c in cols]).collect():
        for n, (rule, _) in enumerate(cols):
            assert r[f"m{n}"] == rule.matches(r.asDict()), (rule.plan(), r)


@pytest.mark.parametrize("text", ["a: 1\na: 2", "a: &x 1\nb: *x", "a: !t 1", "- 1", "a: " + "[" * 20 + "]" * 20, "x: " + "y" * 70_000, "a: 1\n---\nb: 2"])
def test_strict_documents(text):
    with pytest.raises(DocumentError):
        parse_strict(text)


def test_fixture_keys():
    assert fixture('{"a": 1}', {"a"}) == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', '{"b": 1}'):
        with pytest.raises(DocumentError):
            fixture(bad, {"a"})


def _rule(name):
    return compile_correlation(next(d for d in shipped("correlation") if d["id"] == name))


@pytest.mark.parametrize("path,value", [("window", "2h"), ("window", "5x"), ("group_by", []), ("group_by", ["nope"]), ("schema", "x"), ("selectors", {}), ("correlate", {"type": "x"}), ("extra", 1), ("version", 0)])
def test_correlation_fails_closed(path, value):
    doc = next(d for d in shipped("correlation") if d["id"] == "host-suspicious-activity") | {path: value}
    with pytest.raises(CorrelationError):
        compile_correlation(doc)


def test_fingerprint_ignores_prose_and_order():
    doc = next(d for d in shipped("correlation") if d["id"] == "ssh-bruteforce-success")
    a = compile_correlation(doc)
    b = compile_correlation(dict(reversed(list(doc.items()))) | {"title": "other", "version": 9, "selectors": dict(reversed(list(doc["selectors"].items())))})
    assert a.fingerprint == b.fingerprint != compile_correlation(doc | {"window": "6m"}).fingerprint


T0 = datetime(2026, 1, 1, 12)


def _inputs(spark, rows):
    """rows: (kind, id, seconds, fields, observed seconds after)"""
    keys = sorted({k for r in rows for k in r[3]})
    data = [(r[0], r[1], T0 + timedelta(seconds=r[2]), T0 + timedelta(seconds=r[2] + (r[4] if len(r) > 4 else 1)), *[r[3].get(k) for k in keys]) for r in rows]
    kinds = ["array<string>" if k == "mitre_technique_ids" else "string" for k in keys]
    schema = "input_kind string, input_id string, occurred_at timestamp, observed_at timestamp" + "".join(f", {k} {t}" for k, t in zip(keys, kinds))
    return incidents.inputs_of(spark.createDataFrame(data, schema))


def _incidents(spark, rule, rows):
    inputs = _inputs(spark, rows)
    d = incidents.evaluate(rule, inputs).collect()
    return d, incidents.incident_table(rule, incidents.evaluate(rule, inputs), inputs).collect()


def _fail(i, s, **more):
    return ("detection", f"f{i}", s, {"rule_id": "linux-authentication-failure", "platform": "linux", "severity": "low", "host_name": "A.", "user_name": "Bob", "source_ip": "::ffff:1.2.3.4", "source_type": "linux_journald"} | more)


OK = {"platform": "linux", "source_type": "linux_journald", "event_category": "authentication", "event_action": "ssh_login", "service_name": "ssh", "outcome": "success", "host_name": "a", "user_name": "Bob", "source_ip": "1.2.3.4"}


def test_sequence_boundaries(spark):
    rule = _rule("ssh-bruteforce-success")
    for last, n in ((300, 1), (300.001, 0)):
        _, out = _incidents(spark, rule, [*[_fail(i, i * 10) for i in range(5)], ("event", "ok", last, OK)])
        assert len(out) == n
    _, out = _incidents(spark, rule, [*[_fail(i, i) for i in range(5)], ("event", "ok", 4, OK)])
    assert not out, "a tie does not order stages"
    _, out = _incidents(spark, rule, [*[_fail(i, i) for i in range(4)], ("event", "ok", 60, OK)])
    assert not out
    _, out = _incidents(spark, rule, [*[_fail(i, i) for i in range(5)], ("event", "ok", 60, OK | {"user_name": "bob"})])
    assert not out, "Linux names keep their case"
    _, out = _incidents(spark, rule, [*[_fail(i, i) for i in range(5)], ("event", "ok", 60, OK)])
    r = out[0]
    assert (r.severity, r.confidence, r.mitre_technique_ids, r.detection_count, r.event_count, r.incident_title) == ("high", 90, ["T1110"], 5, 1, "SSH failures and then a sign-in on a")


def _det(i, s, rule, host="h", **more):
    return ("detection", str(i), s, {"rule_id": rule, "severity": "high", "platform": "windows", "host_name": host, "source_type": "windows_sysmon", "mitre_technique_ids": ["T1059.001"]} | more)


def test_threshold_episodes_and_lateness(spark):
    rule = _rule("host-suspicious-activity")
    d, out = _incidents(spark, rule, [_det(1, 0, "a"), _det(2, 1, "a"), _det(3, 600, "b"), _det(4, 601, "c"), _det(5, 700, "d")])
    assert len(out) == 2 and {r.input_id: r.action for r in d} == {"1": "no_match", "2": "no_match", "3": "created", "4": "no_match", "5": "created"}
    d, out = _incidents(spark, rule, [_det(1, 0, "a"), (*_det(2, 1, "b")[:4], 600 + 900 - 1)])
    assert len(out) == 1, "observed at the deadline"
    d, out = _incidents(spark, rule, [_det(1, 0, "a"), (*_det(2, 1, "b")[:4], 600 + 900 - 1 + 0.001)])
    assert not out and {r.reason for r in d if r.input_id == "2"} <= {"late_outside_boundary", "condition_not_satisfied"}
    d, out = _incidents(spark, rule, [_det(1, 0, "a", severity="informational"), _det(2, 1, "b")])
    assert not out
    d, out = _incidents(spark, rule, [_det(1, 0, "a"), _det(2, 1, "b", host="H."), _det(2, 1, "b", host="H.")])
    assert len(out) == 1 and out[0].input_count == 2, "physical duplicates count once"
    d, out = _incidents(spark, rule, [_det(1, 0, "a"), _det(2, 1, "b"), _det(2, 1, "c")])
    assert not out, "conflicting copies are invalid"


def test_users_by_platform(spark):
    rule = _rule("user-suspicious-activity")
    _, out = _incidents(spark, rule, [_det(1, 0, "a", "x", user_name="DOM\\Alice"), _det(2, 5, "b", "y", user_name="dom\\ALICE")])
    assert len(out) == 1 and out[0].incident_title == "Several detections for dom\\alice"
    _, out = _incidents(spark, rule, [_det(1, 0, "a", "x", user_name="DOM\\Alice"), _det(2, 5, "b", "y", user_name="alice@dom")])
    assert not out


def test_join_with_ownership(spark):
    rule = _rule("network-endpoint-activity")
    net = ("detection", "n", 0, {"rule_id": "s", "severity": "medium", "platform": "network", "source_type": "suricata_eve", "source_ip": "192.168.186.129", "destination_ip": "192.168.186.2"})
    end = ("detection", "e", 300, {"rule_id": "p", "severity": "high", "platform": "windows", "source_type": "windows_sysmon", "host_name": "End.Example.", "mitre_technique_ids": ["T1059.001"]})
    own = ("event", "o", 600, {"event_code": "3", "initiated": "1", "platform": "windows", "source_type": "windows_sysmon", "host_name": "end.example", "source_ip": "::ffff:192.168.186.129"})
    _, out = _incidents(spark, rule, [net, end, own])
    assert len(out) == 1 and (out[0].severity, out[0].confidence, out[0].input_count) == ("high", 85, 3)
    assert not _incidents(spark, rule, [net, end])[1]
    assert not _incidents(spark, rule, [net, end, (*own[:2], 600.001, own[3])])[1]


def test_join_by_groups_gives_the_incidents_of_all_sets(spark):
    rule, rng = _rule("network-endpoint-activity"), random.Random(4)
    ip = lambda: f"10.0.0.{rng.randrange(3)}"
    rows = []
    for i in range(90):
        net = ("detection", f"n{i}", {"rule_id": "s", "severity": "medium", "platform": "network", "source_type": "suricata_eve", "source_ip": ip(), "destination_ip": rng.choice([ip(), "8.8.8.8", None])})
        end = ("detection", f"e{i}", {"rule_id": "p", "severity": "high", "platform": "windows", "source_type": "windows_sysmon", "host_name": rng.choice(["A.", "b", "c"])})
        own = ("event", f"o{i}", {"event_code": "3", "initiated": "1", "platform": "windows", "source_type": "windows_sysmon", "host_name": rng.choice(["a", "B", "d", None]), "source_ip": rng.choice(["::ffff:", ""]) + ip()})
        kind, id, fields = rng.choice([net, end, own])
        rows.append((kind, id, rng.randrange(0, 5000, 20), fields, rng.choice([1, 1, 700, 1400, 1501])))
    inputs = _inputs(spark, rows).cache()
    assert incidents.parts_of_roles(rule) == {"network_alert": ["shared_ip"], "endpoint_detection": ["host_name"], "endpoint_identity": ["shared_ip", "host_name"]}
    every, gains = (sorted(tuple(r) for r in incidents.incident_table(rule, incidents.evaluate(rule, inputs, gains=g, keep=lambda df: df.cache()).cache(), inputs).drop("revision", "late_update_count").collect()) for g in (False, True))
    assert every == gains and len(every) > 5


def test_order_of_arrival_does_not_matter(spark):
    rule = _rule("host-suspicious-activity")
    rows = [_det(i, s, r) for i, (s, r) in enumerate([(0, "a"), (30, "b"), (90, "a"), (700, "c"), (1500, "a"), (1501, "b")])]
    ids = set()
    for order in itertools.islice(itertools.permutations(rows), 0, 720, 240):
        ids.add(tuple(sorted(r.incident_id for r in _incidents(spark, rule, list(order))[1])))
    assert len(ids) == 1


def test_lifecycle():
    i = lifecycle.Incident(window_end_ms=100, late_accept_until_ms=200)
    a = lifecycle.transition(i, "t1", "acknowledged", 110)
    c = lifecycle.transition(a, "t2", "closed", 150)
    assert (c.status, c.revision, c.late_accept_until_ms, c.acknowledged_at_ms) == ("closed", 3, 250, 110)
    assert lifecycle.transition(c, "t2", "closed", 999) == c == lifecycle.transition(c, "t3", "closed", 1)
    assert lifecycle.accepts(c, 150, 250) and not lifecycle.accepts(c, 151, 200) and not lifecycle.accepts(c, 150, 251)
    for bad in (("t2", "new"), ("t9", "acknowledged"), (" ", "closed")):
        with pytest.raises(lifecycle.TransitionError):
            lifecycle.transition(c, bad[0], bad[1], 1)

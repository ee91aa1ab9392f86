import json

import pytest

from wardstone.plans.normalize import envelope, normalize, self_traffic
from wardstone.schema import EVENT, with_uid

NESTED = {"Event": {"System": {"Provider": {"Name": "Microsoft-Windows-Sysmon"}, "EventID": 1, "Channel": "c", "Computer": "WIN-1"}, "EventData": {"UtcTime": "2026-01-02 10:00:00.123", "ProcessId": "4242", "Image": "C:\\Windows\\powershell.exe", "ParentImage": "C:\\a\\explorer.exe", "User": "DOM\\bob", "Protocol": "TCP"}}}
FLAT = {"event_id": 3, "computer": "WIN-2", "timestamp": "2026-01-02T10:00:00Z", "event_data": {"Initiated": "true", "SourceIp": "10.0.0.1", "DestinationPort": "443", "Protocol": "TCP"}, "record_id": 1001}
ECS = {"@timestamp": "2026-01-02T10:00:00Z", "winlog": {"event_id": 22, "event_data": {"QueryName": "x.example"}}, "host": {"name": "WIN-3"}}
AUDIT = {"source_type": "linux_auditd", "host_name": "u", "message": 'type=SYSCALL msg=audit(1788422400.125:4201): success=yes ppid=2200 pid=2201 auid=1000 uid=0 comm="curl" exe="/usr/bin/curl"\ntype=EXECVE msg=audit(1788422400.125:4201): argc=2 a0="/usr/bin/curl" a1="https://e.example/a b"\ntype=EOE msg=audit(1788422400.125:4201):'}
SUDO = {"source_type": "linux_auditd", "host_name": "u", "message": 'type=USER_CMD msg=audit(1788422460.250:7): pid=1 uid=1000 auid=4294967295 acct="ann" exe="/usr/bin/sudo" cmd="/usr/bin/id" res=success'}
SSH_BAD = {"host_name": "u", "SYSLOG_IDENTIFIER": "sshd", "PRIORITY": "6", "message": "Failed password for invalid user eve from 192.0.2.30 port 55000 ssh2"}
SSH_OK = {"host_name": "u", "SYSLOG_IDENTIFIER": "sshd", "PRIORITY": "4", "message": "Accepted publickey for ann from 192.0.2.31 port 55001 ssh2"}
UNIT = {"host_name": "u", "SYSLOG_IDENTIFIER": "systemd", "message": "Started nginx.service - web"}
ALERT = {"product": "suricata", "device_name": "ids", "event": {"event_type": "alert", "timestamp": "2026-01-02T10:00:00.000000+0000", "src_ip": "1.2.3.4", "src_port": 5, "proto": "TCP", "flow_id": 9, "alert": {"signature": "LAB x", "signature_id": 9000001, "severity": 2, "action": "blocked"}}}
HTTP = {"product": "suricata", "event": {"event_type": "http", "http": {"hostname": "h.example", "url": "/p"}}}
DNS = {"source_type": "suricata_eve", "event": {"event_type": "dns", "dns": {"queries": [{"rrname": "q.example"}], "rcode": "NOERROR", "answers": [{"rrname": "q.example"}]}}}
GENERIC = {"vendor": "Acme", "product": "Box", "severity": "HIGH", "event": {"message": "m", "id": 4}}


@pytest.fixture(scope="module")
def out(spark):
    rows = [("/sysmon", json.dumps(x)) for x in (NESTED, FLAT, ECS)] + [("/linux", json.dumps(x)) for x in (AUDIT, SUDO, SSH_BAD, SSH_OK, UNIT)] + [("/security", json.dumps(x)) for x in (ALERT, HTTP, DNS, GENERIC)]
    rows += [("/syslog", "<34>Sep  3 12:05:00 edge-gw sshd[1234]: lab login"), ("/syslog", '<165>1 2026-09-03T12:06:00.000Z fw ids 4321 ID47 [x@1 t="true"] permitted'), ("/syslog", "no syslog at all")]
    rows += [("/other", "{}"), ("/security", '{"event": 3}'), ("/linux", "[1]"), ("/sysmon", "{bad"), (None, "{}"), ("/sysmon", None)]
    df = spark.createDataFrame(rows, "path string, body string").selectExpr("path", "body", "'peer' AS peer", "CAST(NULL AS string) AS validation_id", "TIMESTAMP '2026-09-30 00:00:00' AS received_at")
    events, rejects = normalize(df, 2026)
    return events, rejects, {r.raw_json: r for r in events.collect()}


def test_all_columns_in_order_without_nulls(out):
    events, _, rows = out
    assert events.columns == list(EVENT)
    assert all(v is not None for r in rows.values() for v in r)
    assert len(rows) == 15


def test_rejects(out):
    assert sorted(r.ingest_error for r in out[1].collect()) == ["no event object", "not a JSON object", "not a JSON object", "not a JSON object", "unknown path", "unknown path"]


def test_sysmon_dialects(out):
    a, b, c = (out[2][json.dumps(x)] for x in (NESTED, FLAT, ECS))
    assert (a.event_type, a.event_category, a.process_id, a.process_name, a.parent_process_name, a.protocol, str(a.event_time)) == ("process_create", "process", 4242, "powershell.exe", "explorer.exe", "tcp", "2026-01-02 10:00:00.123000")
    assert (b.event_type, b.initiated, b.destination_port, b.record_id, b.host_name, b.source_event_id) == ("network_connect", 1, 443, 1001, "WIN-2", "1001")
    assert (c.event_type, c.domain, c.host_name) == ("dns_query", "x.example", "WIN-3")


def test_audit(out):
    a, s = out[2][json.dumps(AUDIT)], out[2][json.dumps(SUDO)]
    assert (a.command_line, a.user_id, a.process_name, a.outcome, a.event_action, a.record_id, str(a.event_time)) == ("/usr/bin/curl https://e.example/a b", "1000", "curl", "success", "process_execute", 4201, "2026-09-03 08:00:00.125000")
    assert "EOE" not in a.command_line
    assert (s.event_action, s.user_name, s.command_line, s.user_id, s.service_name, s.outcome) == ("sudo_command", "ann", "/usr/bin/id", "1000", "sudo", "success")


def test_journal(out):
    bad, ok, unit = (out[2][json.dumps(x)] for x in (SSH_BAD, SSH_OK, UNIT))
    assert (bad.user_name, bad.source_ip, bad.source_port, bad.outcome, bad.severity, bad.event_action) == ("eve", "192.0.2.30", 55000, "failure", "error", "ssh_login")
    assert (ok.user_name, ok.outcome, ok.severity) == ("ann", "success", "warning")
    assert (unit.event_action, unit.service_name, unit.outcome, unit.event_category) == ("service_start", "nginx.service", "success", "service")


def test_security(out):
    a, h, d, g = (out[2][json.dumps(x)] for x in (ALERT, HTTP, DNS, GENERIC))
    assert (a.event_kind, a.severity, a.outcome, a.event_action, a.vendor, a.signature_id, a.protocol, a.source_event_id, str(a.event_time)) == ("alert", "medium", "blocked", "network_alert", "OISF", "9000001", "tcp", "9", "2026-01-02 10:00:00")
    assert (h.url, h.event_category) == ("http://h.example/p", "web")
    assert (d.domain, d.query_name, d.query_status, json.loads(d.query_results)) == ("q.example", "q.example", "NOERROR", [{"rrname": "q.example"}])
    assert (g.vendor, g.severity, g.event_action, g.message) == ("Acme", "high", "event", "m")


def test_syslog(out):
    rows = {r.original_format + r.host_name: r for r in out[2].values() if r.source_type == "generic_syslog"}
    old, new, raw = rows["rfc3164edge-gw"], rows["rfc5424fw"], rows["rfc3164unknown"]
    assert (old.severity, old.process_id, old.message, str(old.event_time), old.syslog_facility) == ("error", 1234, "lab login", "2026-09-03 12:05:00", "auth")
    assert (new.severity, new.event_code, new.message, new.syslog_facility) == ("info", "ID47", "permitted", "local4")
    assert raw.message == "no syslog at all"


def test_uid_filter_and_envelope(spark, out):
    events = with_uid(out[0])
    assert events.select("event_uid").distinct().count() == 15
    assert self_traffic(events, (443,), "curl").count() == 15
    good, bad = envelope(spark.createDataFrame([('{"a":1}',), ("x",), (None,)], "value string"), "ids")
    assert json.loads(good.first().body)["event"] == {"a": 1} and bad.count() == 2

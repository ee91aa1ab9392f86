import json
import socket
import threading
import time

import pytest
import yaml
from pyspark.sql import functions as F

from wardstone import cli
from wardstone.operators import incremental
from wardstone.plans.normalize import normalize
from wardstone.sources.files import recovered, requests
from wardstone.sources.rules import DocumentError, fixtures, shipped
from wardstone.sources.syslog import syslog_tcp, syslog_udp
from wardstone.streaming.internal import InternalLog, internal_logs
from wardstone.streaming.store import Store

LINE = "<34>1 2026-01-01T00:00:00.000Z host-1 app 7 ID7 - text 7"


def _wait(what, seconds=40):
    until = time.monotonic() + seconds
    while not what() and time.monotonic() < until:
        time.sleep(0.3)
    return what()


def test_syslog_over_udp(spark):
    free = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    free.bind(("127.0.0.1", 0))
    port = free.getsockname()[1]
    free.close()
    query = syslog_udp(spark, "127.0.0.1", port).writeStream.format("memory").queryName("udp_lines").start()
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    try:
        assert _wait(lambda: [out.sendto((LINE + "\n").encode(), ("127.0.0.1", port))] and spark.table("udp_lines").count() > 0)
        rows = normalize(spark.table("udp_lines"))[0]
        assert {(r.host_name, r.event_code) for r in rows.collect()} == {("host-1", "ID7")}
    finally:
        query.stop()
        out.close()


def test_syslog_over_tcp_and_internal_logs(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = server.accept()
        peer.sendall(f"{LINE}\n{'x' * 70_000}\n".encode())
        time.sleep(20)
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    log = InternalLog(tmp_path / "log" / "internal.jsonl")
    spark.streams.addListener(log)
    query = syslog_tcp(spark, "127.0.0.1", server.getsockname()[1]).writeStream.format("memory").queryName("tcp_lines").start()
    try:
        assert _wait(lambda: spark.table("tcp_lines").count() == 2)
        assert sorted(len(r.body) for r in spark.table("tcp_lines").collect()) == [len(LINE), 65_536]
        assert _wait(lambda: log.path.exists() and "progress" in log.path.read_text())
    finally:
        query.stop()
        spark.streams.removeListener(log)
        server.close()
    seen = internal_logs(spark, str(log.path)).groupBy("kind").agg(F.sum("rows").alias("rows")).collect()
    assert {r.kind: r.rows for r in seen}["progress"] == 2


def test_requests_recovery_and_fixtures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(x) for x in [{"path": "/linux", "peer": "1.2.3.4", "headers": {"X-Validation-Id": "v1"}, "body": "{}"}, {"path": "/sysmon", "body": "x"}]))
    got = sorted((r.path, r.peer, r.validation_id) for r in requests(spark, str(tmp_path / "in")).collect())
    assert got == [("/linux", "1.2.3.4", "v1"), ("/sysmon", "", None)]
    (tmp_path / "r.json").write_text('{"k": 1}\n{"k": \n{"k": 2}\n')
    rows, bad = recovered(spark, str(tmp_path / "r.json"), "k int")
    assert sorted(r.k for r in rows.collect()) == [1, 2] and [r.value for r in bad.collect()] == ['{"k": ']
    (tmp_path / "fx").mkdir()
    (tmp_path / "fx" / "1.json").write_text('{"event_uid": "a"}')
    store = Store(spark, str(tmp_path / "store"))
    assert fixtures(spark, tmp_path / "fx", {"event_uid"}, "event_uid string").first().event_uid == "a"
    store.seed("t", [{"k": 1}, {"k": 2, "v": "x"}], "k int, v string")
    more = spark.createDataFrame([(2, "y"), (3, "z"), (3, "z")], "k int, v string")
    for _ in range(2):
        store.backfill("t", more, ["k"])
    assert sorted((r.k, r.v) for r in store.read("t", "k int, v string").collect()) == [(1, None), (2, "x"), (3, "z")]
    (tmp_path / "fx" / "2.json").write_text('{"nope": 1}')
    with pytest.raises(DocumentError):
        fixtures(spark, tmp_path / "fx", {"event_uid"}, "event_uid string")
    assert incremental.ensure(more, F.col("k") > 1, "k").count() == 3
    with pytest.raises(Exception, match="too small"):
        incremental.ensure(more, F.col("k") > 2, "too small").collect()


def test_commands(spark, tmp_path, capsys):
    doc = next(d for d in shipped("detection") if d["id"] == "linux-sudo-shell")
    (tmp_path / "rule.yml").write_text(yaml.safe_dump(doc))
    rows = [("a", "linux", "linux_auditd", "sudo_command", "/bin/bash"), ("b", "linux", "linux_auditd", "sudo_command", "/usr/bin/id")]
    events = spark.createDataFrame(rows, "event_uid string, platform string, source_type string, event_action string, command_line string").withColumn("event_time", F.current_timestamp())
    events.write.parquet(str(tmp_path / "events"))
    assert cli.main(["test-rule", str(tmp_path / "rule.yml"), str(tmp_path / "events")], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["matches"] == 1 and out["sample"][0]["source_event_uid"] == "a" and out["plan"]["id"] == "linux-sudo-shell"
    assert cli.main(["status", str(tmp_path / "store"), str(tmp_path / "events")], spark) == 0 and json.loads(capsys.readouterr().out)["backlog"] == 2
    (tmp_path / "rule.yml").write_text(yaml.safe_dump(next(d for d in shipped("correlation") if d["id"] == "host-suspicious-activity")))
    assert cli.main(["transition", str(tmp_path / "store"), str(tmp_path / "rule.yml"), "nope", "t", "closed"], spark) == 1 and "unknown incident" in capsys.readouterr().out

import pytest
from pyspark.sql import functions as F

from wardstone.operators import incremental, sigma
from wardstone.sources.files import audit_events, event_log, journal, schema_differences
from wardstone.streaming.engine import DetectionEngine, drain
from wardstone.streaming.store import Store, write_events, write_rejects, write_tsv

RULE = {"title": "t", "id": "r1", "level": "low", "logsource": {"product": "linux"}, "detection": {"s": {"Action": "error"}, "condition": "s"}}


def _events(spark, a, b):
    return spark.range(a, b).select(F.concat(F.lit("e"), "id").alias("event_uid"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("event_time"), F.lit("linux_journald").alias("source_type"), F.lit("linux").alias("platform"), F.lit("h").alias("host_name"), F.lit("u").alias("user_name"), F.when(F.col("id") % 3 == 0, "error").otherwise("view").alias("event_action"))


@pytest.mark.parametrize("cut", [None, "detections", "ledger"])
def test_replay_writes_nothing_twice(spark, tmp_path, cut):
    store = Store(spark, str(tmp_path))
    engine = DetectionEngine(spark, store, sigma.compile_rules([RULE]))
    events = _events(spark, 0, 1001).union(_events(spark, 0, 1))
    if cut:
        with pytest.raises(RuntimeError):
            engine.run_batch(events, 0, cut)
    for n in range(2):
        engine.run_batch(events, n)
    assert spark.read.parquet(f"{tmp_path}/detections").count() == 334
    status = engine.status(events)
    assert (status["evaluated"], status["backlog"]) == (1001, 0)
    other = DetectionEngine(spark, store, sigma.compile_rules([RULE | {"id": "r2"}]))
    assert other.status(events)["backlog"] == 1002 and engine.status(_events(spark, 990, 1010))["backlog"] == 9


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "out"))
    _events(spark, 0, 60).write.parquet(str(tmp_path / "in"))
    engine = DetectionEngine(spark, store, sigma.compile_rules([RULE]))
    source = spark.readStream.schema(_events(spark, 0, 1).schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        engine.stream(source, str(tmp_path / "cp")).awaitTermination()
    _events(spark, 60, 90).write.mode("append").parquet(str(tmp_path / "in"))
    engine.stream(source, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/detections")).count() == 30


def test_drain():
    naps, left = [], [5, 5, 5, 2, 0]
    drain(lambda: left.pop(0), 5, sleep=naps.append, cycles=5)
    assert naps == [10.0, 10.0]
    naps.clear()
    drain(lambda: 1 / 0, 5, sleep=naps.append, cycles=4)
    assert naps == [1.0, 2.0, 4.0, 8.0]


def test_immutable_writes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    for _ in range(2):
        store.append_new("t", df, ["k"], ["v"])
    assert store.read("t", df.schema).count() == 2
    with pytest.raises(incremental.Conflict):
        store.append_new("t", spark.createDataFrame([(1, "x")], "k int, v string"), ["k"], ["v"])
    store.confirm("t", df, ["k"])
    with pytest.raises(incremental.Conflict):
        store.confirm("t", spark.createDataFrame([(9, "z")], "k int, v string"), ["k"])
    with pytest.raises(incremental.TooMany):
        incremental.at_most(df, 2)


def test_files(spark, tmp_path):
    lines = [("f", 0, "type=SYSCALL msg=audit(1.0:7): pid=1"), ("f", 10, "type=EXECVE msg=audit(1.0:7): a0=x"), ("f", 20, "type=EOE msg=audit(1.0:7):"), ("f", 30, "type=USER_CMD msg=audit(1.0:8): cmd=y"), ("f", 40, "noise"), ("g", 5, "type=SYSCALL msg=audit(1.0:7): pid=2")]
    out = audit_events(spark.createDataFrame(lines, "file string, offset long, line string")).orderBy("file", "offset").collect()
    assert [(r.file, r.offset, r.message.count("\n")) for r in out] == [("f", 0, 2), ("f", 30, 0), ("g", 5, 0)]
    rows = spark.createDataFrame([("ssh.service", "sshd"), ("x", "sudo"), (None, "y")], "_SYSTEMD_UNIT string, SYSLOG_IDENTIFIER string")
    assert journal(rows, units=("ssh.service",), identifiers=("sudo",), commands=("z",)).count() == 2
    assert event_log(spark.range(30).withColumnRenamed("id", "event_id")).count() == 6
    assert schema_differences(rows, {"_SYSTEMD_UNIT": "string", "n": "int"}) == ["n: missing instead of int"]
    e = _events(spark, 0, 3).withColumns({"event_type": F.lit("t"), "computer": F.lit("c"), "event_id": F.lit(1)})
    write_events(e, str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).where("yyyymm = 202601").count() == 3
    write_rejects(spark.createDataFrame([("x",)], "body string").withColumn("received_at", F.current_timestamp()), str(tmp_path / "rej"))
    write_tsv(spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "tsv"))
    assert spark.read.text(str(tmp_path / "tsv")).first().value == "1\ta"

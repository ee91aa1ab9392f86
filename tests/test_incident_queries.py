"""Queries of incidents against their SQL on small tables that meet a boundary."""

import datetime

import pytest

from wardstone.plans import report_queries  # noqa: F401  (registers its queries)
from wardstone.plans.catalogue import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
DAY = datetime.datetime(2024, 1, 1)


def same(spark, folder, rows, name):
    """How many rows the query and its SQL both have over events (event_id, micros after DAY, user_id, event_type, value)."""
    path = f"{folder}/events.parquet"
    data = [(i, DAY + datetime.timedelta(microseconds=us), u, t, float(v), "{}") for i, us, u, t, v in rows]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    found = QUERIES[name](spark, str(folder))
    rel = db.sql(SQL[name])
    want = sorted((tuple(r) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(r) for r in found.select(*rel.columns).collect()), key=repr)
    assert got == want
    return len(got)


S = 1_000_000_000  # a second of the queries' clock, in microseconds of the table's


def test_clock_takes_the_nearest_millisecond(spark, tmp_path):
    rows = [(0, 5 * S - 400, 1, "error", 60), (1, 9 * S, 1, "view", 60)]
    assert same(spark, tmp_path, rows, "incidents_user_suspicious_activity") == 1


def test_left_over_failures_begin_no_episode(spark, tmp_path):
    """Failures after the last sign-in of an episode, but within its window, are no part of the next one."""
    fails = [0, 10, 20, 30, 40, 250, 260, 310, 320, 330, 420, 430]
    signed = [50, 340, 440]
    rows = [(i, t * S, 1, "error", 60) for i, t in enumerate(fails)] + [(50 + i, t * S, 1, "purchase", 60) for i, t in enumerate(signed)]
    assert same(spark, tmp_path, rows, "incidents_ssh_bruteforce_success") == 2

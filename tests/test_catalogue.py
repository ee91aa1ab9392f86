"""Every query of the catalogue against its SQL on the smallest tables."""

import datetime
import decimal
import os

import pytest

from wardstone.functions.canon import canonical_host, canonical_ip, casefold, nfc
from wardstone.functions.text import duration_seconds
from wardstone.plans import flow_queries, report_queries  # noqa: F401  (these register their queries)
from wardstone.plans.catalogue import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def test_canonical_unicode(spark):
    df = spark.createDataFrame([("::FFFF:1.2.3.4", "é", "Straße", "A.B."), ("fe80::1%eth0", "é", "X", "a..b"), ("2001:DB8:0:0::1", None, None, "-bad"), (None, "", "", "  ")], "ip string, n string, c string, h string")
    rows = df.select(canonical_ip(df.ip).alias("ip"), nfc(df.n, True).alias("n"), casefold(df.c, True).alias("c"), canonical_host(df.h).alias("h")).collect()
    assert [tuple(r) for r in rows] == [("1.2.3.4", "é", "strasse", "a.b"), (None, "é", "x", None), ("2001:db8::1", None, None, None), (None, "", "", None)]


def test_durations():
    assert (duration_seconds("10s"), duration_seconds("5m"), duration_seconds("2h")) == (10, 300, 7200)
    for bad in ("", "m", "5", "5d", "-5m"):
        with pytest.raises(ValueError):
            duration_seconds(bad)

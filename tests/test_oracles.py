"""Every query of the engine against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from factloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 3)
    return value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_interval_join_rounds_seconds_as_its_sql(spark, tmp_path, zone):
    """Fractions of seconds on either side of a half, a half itself, times before 1970, and clock changes of the session's zone."""
    times = ["2024-03-10 01:59:59.6", "2024-03-10 01:59:59.3", "2024-03-10 02:30:00.5", "2024-03-10 03:59:59.5", "2024-03-10 03:59:59.4", "2024-03-10 04:00:00.2"]
    times += ["2024-11-03 00:30:00.5", "2024-11-03 01:30:01.5", "2024-11-03 02:30:00.4", "2024-11-03 02:30:00.6", "1969-12-31 23:59:58.5", "1969-12-31 23:59:59.5"]
    values = ", ".join(f"({n}::bigint, timestamp '{t}', 1::bigint, '{'signup' if n % 3 < 2 else 'click'}')" for n, t in enumerate(times))
    con = duckdb.connect()
    con.execute(f"create table events as select * from (values {values}, (99, null, 1, 'signup')) v(event_id, ts, user_id, event_type)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = sorted(con.execute(catalog.oracle_sql()["interval_join"]).fetchall())
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert sorted(map(tuple, catalog.queries()["interval_join"](spark, str(tmp_path)).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_every_query_has_sql():
    """All but those that take their choices one after another, which are tested against plain loops."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"fair_selection"}


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).columns == ["entity", "growth"]

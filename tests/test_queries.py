"""Every core query against its SQL in DuckDB, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from gradelake import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    got = df.collect()
    ran = duck.execute(core.SQL[name])
    columns = [c[0] for c in ran.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in ran.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in got), key=repr) == want


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and all(r.rate == "n/a" or r.rate.endswith("%") for r in rows)


def test_every_query_has_sql_or_is_known_not_to():
    assert set(core.QUERIES) == set(core.SQL)

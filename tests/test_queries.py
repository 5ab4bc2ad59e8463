"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline"))
def test_rows_are_those_of_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    assert name in entry.oracle_sql()
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted([plain(x) for x in r] for r in got.select(*columns).collect())
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted([plain(r[k]) for k in order] for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

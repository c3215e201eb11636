import importlib

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "documents pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def same(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(n for n in entry.OWN if n in entry.OWN_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(same(r[c]) for c in columns) for r in got.collect()), key=repr)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(same(v) for v in r) for r in rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert rows == want


@pytest.mark.parametrize("name", sorted(n for n in entry.OWN if n not in entry.OWN_SQL))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert importlib.reload(entry).entry(spark).limit(1).count() == 1

"""Every query with SQL gives what DuckDB gives for it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from logsieve.plans import registry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(rows, columns):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, TABLES)
    columns = sorted(df.columns)
    found = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert plain(df.collect(), columns) == plain(want, columns)


def test_every_query_has_sql():
    assert set(registry.ORACLES) == set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

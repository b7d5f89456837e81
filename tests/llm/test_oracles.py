"""The corpus queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from logsieve.llm import registry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for path in Path(TABLES).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return db


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, tables, name):
    found = registry.queries()[name](spark, TABLES)
    wanted = tables.execute(registry.oracle_sql()[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, wanted.fetchall()))

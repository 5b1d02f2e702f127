"""Every query with SQL gives the same rows as its SQL in DuckDB; the others give rows of a stable schema."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows
from scansio.plans import registry

CORE, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, sf, db, name):
    df = CORE[name](spark, sf)
    got, cur = rows(df.columns, df.collect()), db.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cur.fetchall())


def test_names():
    assert set(SQL) <= set(CORE) <= set(entry.queries())


def test_entry(spark, sf):
    assert entry.entry(spark).count() >= 0

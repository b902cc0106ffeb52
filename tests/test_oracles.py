"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    db = duckdb.connect()
    for f in sorted(Path(small).glob("*.parquet")):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small, name):
    df = QUERIES[name](spark, small)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        columns = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == rows_of(columns, cur.fetchall())

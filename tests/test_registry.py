"""Every registered query against its SQL in DuckDB, on the smallest data set."""

import math
import os

import duckdb
import pytest

from lexigraph import queries as core
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def same(rows):
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(tuple(repr(plain(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    picked = ", ".join(f'"{c}"' for c in columns)
    assert same(rows) == same(duck.sql(f"SELECT {picked} FROM ({sql})").fetchall())


def test_sql_only_for_queries():
    assert set(core.oracle_sql()) <= set(core.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())

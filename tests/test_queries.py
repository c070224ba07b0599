"""Every registered query of the core runs; those with SQL agree with it."""

import math
import os

import duckdb
import pytest

from marginalia.plans import registry


def _rows(rows):
    return sorted(repr([round(x, 6) if isinstance(x, float) and not math.isnan(x) else x for x in r]) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.sql(f"SELECT {', '.join(columns)} FROM ({sql}) AS q").fetchall()
        assert _rows(rows) == _rows(want)


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

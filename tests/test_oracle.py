"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

import brute
from lakeloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries whose second column is the same everywhere by their nature.
ONE_COLUMN: set[str] = set()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def tables(duck):
    out = {"duck": duck, "folder": SF}
    for t in TABLES:
        r = duck.execute(f"SELECT * FROM {t}")
        names = [d[0] for d in r.description]
        out[t] = [dict(zip(names, x, strict=True)) for x in r.fetchall()]
    return out


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [r.asDict() for r in df.collect()]
    assert len(set(columns)) == len(columns)
    if name in brute.CHECKS:
        brute.CHECKS[name](rows, tables, spark, name)
        return
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        expected = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
        assert sorted(names) == columns
    else:
        expected = brute.ROWS[name](tables)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    want = sorted((tuple(plain(r[c]) for c in columns) for r in expected), key=repr)
    assert got == want


def test_every_query_is_held_against_something():
    assert set(QUERIES) == set(ORACLE_SQL) | set(brute.ROWS) | set(brute.CHECKS)
    assert not set(ORACLE_SQL) & (set(brute.ROWS) | set(brute.CHECKS))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_is_no_constant(duck, name):
    """A result of several rows that has one value in every column but its key would prove nothing."""
    result = duck.execute(ORACLE_SQL[name])
    rows = result.fetchall()
    columns = [d[0] for d in result.description]
    assert rows
    assert len(rows) < 3 or name in ONE_COLUMN or sum(len({repr(r[i]) for r in rows}) > 1 for i in range(len(columns))) >= min(2, len(columns)), name


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns

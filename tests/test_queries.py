"""Every registered query runs; those with SQL give DuckDB's rows."""

import functools

import duckdb
import pytest

from urnwise.plans.oracle import SQL
from urnwise.plans.queries import QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SLOW = {"ml_probs", "ml_tickets", "profile_forecast"}  # tested with fewer trees in test_operators


@pytest.fixture(scope="module", autouse=True)
def one_log():
    """The mapped log is made once for all queries of this module."""
    from urnwise.sources import draws as S

    with pytest.MonkeyPatch.context() as m:
        for name in ("log", "ctx", "draw_items"):
            m.setattr(S, name, functools.cache(getattr(S, name)))
        yield


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rel = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    ours = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    theirs = sorted(map(repr, rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()))
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and any(any(v is not None for v in r) for r in rows), "no result at the smallest size"
    for c in df.columns:  # every column says something
        assert any(r[c] is not None for r in rows), c


def test_contract(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["game", "dezena", "freq", "gap"]

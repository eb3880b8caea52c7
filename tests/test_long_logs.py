"""Logs that reach beyond the year 9999, as the larger tables' do (draw n is on 2000-01-01 + 3 n days)."""

import duckdb
import pytest

from urnwise.plans.oracle import SQL
from urnwise.plans.queries import QUERIES

#: A shift of whole blocks of both games.
LATER = 30_000_000


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    at, con = tmp_path_factory.mktemp("late"), duckdb.connect()
    for t in ("customer", "nation", "orders", "lineitem"):
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(t)
        con.sql(f"copy (select *{f' replace ({key} + {LATER} as {key})' if key else ''} from '/root/testdata/sf0.001/{t}.parquet') to '{at}/{t}.parquet'")
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["draw_log", "json_draws", "next_row", "hyp_handwritten", "family_union", "walk_forward"])
def test_years_of_five_digits(spark, late, name):
    at, con = late
    df = QUERIES[name](spark, at)
    cols = sorted(df.columns)
    theirs = con.sql(SQL[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, theirs))


def test_a_round_of_mining_in_years_of_five_digits(spark, late):
    assert QUERIES["prospect_round"](spark, late[0]).count()

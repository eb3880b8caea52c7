"""Copies that tasks make from a log's bits are those of placed rows, and less moves between tasks."""

from pyspark.sql import functions as F

from urnwise.operators import surrogates as U


def test_counts_of_bits_are_those_of_placed_values(spark, ctx, monkeypatch):
    rows = U.coded(ctx).cache()
    for copies in (0, 2, 6):
        plain = sorted(map(tuple, U.copied_counts(rows, copies, 9).collect()))
        assert sorted(map(tuple, U.log_counts(ctx, copies, 9).collect())) == plain and len(plain) == 85 * (copies + 1)
    monkeypatch.setattr(U, "CHUNK", 100)
    assert sorted(map(tuple, U.log_counts(ctx, 2, 9).collect())) == sorted(map(tuple, U.copied_counts(rows, 2, 9).collect()))


def test_a_log_without_a_full_window_has_no_counts(ctx):
    assert U.log_counts(ctx.where("idx < 30"), 3, 1).count() == 0
    one = U.log_counts(ctx.where("idx < 31 and game = 'g6_60'"), 3, 1).collect()
    assert len(one) == 60 * 4 and {r["size"] for r in one} == {1}
    assert {r["game"] for r in U.log_counts(ctx.where("idx < 31 or game = 'g6_60'").where("idx < 30 or game = 'g6_60'"), 1, 1).collect()} == {"g6_60"}


def test_values_don_t_move_for_each_copy(ctx):
    """Eight bytes of a draw for each SHARE copies, where a byte did for each number and copy."""
    moved = U.log_counts(ctx, 100, 7)._jdf.queryExecution().executedPlan().toString()
    assert "codes" not in moved and "bits" in moved


def test_report_takes_the_series_from_the_same_pass(ctx):
    every = U.all_measures(ctx, 3, 7)
    got, own = (sorted(map(tuple, x.collect())) for x in (U.own_of(every), U.own_measures(ctx)))
    assert got == own and len(own) == 85 and every.where(F.col("copy") > 0).count() == 85 * 3

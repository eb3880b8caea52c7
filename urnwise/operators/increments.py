"""Tallies of hypotheses kept along a growing log.

Attempts, hits and predicted numbers add up over draws. So what is kept of a name are its
sums over all draws and over the recent window, and up to which draw they reach. New
draws are counted and added, draws that have left the recent window are counted once
more and taken off; nothing else of the log is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnwise.operators import hypotheses as H

SUMS = ("tentativas", "acertos", "previstos")
#: A kept tally: `top` is the last draw (idx) of its game that it counts.
STATE = "game string, nome string, top long, " + ", ".join(f"{c}{tail} long" for tail in ("", "_recente") for c in SUMS)


def _signed(rows: DataFrame, whole: int, recent: int) -> DataFrame:
    """Tallies as what they add to a kept one's sums, over all draws and the recent ones."""
    return rows.select("game", "nome", *((F.col(c) * sign).cast("long").alias(f"{c}{tail}") for tail, sign in (("", whole), ("_recente", recent)) for c in SUMS))


def advance(state: DataFrame | None, ctx: DataFrame, names: list[str], since: int) -> DataFrame:
    """The state (see STATE) after the draws of ctx, of all names in it and of further `names`, which are counted from the start.

    Recent are the last `since` draws of a game but the first of them, as in `hypotheses.tallies`.
    """
    tops = F.broadcast(ctx.groupBy("game").agg(F.max("idx").cast("long").alias("top")))  # one row for each game
    known = sorted(r["nome"] for r in state.select("nome").distinct().collect()) if state is not None else []  # names of all rounds
    parts, columns = [], [f"{c}{tail}" for tail in ("", "_recente") for c in SUMS]
    fresh = sorted(set(names) - set(known))
    if fresh or not known:
        parts.append(H.tallies_of(ctx, fresh, since).select("game", "nome", *columns))
    if known:
        old = F.broadcast(state.groupBy("game").agg(F.max("top").alias("_old")))
        low = lambda top: F.greatest(top + 1 - since, F.lit(0))
        rows = ctx.join(tops.withColumnRenamed("top", "_top"), "game").join(old, "game", "left").withColumn("_old", F.coalesce("_old", F.lit(-1)))
        new, gone = rows.where("idx > _old"), rows.where((F.col("idx") > low(F.col("_old"))) & (F.col("idx") <= F.least(low(F.col("_top")), F.col("_old"))))
        parts += [state.select("game", "nome", *columns), _signed(H.tallies_of(new, known), 1, 0), _signed(H.tallies_of(new.where(F.col("idx") > low(F.col("_top"))), known), 0, 1), _signed(H.tallies_of(gone, known), 0, -1)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("game", "nome").agg(*(F.sum(c).cast("long").alias(c) for c in columns))
    return sums.join(tops, "game").select("game", "nome", "top", *columns)

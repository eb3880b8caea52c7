"""Windows over a whole ordered log without moving it to one task.

A row's place in its game is counted in slices: rows of a slice of the order column are
numbered inside the slice, and the slices' sizes, added up, give the offset. On the
numbered log, windows of bounded reach run in chunks of CHUNK rows that also hold the
rows their neighbours need (a halo), and running totals add the totals of the chunks
before. So a game with a third of all draws is as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE, CHUNK = 4096, 4096


def placed(df: DataFrame, game: str, slice_: Column, order: list, name: str) -> DataFrame:
    """df with the 0-based place of each row among its game's, by `order`; slice_ ascends with that order, and only a slice is sorted in one task."""
    sliced = df.withColumn("_slice", slice_)
    sizes = sliced.groupBy(game, "_slice").agg(F.count("*").alias("_n"))
    before = sizes.select(game, "_slice", (F.sum("_n").over(Window.partitionBy(game).orderBy("_slice")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(game, "_slice").orderBy(*order)) - 1
    return sliced.withColumn("_own", own).join(before, [game, "_slice"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_slice", "_own", "_before")


def numbered(df: DataFrame, game: str = "game", order: str = "numero", name: str = "idx") -> DataFrame:
    """df with the 0-based place of each row among its game's, by `order` (unique whole numbers)."""
    return placed(df, game, F.expr(f"{order} div {SLICE}"), [order], name)


def haloed(df: DataFrame, back: int, ahead: int, chunk: int) -> DataFrame:
    """df with `_chunk`: each row in its own chunk of places and in those that need it within so many rows of their edges."""
    at = F.col("idx") % chunk
    home = F.expr(f"idx div {chunk}")
    chunks = F.array_compact(F.array(home, F.when(at >= chunk - back, home + 1), F.when((at < ahead) & (home > 0), home - 1)))
    return df.withColumn("_chunk", F.explode(chunks))


def windowed(df: DataFrame, game: str, back: int, ahead: int, make, by: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """df with the columns make(window) -> {name: Column}, whose frames reach at most so many rows back and ahead of idx.

    `by` names further columns inside which the log is ordered (a series for each value).
    """
    chunk = max(chunk, back, ahead)
    spread = haloed(df, back, ahead, chunk)
    window = Window.partitionBy(game, *by, "_chunk").orderBy("idx")
    out = spread.select("*", *(c.alias(n) for n, c in make(window).items()))
    return out.where(F.col("_chunk") == F.expr(f"idx div {chunk}")).drop("_chunk")


def lagged(df: DataFrame, game: str, columns: dict[str, tuple[str, int]], by: tuple[str, ...] = ()) -> DataFrame:
    """df with columns {name: (column, rows back)}."""
    return windowed(df, game, max(n for _, n in columns.values()), 0, lambda w: {name: F.lag(c, n).over(w) for name, (c, n) in columns.items()}, by)


def running(df: DataFrame, game: str, columns: dict[str, Column], how=F.sum, join=None, by: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """df with running totals (or maxima) of columns, the row itself included; how: F.sum or F.max."""
    join = join or ((lambda a, b: a + b) if how is F.sum else F.greatest)
    keyed = df.withColumn("_chunk", F.expr(f"idx div {chunk}")).select("*", *(c.alias(f"_{n}") for n, c in columns.items()))
    totals = keyed.groupBy(game, *by, "_chunk").agg(*(how(f"_{n}").alias(f"_t{n}") for n in columns))
    earlier = Window.partitionBy(game, *by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(game, *by, "_chunk", *(how(f"_t{n}").over(earlier).alias(f"_b{n}") for n in columns))
    own = Window.partitionBy(game, *by, "_chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.select("*", *(how(f"_{n}").over(own).alias(n) for n in columns)).join(before, [game, *by, "_chunk"])
    for n in columns:
        out = out.withColumn(n, F.when(F.col(f"_b{n}").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"_b{n}")).otherwise(join(F.col(f"_b{n}"), F.col(n))))
    return out.select(*df.columns, *columns)


def last_draws(df: DataFrame, game: str, n: int) -> DataFrame:
    """The last n draws of each game by idx."""
    top = df.groupBy(game).agg((F.max("idx") - n).alias("_from"))
    return df.join(F.broadcast(top), game).where("idx > _from").drop("_from")  # one row for each game

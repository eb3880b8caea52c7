"""Derived features of draws and per-number series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from urnwise.functions.scalar import bit_of, moon_age, moon_phase, state_of
from urnwise.games import GAMES, PRIMES
from urnwise.operators.blocks import Block, by_chunk, lists
from urnwise.operators.sequence import lagged, windowed


def size_of(game: str = "game"):
    """Column: the domain's size of the row's game."""
    return F.coalesce(*(F.when(F.col(game) == g.key, F.lit(g.m)) for g in GAMES.values()))


def shape(ctx: DataFrame) -> DataFrame:
    """Per draw: sum, evens, odds, amplitude, primes, neighbours, terciles, moments and repeats."""
    d = F.col("dezenas")
    count = lambda f: F.size(F.filter(d, f))
    n = F.size(d)
    total = F.aggregate(d, F.lit(0), lambda a, x: a + x)
    squares = F.aggregate(d, F.lit(0), lambda a, x: a + x * x)
    third = F.floor(size_of() / 3)
    steps = F.when(n > 1, F.zip_with(F.slice(d, 1, n - 1), F.slice(d, 2, n - 1), lambda a, b: (b - a == 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return ctx.select(
        "game", "numero", "idx",
        total.alias("soma"), count(lambda x: x % 2 == 0).alias("pares"), count(lambda x: x % 2 == 1).alias("impares"),
        (F.array_max(d) - F.array_min(d)).alias("amplitude"), count(lambda x: x.isin(*PRIMES)).alias("primos"),
        F.aggregate(steps, F.lit(0), lambda a, x: a + x).alias("consecutivos"),
        count(lambda x: x <= third).alias("baixo"), count(lambda x: (x > third) & (x <= third * 2)).alias("medio"), count(lambda x: x > third * 2).alias("alto"),
        F.array_min(d).alias("menor"), F.array_max(d).alias("maior"), (total / n).alias("media"),
        F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n))).alias("desvio"),
        F.coalesce(F.size(F.array_intersect(d, F.col("prev"))), F.lit(0)).alias("repetidos"),
    )


def last_digits(items: DataFrame) -> DataFrame:
    """Per draw: numbers by last digit, final_0 to final_9."""
    return items.groupBy("game", "numero").agg(*(F.count_if(F.col("dezena") % 10 == u).alias(f"final_{u}") for u in range(10)))


def calendar(ctx: DataFrame) -> DataFrame:
    """Per draw: calendar parts, moon, days since the draw before, state and its code among the sorted states."""
    rows = lagged(ctx.select("game", "numero", "idx", "data", "local"), "game", {"before": ("data", 1)})
    rows = rows.withColumn("uf", state_of(F.col("local")))
    codes = rows.select("game", "uf").distinct().withColumn("uf_code", F.dense_rank().over(Window.partitionBy("game").orderBy("uf")) - 1)
    data = F.col("data")
    return rows.join(codes, ["game", "uf"]).select(
        "game", "numero", F.weekday(data).alias("dia_semana"), F.day(data).alias("dia"), F.month(data).alias("mes"), F.year(data).alias("ano"), F.weekofyear(data).alias("semana"),
        F.coalesce(F.date_diff(data, F.col("before")), F.lit(0)).alias("dias_desde"), moon_phase(data).alias("fase"), F.floor(moon_age(data)).cast("int").alias("lua"), "uf", "uf_code",
    )


def domain() -> Column:
    """Column: the numbers of the row's game."""
    return F.sequence(F.lit(1), size_of())


def hits(log: DataFrame) -> DataFrame:
    """The long one-hot frame (game, idx, numero, n, hit): a row for each draw and number of the domain."""
    return log.select("game", "idx", "numero", "mask", F.explode(domain()).alias("n")).select("game", "idx", "numero", "n", bit_of(F.col("mask"), F.col("n")).alias("hit"))


# Series of numbers are made by `blocks`: a chunk of draws at once, rows are multiplied last.

LAGS, MEANS = (1, 2, 3, 5, 10), (5, 10, 20, 50)
_KINDS = {"hit": T.IntegerType(), **{f"lag{k}": T.IntegerType() for k in LAGS}, **{f"freq{k}": T.DoubleType() for k in MEANS}, "gap": T.LongType(), "trend": T.DoubleType()}


def _series(block: Block, seen: np.ndarray) -> dict[str, np.ndarray]:
    """Features of a chunk's draws, each a matrix with a column for each number."""
    idx = block.idx[:, None]
    means = {f"freq{k}": block.count(-k, 0) / np.clip(idx, 1, k) for k in MEANS}
    return {"hit": block.hits(), **{f"lag{k}": block.hits(k) for k in LAGS}, **means, "gap": idx - np.maximum(block.last(seen), 0), "trend": means["freq5"] - means["freq50"]}


def number_series(log: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Per draw and number: lags 1, 2, 3, 5, 10; mean of the 5, 10, 20, 50 draws before; trend; running gap (this draw included); more: further columns of the log."""
    own, kept = ["game", "idx", "numero"], list(more)
    kind = lambda c: T.StructField("idx", T.LongType()) if c == "idx" else log.schema[c]
    schema = T.StructType([*map(kind, own), T.StructField("n", T.IntegerType()), *map(kind, kept), *(T.StructField(k, t) for k, t in _KINDS.items())])
    return by_chunk(log, [*own, *kept], max(MEANS), 0, lambda block, seen: block.long([*own, *kept], _series(block, seen), schema), schema, seen=True)


def series_arrays(log: DataFrame, features: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """number_series(log, more) with a row for each draw: `series` has the features of number 1, of number 2 and so on, as doubles."""
    kept = ["game", "idx", "numero", *more]
    schema = T.StructType([*(T.StructField("idx", T.LongType()) if c == "idx" else log.schema[c] for c in kept), T.StructField("series", T.ArrayType(T.DoubleType()))])

    def read(block: Block, seen: np.ndarray) -> pa.Table:
        made = _series(block, seen)
        series = np.stack([made[f] for f in features], axis=2).astype(np.float64).reshape(len(block.idx), -1)
        return block.rows.select(kept).append_column("series", lists(series))

    return by_chunk(log, kept, max(MEANS), 0, read, schema, seen=True)


def counts_before(log: DataFrame, width: int) -> DataFrame:
    """Per draw and number: how many of the `width` draws before (fewer at the start) hold it, as f."""
    own = ["game", "idx", "numero"]
    schema = T.StructType([T.StructField("idx", T.LongType()) if c == "idx" else log.schema[c] for c in own] + [T.StructField(c, T.IntegerType()) for c in ("n", "f")])
    return by_chunk(log, own, width, 0, lambda block: block.long(own, {"f": block.count(-width, 0)}, schema), schema)


def rolling_share(log: DataFrame, width: int = 30) -> DataFrame:
    """Per draw and number, from draw `width` on: the share of the `width` draws before that hold it."""
    return counts_before(log, width).where(F.col("idx") >= width).select("game", "idx", "numero", "n", (F.col("f") / width).alias("share"))


PROFILE = ("soma", "amplitude", "pares", "impares", "primos", "consecutivos", "baixo", "medio", "alto", "media", "desvio", "repetidos")


def profile_lags(shapes: DataFrame) -> DataFrame:
    """Per draw after the third: lags 1, 2, 3 and the means of the 5 and 10 draws before of every profile property."""

    def make(w):
        out = {f"{p}_lag{n}": F.lag(p, n).over(w) for p in PROFILE for n in (1, 2, 3)}
        return out | {f"{p}_ma{n}": F.avg(p).over(w.rowsBetween(-n, -1)) for p in PROFILE for n in (5, 10)}

    return windowed(shapes, "game", 10, 0, make).where("idx >= 3")

"""Dimensions of the two games, as plain data and as small DataFrames.

All numbers below are fixed values: sizes, structural profiles (expectation, spread,
allowed range), bands, prize tiers and ticket prices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Game:
    key: str
    k: int
    m: int
    block: int  # orders that make one draw when a draw log is mapped from orders
    bands: tuple[tuple[int, int], ...]
    profile: dict[str, tuple[float, float, float, float]]  # name: (expectation, sigma, low, high)
    prizes: dict[int, float]
    ticket: float
    check_from: int  # hits from which a bet is told to have won


GAMES = {
    "g6_60": Game(
        "g6_60", 6, 60, 3,
        ((1, 10), (11, 20), (21, 30), (31, 40), (41, 50), (51, 60)),
        {"sum": (183, 40.25, 143, 223), "odd": (3.0, 1.22, 2, 4), "repeats": (0.6, 0.73, 0, 2), "max_run": (1.3, 0.6, 1, 2), "band": (1.0, 0.85, 0, 2)},
        {4: 1200.0, 5: 50000.0, 6: 50000000.0}, 5.0, 4,
    ),
    "g15_25": Game(
        "g15_25", 15, 25, 10,
        ((1, 5), (6, 10), (11, 15), (16, 20), (21, 25)),
        {"sum": (195, 18.03, 177, 213), "odd": (7.8, 1.25, 7, 9), "repeats": (9, 1.22, 8, 10), "max_run": (5.0, 1.49, 3, 7), "band": (3, 1.0, 2, 4)},
        {11: 6.0, 12: 12.0, 13: 30.0, 14: 1500.0, 15: 1500000.0}, 3.0, 11,
    ),
}
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59)


def games(spark: SparkSession) -> DataFrame:
    """Rows (game, k, m)."""
    return spark.createDataFrame([(g.key, g.k, g.m) for g in GAMES.values()], "game string, k int, m int")


def bands(spark: SparkSession) -> DataFrame:
    """Rows (game, band, low, high)."""
    return spark.createDataFrame([(g.key, i, a, b) for g in GAMES.values() for i, (a, b) in enumerate(g.bands)], "game string, band int, low int, high int")


def profiles(spark: SparkSession) -> DataFrame:
    """Rows (game, name, expected, sigma, low, high)."""
    return spark.createDataFrame([(g.key, n, *map(float, v)) for g in GAMES.values() for n, v in g.profile.items()], "game string, name string, expected double, sigma double, low double, high double")


def prizes(spark: SparkSession) -> DataFrame:
    """Rows (game, hits, prize)."""
    return spark.createDataFrame([(g.key, h, p) for g in GAMES.values() for h, p in g.prizes.items()], "game string, hits int, prize double")

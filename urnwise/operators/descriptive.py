"""Frequencies, recency, pairs, sums and conditional frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urnwise.games import games


def numbers(spark: SparkSession) -> DataFrame:
    """Rows (game, dezena): the domain of each game."""
    return games(spark).select("game", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("dezena"))


def frequency(items: DataFrame) -> DataFrame:
    """Rows (game, dezena, freq) over the whole domain, 0 where never drawn."""
    counts = items.groupBy("game", "dezena").agg(F.count("*").alias("freq"))
    return numbers(items.sparkSession).join(counts, ["game", "dezena"], "left").select("game", "dezena", F.coalesce("freq", F.lit(0)).alias("freq"))


def recency(items: DataFrame) -> DataFrame:
    """Rows (game, dezena, freq, gap): the largest draw number less the last with this number; never drawn: the largest."""
    own = items.groupBy("game", "dezena").agg(F.count("*").alias("freq"), F.max("numero").alias("last"))
    top = own.groupBy("game").agg(F.max("last").alias("top"))
    return numbers(items.sparkSession).join(own, ["game", "dezena"], "left").join(top, "game").select("game", "dezena", F.coalesce("freq", F.lit(0)).alias("freq"), (F.col("top") - F.coalesce("last", F.lit(0))).alias("gap"))


def pairs(items: DataFrame) -> DataFrame:
    """Rows (game, a, b, obs): draws that hold both numbers; pairs come from each draw's array, so only counts are shuffled."""
    arrays = items.groupBy("game", "numero").agg(F.array_sort(F.collect_list("dezena")).alias("d"))
    both = F.flatten(F.transform("d", lambda a: F.transform(F.filter("d", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return arrays.select("game", F.explode(both).alias("p")).groupBy("game", "p.a", "p.b").agg(F.count("*").alias("obs"))


def top_pairs(items: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent pairs of each game; ties by smaller numbers."""
    order = Window.partitionBy("game").orderBy(F.desc("obs"), "a", "b")
    return pairs(items).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def sum_stats(items: DataFrame) -> DataFrame:
    """Mean, median, sample deviation and the truncated band of the draws' sums."""
    sums = items.groupBy("game", "numero").agg(F.sum("dezena").alias("s"))
    per = sums.groupBy("game").agg(F.avg("s").alias("mean"), F.median("s").alias("median"), F.stddev_samp("s").alias("std"))
    return per.select("*", (F.col("mean") - F.col("std")).cast("int").alias("low"), (F.col("mean") + F.col("std")).cast("int").alias("high"))


def pair_tests(items: DataFrame, least: float = 5.0) -> DataFrame:
    """Every observed pair with at least `least` expected draws: expected, lift and chi-square of one degree of freedom."""
    freq = items.groupBy("game", "dezena").agg(F.count("*").alias("f"))
    total = items.groupBy("game").agg(F.count_distinct("numero").alias("t"))
    rows = pairs(items).join(freq.select("game", F.col("dezena").alias("a"), F.col("f").alias("fa")), ["game", "a"]).join(freq.select("game", F.col("dezena").alias("b"), F.col("f").alias("fb")), ["game", "b"]).join(total, "game")
    rows = rows.withColumn("expected", F.col("fa") * F.col("fb") / F.col("t")).where(F.col("expected") >= least)
    d = F.col("obs") - F.col("expected")
    chi2 = d * d / F.col("expected") + F.when(F.col("t") > F.col("expected"), d * d / (F.col("t") - F.col("expected"))).otherwise(0.0)
    return rows.select("game", "a", "b", "obs", "expected", (F.col("obs") / F.col("expected")).alias("lift"), chi2.alias("chi2"))


#: chi-square of one degree of freedom above which p < 0.05
CHI2_05 = 3.841458820694124


def attracting(items: DataFrame, min_lift: float = 1.05, top: int = 30) -> DataFrame:
    """Significant pairs with lift at or above min_lift, the largest lift first."""
    order = Window.partitionBy("game").orderBy(F.desc("lift"), "a", "b")
    return pair_tests(items).where((F.col("lift") >= min_lift) & (F.col("chi2") > CHI2_05)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def repelling(items: DataFrame, min_lift: float = 1.05, top: int = 30) -> DataFrame:
    """Significant observed pairs with lift at or below 1 / min_lift, the smallest lift first."""
    order = Window.partitionBy("game").orderBy("lift", "a", "b")
    return pair_tests(items).where((F.col("lift") <= 1 / min_lift) & (F.col("chi2") > CHI2_05)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def cooccurrence_bonus(items: DataFrame, base: dict[str, list[int]]) -> DataFrame:
    """Rows (game, dezena, bonus) of numbers outside the base: lifts over 1.1 add half their surplus, under 0.9 take 0.3 of their lack; small sums go."""
    tests = pair_tests(items, 0.0)
    both = tests.select("game", F.col("a").alias("x"), F.col("b").alias("dezena"), "lift").union(tests.select("game", "b", "a", "lift"))
    of = F.coalesce(*(F.when(F.col("game") == g, F.array(*map(F.lit, b))) for g, b in base.items()), F.array().cast("array<int>"))
    part = F.when(F.col("lift") > 1.1, (F.col("lift") - 1) * 0.5).when(F.col("lift") < 0.9, -(1 - F.col("lift")) * 0.3).otherwise(0.0)
    own = both.withColumn("base", of).where(F.array_contains("base", F.col("x")) & ~F.array_contains("base", F.col("dezena")))
    return own.groupBy("game", "dezena").agg(F.sum(part).alias("bonus")).where("abs(bonus) > 0.01")


def conditional(items: DataFrame, attributes: DataFrame, dim: Column, least: int = 10, top: int | None = None) -> DataFrame:
    """Rows (game, dim, dezena, rate, draws): hit rate of each number among the draws of each dim value that has `least` draws."""
    of = attributes.select("game", "numero", dim.alias("dim")).join(items.select("game", "numero").distinct(), ["game", "numero"]).where("dim is not null")
    groups = of.groupBy("game", "dim").agg(F.count("*").alias("draws")).where(F.col("draws") >= least)
    if top:
        groups = groups.withColumn("r", F.row_number().over(Window.partitionBy("game").orderBy(F.desc("draws"), "dim"))).where(F.col("r") <= top).drop("r")
    hits = of.join(items, ["game", "numero"]).groupBy("game", "dim", "dezena").agg(F.count("*").alias("hits"))
    grid = groups.join(numbers(items.sparkSession), "game")
    return grid.join(hits, ["game", "dim", "dezena"], "left").select("game", "dim", "dezena", (F.coalesce("hits", F.lit(0)) / F.col("draws")).alias("rate"), "draws")


def deviations(items: DataFrame, conditionals: dict[str, DataFrame], least: float = 0.08, top: int = 30) -> DataFrame:
    """The conditional rates farthest from the number's overall rate, for each game."""
    total = items.groupBy("game").agg(F.count_distinct("numero").alias("t"))
    overall = frequency(items).join(total, "game").select("game", "dezena", (F.col("freq") / F.col("t")).alias("overall"))
    rows = None
    for kind, c in conditionals.items():
        own = c.select("game", F.lit(kind).alias("kind"), F.col("dim").cast("string").alias("dim"), "dezena", "rate")
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.join(overall, ["game", "dezena"]).withColumn("diff", F.col("rate") - F.col("overall")).where(F.abs("diff") > least)
    order = Window.partitionBy("game").orderBy(F.desc(F.round(F.abs("diff"), 9)), "kind", "dim", "dezena")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def bias(items_last: DataFrame, least: float = 0.3) -> DataFrame:
    """Numbers whose frequency in the given draws is more than `least` off the expected share."""
    n = items_last.groupBy("game").agg(F.count_distinct("numero").alias("t"))
    k = games(items_last.sparkSession)
    rows = frequency(items_last).join(n, "game").join(k, "game").withColumn("expected", F.col("t") * F.col("k") / F.col("m"))
    return rows.withColumn("bias", (F.col("freq") - F.col("expected")) / F.col("expected")).where(F.abs("bias") > least).select("game", "dezena", "freq", "bias")


def hot_pool(items_last: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The most frequent numbers in the given draws, ties by smaller number."""
    size = F.coalesce(*(F.when(F.col("game") == g, F.lit(s)) for g, s in sizes.items()))
    order = Window.partitionBy("game").orderBy(F.desc("freq"), "dezena")
    return frequency(items_last).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)

"""Fusion of evidence into scores of numbers, and scored tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urnwise.games import GAMES
from urnwise.operators.descriptive import numbers, recency, top_pairs
from urnwise.operators.sequence import last_draws
from urnwise.operators.tickets import per_game


def total_draws(items: DataFrame) -> DataFrame:
    return items.groupBy("game").agg(F.count_distinct("numero").alias("t"))


def basic_weights(items: DataFrame, top: int = 30) -> DataFrame:
    """Weight of each number: frequency, recency and membership in the top pairs, normalised to 1 in each game."""
    paired = top_pairs(items, top).select("game", F.explode(F.array("a", "b")).alias("dezena")).distinct().withColumn("paired", F.lit(1.0))
    rows = recency(items).join(total_draws(items), "game").join(paired, ["game", "dezena"], "left")
    raw = rows.withColumn("raw", F.col("freq") / F.col("t") * 0.5 + F.least(F.col("gap") / 20, F.lit(1.0)) * 0.35 + F.coalesce("paired", F.lit(0.0)) * 0.1 + 0.05)
    return raw.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy("game"))).select("game", "dezena", "weight")


def frequency_gap(items: DataFrame) -> DataFrame:
    """Per number: 0.3 of its frequency share and 0.2 of its gap in units of 15 draws, at most a half."""
    rows = recency(items).join(total_draws(items), "game")
    return rows.select("game", "dezena", (F.col("freq") / F.col("t") * 0.3 + F.least(F.col("gap") / 15, F.lit(0.5)) * 0.2).alias("score"))


def meta_weights(predictions: DataFrame, n: int = 10) -> DataFrame:
    """Per pattern: share of its attempts in the last n draws that hit; 0.5 without attempt."""
    rows = last_draws(predictions, "game", n)
    some = F.size("pred") > 0
    tally = rows.groupBy("game", "nome").agg(F.count_if(some).alias("tentativas"), F.count_if(some & F.arrays_overlap("pred", "dezenas")).alias("acertos"))
    return tally.select("game", "nome", F.when(F.col("tentativas") == 0, 0.5).otherwise(F.col("acertos") / F.col("tentativas")).alias("meta"))


def pattern_scores(predictions: DataFrame, bank: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Rows (game, dezena, nome, bonus): what each active pattern's prediction of the next draw adds to each number."""
    rows = predictions.select("game", "nome", F.explode("pred").alias("dezena")).join(bank.where("ativo"), ["game", "nome"])
    base = F.when(F.coalesce("score_confianca", F.lit(0.0)) != 0, F.col("score_confianca")).otherwise((1 - F.col("p_valor")) * F.abs(F.col("lift") - 1))
    if meta is not None:
        rows = rows.join(meta, ["game", "nome"], "left")
        base = base * (0.5 + F.coalesce("meta", F.lit(0.5)))
    return rows.select("game", "dezena", "nome", (base * F.when(F.col("lift") > 1, 1.0).otherwise(-0.5)).alias("bonus"))


def explained(scores: DataFrame) -> DataFrame:
    """Per number: the sum of its bonuses and the list of (pattern, bonus), the largest first."""
    parts = F.sort_array(F.collect_list(F.struct(F.round("bonus", 3).alias("bonus"), "nome")), asc=False)
    return scores.groupBy("game", "dezena").agg(F.sum("bonus").alias("score"), parts.alias("parts"))


def cross_bonus(ctx: DataFrame, n: int = 3) -> DataFrame:
    """Per number of either game: 0.02 for each of the last n draws of the 15/25 game that holds it, 0.01 for each of the 6/60 game that holds its complement."""
    recent = last_draws(ctx.select("game", "idx", "dezenas"), "game", n).select("game", F.explode("dezenas").alias("d"))
    direct = recent.where("game = 'g15_25'").select(F.col("d").alias("dezena"), F.lit(0.02).alias("bonus"))
    mirrored = recent.where("game = 'g6_60'").select((F.lit(GAMES["g6_60"].m + 1) - F.col("d")).alias("dezena"), F.lit(0.01).alias("bonus"))
    total = direct.union(mirrored).groupBy("dezena").agg(F.sum("bonus").alias("bonus"))
    return numbers(ctx.sparkSession).join(total, "dezena").select("game", "dezena", "bonus")


def fuse(*scores: DataFrame) -> DataFrame:
    """Per number the sum of the given (game, dezena, score) parts, and its rank (ties by smaller number)."""
    rows = None
    for s in scores:
        s = s.select("game", "dezena", F.col(s.columns[-1]).cast("double").alias("score"))
        rows = s if rows is None else rows.unionByName(s)
    total = rows.groupBy("game", "dezena").agg(F.sum("score").alias("score"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("game").orderBy(F.desc(F.round("score", 9)), "dezena")))


def recent_profile(shapes: DataFrame, n: int = 50) -> DataFrame:
    """Per game: mean and population deviation of sum and amplitude, mean evens, of the last n draws."""
    rows = last_draws(shapes, "game", n)
    return rows.groupBy("game").agg(F.avg("soma").alias("soma_media"), F.stddev_pop("soma").alias("soma_std"), F.avg("pares").alias("pares_media"), F.avg("amplitude").alias("amplitude_media"), F.stddev_pop("amplitude").alias("amplitude_std"))


def profile_fit(tickets: DataFrame, profile: DataFrame) -> DataFrame:
    """Tickets with `fit`, 0 to 1: how near sum, evens and amplitude are to the recent profile."""
    n = F.col("nums")
    soma = F.aggregate(n, F.lit(0), lambda a, x: a + x)
    pares, amp = F.size(F.filter(n, lambda x: x % 2 == 0)), F.array_max(n) - F.array_min(n)
    z = lambda v, mean, std: F.abs(v - F.col(mean)) / F.greatest(F.col(std), F.lit(1.0))
    score = F.lit(1.0) - F.least(z(soma, "soma_media", "soma_std") * 0.15, F.lit(0.4)) - F.abs(pares - F.col("pares_media")) * 0.05 - F.least(z(amp, "amplitude_media", "amplitude_std") * 0.1, F.lit(0.3))
    return tickets.join(profile, "game").withColumn("fit", F.greatest(score, F.lit(0.0))).select(*tickets.columns, "fit")


def ticket_scores(tickets: DataFrame, items: DataFrame) -> DataFrame:
    """Basic score of a ticket: nearness to the usual sum, frequency, top pairs, recency; 0 to 1."""
    sums = items.groupBy("game", "numero").agg(F.sum("dezena").alias("s")).groupBy("game").agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("std"))
    per = recency(items).join(total_draws(items), "game").withColumn("f", F.col("freq") / F.col("t")).withColumn("g", F.col("gap") / 20)
    paired = top_pairs(items, 30).select("game", F.explode(F.array("a", "b")).alias("dezena")).distinct().withColumn("p", F.lit(1.0))
    per = per.join(paired, ["game", "dezena"], "left").select("game", "dezena", "f", "g", F.coalesce("p", F.lit(0.0)).alias("p"))
    each = tickets.select("game", "ticket", F.explode("nums").alias("dezena")).join(per, ["game", "dezena"]).groupBy("game", "ticket").agg(F.avg("f").alias("f"), F.avg("g").alias("g"), F.avg("p").alias("p"), F.sum("dezena").alias("s"))
    near = 1 - F.abs(F.col("s") - F.col("mean")) / F.col("std")
    score = near * 0.3 + F.col("f") * 0.3 + F.col("p") * 0.2 + F.col("g") * 0.2
    return each.join(sums, "game").select("game", "ticket", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def integrated(frequencies: DataFrame, shares: DataFrame, biases: DataFrame) -> DataFrame:
    """Per number: half of branch A's score, 0.3 of branch B's share and 0.2 of a positive recent bias."""
    rows = frequencies.select("game", "dezena", F.col("score").alias("a")).join(shares.select("game", "dezena", F.col("share").alias("b")), ["game", "dezena"], "left").join(biases.select("game", "dezena", F.col("bias").alias("c")), ["game", "dezena"], "left")
    return rows.select("game", "dezena", (F.col("a") * 0.5 + F.coalesce("b", F.lit(0.0)) * 0.3 + F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(0.0)) * 0.2).alias("score"))


def picks(scores: DataFrame, k: Column | None = None) -> DataFrame:
    """The k best numbers of each game as one ticket."""
    k = k if k is not None else per_game(lambda g: F.lit(g.k))
    return scores.where(F.col("rank") <= k).groupBy("game").agg(F.array_sort(F.collect_list("dezena")).alias("nums"))


def optimised(scores: DataFrame, items: DataFrame, profile: DataFrame, count: int = 10, tries: int = 20, seed: int = 42) -> DataFrame:
    """`count` tickets for each game from scores (game, dezena, score, rank).

    A ticket starts from a uniform choice of k // 2 + 1 of the best numbers; the rest is
    drawn in proportion to score^1.5, moved by the lifts of pairs with that start;
    tickets that fit the recent profile below 0.4 are refused. `tries` candidates are
    made for each ticket asked for, and the best scores stay.
    """
    from urnwise.operators.descriptive import pair_tests

    ticket = F.explode(F.sequence(F.lit(0), F.lit(count * tries - 1))).alias("ticket")
    own = Window.partitionBy("game")
    low, high = F.min("score").over(own), F.max("score").over(own)
    base = scores.withColumn("p", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.col("score")) + 0.01)
    base = base.withColumn("p", F.pow(F.col("p") / F.sum("p").over(own), F.lit(1.5))).withColumn("p", F.col("p") / F.sum("p").over(own))
    start = per_game(lambda g: F.lit(g.k // 2 + 1))
    race = Window.partitionBy("game", "ticket").orderBy("u", "dezena")
    seeds = base.where(F.col("rank") <= F.greatest(start * 2, F.lit(10))).select("game", "dezena", ticket).withColumn("u", F.rand(seed)).withColumn("r", F.row_number().over(race)).where(F.col("r") <= start).select("game", "ticket", "dezena")
    lifts = pair_tests(items, 0.0)
    both = lifts.select("game", F.col("a").alias("x"), F.col("b").alias("y"), "lift").union(lifts.select("game", "b", "a", "lift"))
    part = F.when(F.col("lift") > 1.1, (F.col("lift") - 1) * 0.5).when(F.col("lift") < 0.9, -(1 - F.col("lift")) * 0.3).otherwise(0.0)
    moved = seeds.join(both.withColumnRenamed("x", "dezena"), ["game", "dezena"]).groupBy("game", "ticket", F.col("y").alias("dezena")).agg(F.sum(part).alias("bonus"))
    rest = base.select("game", "dezena", "p", ticket).join(seeds, ["game", "ticket", "dezena"], "left_anti").join(moved, ["game", "ticket", "dezena"], "left")
    weight = F.when(F.abs(F.coalesce("bonus", F.lit(0.0))) > 0.01, F.greatest(F.col("p") + F.col("bonus") * 0.1, F.lit(0.001))).otherwise(F.col("p"))
    filled = rest.withColumn("u", -F.log(1 - F.rand(seed + 1)) / weight).withColumn("r", F.row_number().over(race)).where(F.col("r") <= per_game(lambda g: F.lit(g.k)) - start).select("game", "ticket", "dezena")
    nums = seeds.unionByName(filled).join(scores.select("game", "dezena", "score"), ["game", "dezena"]).groupBy("game", "ticket").agg(F.array_sort(F.collect_list("dezena")).alias("nums"), F.sum("score").alias("s"))
    fit = profile_fit(nums, profile).where("fit >= 0.4").withColumn("score", F.col("s") * 0.7 + F.col("fit") * F.col("s") * 0.3)
    best = fit.dropDuplicates(["game", "nums"]).withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "nums")))
    return best.where(F.col("rank") <= count).select("game", "nums", "score", "fit", "rank")

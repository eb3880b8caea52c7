"""Ticket makers that chain several operators, and the three-branch return simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urnwise.functions.scalar import bit_of
from urnwise.games import GAMES
from urnwise.operators.descriptive import sum_stats
from urnwise.operators.features import counts_before
from urnwise.operators.recommend import basic_weights, ticket_scores
from urnwise.operators.sequence import last_draws
from urnwise.operators.tickets import best_of_equal, evaluate, per_game, prized, unpopularity, weighted
from urnwise.operators.validation import prefix_scores, roi


def k_of() -> Column:
    return per_game(lambda g: F.lit(g.k))


def basic_tickets(items: DataFrame, count: int = 10, tries: int = 20, seed: int = 42) -> DataFrame:
    """`count` tickets for each game from the basic weights whose sum lies in the usual band and whose evens are near half; the best basic scores."""
    drawn = weighted(basic_weights(items), count * tries, k_of(), seed)
    n = F.col("nums")
    soma, even = F.aggregate(n, F.lit(0), lambda a, x: a + x), F.size(F.filter(n, lambda x: x % 2 == 0))
    band = sum_stats(items).select("game", "low", "high")
    kept = drawn.join(band, "game").where(soma.between(F.col("low"), F.col("high")) & (F.abs(even - F.floor(F.size(n) / 2)) <= 2)).dropDuplicates(["game", "nums"]).select("game", "ticket", "nums")
    scored = kept.join(ticket_scores(kept, items), ["game", "ticket"])
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("game").orderBy(F.desc("score"), "nums"))).where(F.col("rank") <= count)


def integrated_tickets(scores: DataFrame, prev: DataFrame, top: int = 20, candidates: int = 400, count: int = 10, seed: int = 3000) -> DataFrame:
    """Tickets from the `top` numbers by score (game, dezena, score), filtered by structure against the last draw (game, prev), ranked by 0.6 of the mean score and 0.4 of unpopularity."""
    own = Window.partitionBy("game")
    best = scores.withColumn("r", F.row_number().over(own.orderBy(F.desc("score"), "dezena"))).where(F.col("r") <= top)
    best = best.withColumn("weight", F.col("score") - F.min("score").over(own) + 0.01)
    drawn = weighted(best, candidates, F.least(k_of(), F.lit(top)), seed)
    kept = evaluate(drawn.join(prev, "game"), "prev").where("passou").select("game", "ticket", "nums")
    mean = kept.select("game", "ticket", F.explode("nums").alias("dezena")).join(best.select("game", "dezena", "score"), ["game", "dezena"]).groupBy("game", "ticket").agg(F.avg("score").alias("s"))
    final = best_of_equal(unpopularity(kept).join(mean, ["game", "ticket"]).withColumn("final", F.col("s") * 0.6 + F.col("impopularidade") * 0.4), "final")
    return final.withColumn("rank", F.row_number().over(own.orderBy(F.desc("final"), "nums"))).where(F.col("rank") <= count).select("game", "nums", "s", "impopularidade", "final", "rank")


def per_draw(weights: DataFrame, count: int, seed: int) -> DataFrame:
    """`count` tickets for each (game, numero) from weights (game, numero, dezena, weight): the k smallest of -ln(u) / weight, u seeded."""
    race = weights.select("game", "numero", "dezena", "weight", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("ticket"))
    u = (F.pmod(F.xxhash64("game", "numero", "ticket", "dezena", F.lit(seed)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    race = race.withColumn("t", -F.log(u) / F.col("weight")).withColumn("r", F.row_number().over(Window.partitionBy("game", "numero", "ticket").orderBy("t", "dezena")))
    return race.where(F.col("r") <= k_of()).groupBy("game", "numero", "ticket").agg(F.array_sort(F.collect_list("dezena")).alias("nums"))


def roi_branches(ctx: DataFrame, last: int = 20, count: int = 5, pool: int = 18, seed: int = 7) -> DataFrame:
    """Return of three branches on the last draws: A, weighted by frequency and gap before the draw; B, valid and unpopular tickets of the numbers that were hot before it; random."""
    own = Window.partitionBy("game", "numero")
    scores = prefix_scores(ctx, last)
    a = per_draw(scores.withColumn("weight", F.col("score") - F.min("score").over(own) + 0.01), count, seed).withColumn("branch", F.lit("A"))
    r = per_draw(scores.withColumn("weight", F.lit(1.0)), count, seed + 1).withColumn("branch", F.lit("random"))
    hot = last_draws(counts_before(ctx, 30), "game", last).withColumn("r", F.row_number().over(own.orderBy(F.desc("f"), "n"))).where(F.col("r") <= F.greatest(F.lit(pool), k_of() + 2))
    b = per_draw(hot.select("game", "numero", F.col("n").alias("dezena"), F.lit(1.0).alias("weight")), count * 10, seed + 2)
    b = evaluate(b.join(ctx.select("game", "numero", "prev"), ["game", "numero"]), "prev")
    b = unpopularity(b).withColumn("r", F.row_number().over(own.orderBy(F.desc("score"), F.desc("impopularidade"), "nums"))).where(F.col("r") <= count).select("game", "numero", "ticket", "nums").withColumn("branch", F.lit("B"))
    tickets = a.unionByName(b).unionByName(r).join(ctx.select("game", "numero", "dezenas"), ["game", "numero"])
    return roi(prized(tickets))


def one_hot(log: DataFrame, game: str) -> DataFrame:
    """The wide frame of a game, n01 to nMM: bits of the draw's word, no shuffle."""
    return log.where(F.col("game") == game).select("game", "numero", *(bit_of(F.col("mask"), F.lit(i)).alias(f"n{i:02d}") for i in range(1, GAMES[game].m + 1)))


def retro_tickets(log: DataFrame, ranking: DataFrame, count: int = 5, seed: int = 1) -> DataFrame:
    """Per recent draw: hits of the best of `count` tickets, drawn in proportion to the scores that the draw's own past gives."""
    own = Window.partitionBy("game", "numero")
    low, high = F.min("score").over(own), F.max("score").over(own)
    weights = ranking.withColumn("weight", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.col("score")) + 0.01)
    tickets = per_draw(weights, count, seed).join(log.select("game", "numero", "dezenas"), ["game", "numero"])
    return tickets.groupBy("game", "numero").agg(F.max(F.size(F.array_intersect("nums", "dezenas"))).alias("best_hits"), F.count("*").alias("tickets"))

"""Walk-forward backtests, retro evaluation and return on tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urnwise.cluster import cut
from urnwise.operators.hypotheses import by_hand, by_hand_family, named_tallies, test, with_p
from urnwise.operators.sequence import last_draws, running
from urnwise.operators.tickets import per_game


def baseline() -> F.Column:
    """Expected hits of a random ticket: k * k / m."""
    return per_game(lambda g: F.lit(g.k * g.k / g.m))


def walk_forward(predictions: DataFrame, last: int = 50, least_train: int = 30, p: float = 0.15) -> DataFrame:
    """Per target draw: hits of the k best numbers, scored by the predictors that the draws before the target support.

    Tallies before each target are running totals, so the log is read once instead of
    once for each target.
    """
    some = F.size("pred") > 0
    counted = predictions.where("idx > 0")
    rows = running(counted, "game", {"tentativas": some.cast("long"), "acertos": (some & F.arrays_overlap("pred", "dezenas")).cast("long"), "previstos": F.when(some, F.size("pred")).otherwise(0).cast("long")}, by=("nome",))
    # totals before the target: without its own draw
    rows = rows.withColumn("tentativas", F.col("tentativas") - some.cast("long")).withColumn("acertos", F.col("acertos") - (some & F.arrays_overlap("pred", "dezenas")).cast("long")).withColumn("previstos", F.col("previstos") - F.when(some, F.size("pred")).otherwise(0))
    return _tested(last_draws(rows, "game", last).where(F.col("idx") >= least_train), p)


def walk_forward_by_hand(ctx: DataFrame, last: int = 50, least_train: int = 30, p: float = 0.15) -> DataFrame:
    """walk_forward(by_hand_family(ctx)) where only predictions of the last draws become rows: draws before them are counted as they are read."""
    top = ctx.groupBy("game").agg((F.max("idx") - last).alias("_from"))
    split = ctx.join(F.broadcast(top), "game")  # one row for each game
    sums = ("tentativas", "acertos", "previstos")
    old = named_tallies(split.where("idx <= _from").drop("_from"), {n: x for n, (_, x) in by_hand().items()})
    old = F.broadcast(old.select("game", "nome", *(F.col(c).alias(f"_{c}") for c in sums)))  # a row for each game and predictor
    late = by_hand_family(split.where("idx > greatest(_from, 0)").drop("_from")).drop("cat")
    some = F.coalesce(F.size("pred"), F.lit(0)) > 0
    own = {"tentativas": some.cast("long"), "acertos": (some & F.arrays_overlap("pred", "dezenas")).cast("long"), "previstos": F.when(some, F.size("pred")).otherwise(0).cast("long")}
    before = Window.partitionBy("game", "nome").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)  # `last` rows
    rows = late.join(old, ["game", "nome"], "left")
    rows = rows.select("game", "numero", "idx", "dezenas", "nome", "pred", *((F.coalesce(f"_{c}", F.lit(0)) + F.coalesce(F.sum(x).over(before), F.lit(0))).alias(c) for c, x in own.items()))
    return _tested(cut(rows.where(F.col("idx") >= least_train)), p)


def _tested(targets: DataFrame, p: float) -> DataFrame:
    """walk_forward of the target draws' predictions, with the tallies before each."""
    keyed = targets.select(F.col("game"), F.concat_ws("@", "nome", "idx").alias("nome"), "tentativas", "acertos", "previstos")
    tested = with_p(test(keyed)).where(F.col("p_valor") < p).withColumn("w", (1 - F.col("p_valor")) * F.abs(F.col("lift") - 1) * F.when(F.col("lift") > 1, 1.0).otherwise(-0.5))
    weights = tested.select("game", F.substring_index("nome", "@", 1).alias("nome"), F.substring_index("nome", "@", -1).cast("long").alias("idx"), "w")
    scored = targets.select("game", "idx", "nome", F.explode("pred").alias("dezena")).join(weights, ["game", "nome", "idx"]).groupBy("game", "idx", "dezena").agg(F.sum("w").alias("s"))
    goals = targets.select("game", "idx", "numero", "dezenas").distinct()
    grid = goals.select("game", "idx", "numero", "dezenas", F.explode(per_game(lambda g: F.sequence(F.lit(1), F.lit(g.m)))).alias("dezena"))
    rank = F.row_number().over(Window.partitionBy("game", "idx").orderBy(F.desc(F.round(F.coalesce("s", F.lit(0.0)), 9)), "dezena"))
    best = grid.join(scored, ["game", "idx", "dezena"], "left").withColumn("rank", rank).where(F.col("rank") <= per_game(lambda g: F.lit(g.k)))
    return best.groupBy("game", "numero").agg(F.count_if(F.array_contains("dezenas", F.col("dezena"))).alias("hits")).withColumn("baseline", baseline())


def hit_distribution(hits: DataFrame) -> DataFrame:
    """Per game and number of hits: how many draws."""
    return hits.groupBy("game", "hits").agg(F.count("*").alias("draws"))


def before(log: DataFrame, last: int) -> DataFrame:
    """Per recent draw and number, from earlier draws only: times drawn (f), last place (seen, -1 for never) and last draw number (seen_numero, 0), and the number of the draw before (top).

    Earlier draws are counted once; only the last ones, `last` for each game, are rows.
    """
    split = F.max("idx") - last
    edge = log.groupBy("game").agg(split.alias("_edge"))
    rows = log.select("game", "idx", "numero", "dezenas", "mask").join(F.broadcast(edge), "game")  # one row for each game
    old = rows.where("idx <= _edge").select("game", "idx", "numero", F.explode("dezenas").alias("n")).groupBy("game", "n").agg(F.count("*").alias("f0"), F.max("idx").alias("s0"), F.max("numero").alias("d0"))
    late = rows.where("idx > _edge").select("game", "idx", "numero", "mask", F.explode(per_game(lambda g: F.sequence(F.lit(1), F.lit(g.m)))).alias("n"))
    hit = F.getbit(F.col("mask"), F.col("n")) == 1
    w = Window.partitionBy("game", "n").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)  # `last` rows
    top = F.lag("numero").over(Window.partitionBy("game", "n").orderBy("idx"))
    rows = late.join(F.broadcast(old), ["game", "n"], "left").select(
        "game", "idx", "numero", "n", (F.coalesce("f0", F.lit(0)) + F.coalesce(F.sum(hit.cast("int")).over(w), F.lit(0))).alias("f"),
        F.coalesce(F.max(F.when(hit, F.col("idx"))).over(w), "s0", F.lit(-1)).alias("seen"), F.coalesce(F.max(F.when(hit, F.col("numero"))).over(w), "d0", F.lit(0)).alias("seen_numero"), top.alias("top"),
    )
    known = log.join(F.broadcast(edge), "game").where("idx <= _edge").groupBy("game").agg(F.max("numero").alias("_top"))
    return rows.join(F.broadcast(known), "game", "left").withColumn("top", F.coalesce("top", "_top")).drop("_top")


def retro_ranking(log: DataFrame, last: int = 10) -> DataFrame:
    """Rows (game, numero, idx, dezena, score, rank) for each recent draw: frequency and gap as the draws before it have them."""
    rows = before(log, last).where("idx > 0")
    rows = rows.withColumn("score", F.col("f") / F.col("idx") * 0.3 + F.least((F.col("top") - F.col("seen_numero")) / 15, F.lit(0.5)) * 0.2)
    rank = F.row_number().over(Window.partitionBy("game", "idx").orderBy(F.desc(F.round("score", 9)), "n"))
    return rows.select("game", "numero", "idx", F.col("n").alias("dezena"), "score", rank.alias("rank"))


def retro(ranking: DataFrame, log: DataFrame, tops: tuple[int, ...] = (10, 15, 20)) -> DataFrame:
    """Per recent draw and size of the top list (also k): hits of the best numbers of its own ranking (game, idx, dezena, rank) and the expectation."""
    sizes = F.array_distinct(F.concat(F.array(per_game(lambda g: F.lit(g.k))), F.array(*map(F.lit, tops))))
    lists = ranking.groupBy("game", "idx").agg(F.sort_array(F.collect_list(F.struct("rank", "dezena"))).alias("r")).select("game", "idx", F.transform("r", lambda x: x["dezena"]).alias("best"))
    out = log.select("game", "idx", "numero", "dezenas").join(F.broadcast(lists), ["game", "idx"]).select("game", "numero", "dezenas", "best", F.explode(sizes).alias("top"))
    return out.select("game", "numero", "top", F.size(F.array_intersect(F.slice("best", F.lit(1), F.col("top")), F.col("dezenas"))).alias("hits"), (F.col("top") * per_game(lambda g: F.lit(g.k / g.m))).alias("expected"))


def verdict(retro_rows: DataFrame) -> DataFrame:
    """Per game and list size: mean hits against the expectation, in words."""
    per = retro_rows.groupBy("game", "top").agg(F.avg("hits").alias("mean"), F.avg("expected").alias("expected"))
    return per.withColumn("verdict", F.when(F.col("mean") > F.col("expected") * 1.1, "above chance").when(F.col("mean") < F.col("expected") * 0.9, "below chance").otherwise("at the level of chance"))


def roi(checked: DataFrame) -> DataFrame:
    """Per game and branch of checked tickets (game, branch, numero, hits, prize): draws, tickets, hits, prizes, cost, profit, return in percent."""
    cost = per_game(lambda g: F.lit(g.ticket))
    per = checked.groupBy("game", "branch").agg(
        F.count_distinct("numero").alias("draws"), F.count("*").alias("tickets"), F.avg("hits").alias("mean_hits"), F.max("hits").alias("best"),
        F.count_if(F.col("prize") > 0).alias("prizes"), F.sum("prize").alias("won"), F.sum(cost).alias("cost"),
    )
    return per.withColumn("profit", F.col("won") - F.col("cost")).withColumn("roi_pct", F.when(F.col("cost") > 0, (F.col("won") / F.col("cost") - 1) * 100).otherwise(0.0))


def prefix_scores(log: DataFrame, last: int = 20) -> DataFrame:
    """Branch A's score of each number before each recent draw: 0.6 of its frequency share and 0.4 of its gap in units of 20 draws, at most a half, from earlier draws only."""
    score = F.col("f") / F.col("idx") * 0.6 + F.least((F.col("idx") - 1 - F.col("seen")) / 20, F.lit(0.5)) * 0.4
    return before(log, last).where("idx > 0").select("game", "numero", F.col("n").alias("dezena"), score.alias("score"))

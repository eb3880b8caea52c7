"""Tickets (game, ticket, nums: sorted array): filters, popularity, ranking, combinations, covering, checking."""

from __future__ import annotations

from functools import reduce
from itertools import combinations as subsets
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urnwise.cluster import cut
from urnwise.functions.scalar import mask
from urnwise.games import GAMES
from urnwise.operators.features import size_of
from urnwise.operators.sequence import placed


def per_game(f) -> Column:
    """Column: f(game) of the row's game."""
    return F.coalesce(*(F.when(F.col("game") == g.key, f(g)) for g in GAMES.values()))


def longest_run(nums: Column) -> Column:
    """Length of the longest run of consecutive numbers of a sorted array."""
    step = lambda s, x: F.struct(x.alias("last"), F.when(x == s["last"] + 1, s["run"] + 1).otherwise(F.lit(1)).alias("run"), F.greatest(s["best"], F.when(x == s["last"] + 1, s["run"] + 1).otherwise(F.lit(1))).alias("best"))
    return F.aggregate(nums, F.struct(F.lit(-9).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda s: s["best"])


def band_counts(nums: Column) -> Column:
    """Array: how many of the numbers lie in each band of the game."""
    inside = lambda low, high: lambda d: (d >= low) & (d <= high)
    return per_game(lambda g: F.array(*(F.size(F.filter(F.array_distinct(nums), inside(*b))) for b in g.bands)))


def evaluate(tickets: DataFrame, prev: str | None = None) -> DataFrame:
    """Tickets with each structural check, the share of passed checks and whether all passed; prev: an array column to count repeats with."""
    n = F.col("nums")
    inside = lambda name, v: per_game(lambda g: (v >= g.profile[name][2]) & (v <= g.profile[name][3]))
    rows = tickets.withColumn("soma", F.aggregate(n, F.lit(0), lambda a, x: a + x)).withColumn("impares", F.size(F.filter(n, lambda x: x % 2 == 1))).withColumn("max_seq", longest_run(n)).withColumn("faixas", band_counts(n))
    checks = {"ok_soma": inside("sum", F.col("soma")), "ok_impares": inside("odd", F.col("impares")), "ok_max_seq": inside("max_run", F.col("max_seq")), "ok_faixas": per_game(lambda g: F.forall("faixas", lambda c: (c >= g.profile["band"][2]) & (c <= g.profile["band"][3])))}
    if prev:
        rows = rows.withColumn("repetidos", F.size(F.array_intersect(n, F.col(prev))))
        checks["ok_repetidos"] = inside("repeats", F.col("repetidos"))
    rows = rows.select("*", *(c.alias(k) for k, c in checks.items()))
    passed = reduce(lambda a, b: a + b, (F.col(k).cast("int") for k in checks))
    return rows.withColumn("score", passed / len(checks)).withColumn("passou", passed == len(checks))


def valid(tickets: DataFrame, prev: str | None = None) -> DataFrame:
    """The tickets that pass every check."""
    return evaluate(tickets, prev).where("passou").select(*tickets.columns)


def popularity(n: Column, m: Column) -> Column:
    """How liked a number is, 0 to 1: dates, months, round numbers, the sheet's middle, repeated digits."""
    part = lambda cond, w: F.when(cond, F.lit(w)).otherwise(0.0)
    middle = (F.lit(1.0) - F.abs(n - m / 2) / (m / 2)) * 0.1
    score = part(n <= 31, 0.3) + part(n <= 12, 0.2) + part(n % 10 == 0, 0.15) + part(n % 5 == 0, 0.1) + middle + part((n >= 10) & (F.floor(n / 10) == n % 10), 0.15)
    return F.least(score, F.lit(1.0))


def sequence_penalty(nums: Column) -> Column:
    """0.05 for each number in runs of four or more; 0.5 for an arithmetic progression."""
    zero = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("total"))
    close = lambda s: s["total"] + F.when(s["run"] >= 4, s["run"]).otherwise(0)
    step = lambda s, x: F.when(x == s["last"] + 1, F.struct(x.alias("last"), (s["run"] + 1).alias("run"), s["total"].alias("total"))).otherwise(F.struct(x.alias("last"), F.lit(1).alias("run"), close(s).alias("total")))
    runs = F.aggregate(nums, zero, step, close)
    k = F.size(nums)
    gaps = F.when(k > 1, F.zip_with(F.slice(nums, 1, k - 1), F.slice(nums, 2, k - 1), lambda a, b: b - a))
    return runs * 0.05 + F.when(F.size(F.array_distinct(gaps)) == 1, 0.5).otherwise(0.0)


def unpopularity(tickets: DataFrame) -> DataFrame:
    """Tickets with `impopularidade`, 0 to 1, larger for those that few people play."""
    n, m = F.col("nums"), size_of()
    mean = F.aggregate(F.transform(n, lambda d: popularity(d, m)), F.lit(0.0), lambda a, x: a + x) / F.size(n)
    middle = per_game(lambda g: F.lit(g.k * (g.m + 1) / 2))
    off = F.abs(F.aggregate(n, F.lit(0), lambda a, x: a + x) - middle) / middle
    score = (1 - mean) - sequence_penalty(n) + F.least(off * 0.3, F.lit(0.15))
    return tickets.withColumn("impopularidade", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def ranked(tickets: DataFrame, by: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Tickets with their rank in the game, the largest value (of low..high, or beyond) first, ties by smaller numbers, then by ticket; sorted in slices of the value."""
    slice_ = F.floor((high - F.round(by, 9)) / (high - low) * 4096)
    return placed(tickets, "game", slice_, [F.desc(F.round(by, 9)), "nums", "ticket"], "_place").withColumn("rank", F.col("_place") + 1).drop("_place")


def best_of_equal(tickets: DataFrame, by: str) -> DataFrame:
    """One row for each combination, that of the largest value."""
    order = Window.partitionBy("game", "nums").orderBy(F.desc(by))
    return tickets.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def combinations(pool: DataFrame, k: int, pool_size: int) -> DataFrame:
    """All k-subsets of each game's pool (game, nums), at most C(pool_size, k) for each.

    A pool of n has C(n, k) combinations; each is unranked from its number, so the
    numbers are dealt out by `range` and no self-join grows step by step.
    """
    spark, total = pool.sparkSession, comb(pool_size, k)
    arrays = pool.groupBy("game").agg(F.array_sort(F.collect_list("dezena")).alias("pool")).where(F.size("pool") == pool_size)
    table = [[comb(a, b) for b in range(k + 1)] for a in range(pool_size + 1)]
    binomial = F.array(*(F.array(*(F.lit(x).cast("long") for x in row)) for row in table))

    def step(s, i):
        # place i holds the pool's member i: take it if the combinations with it cover the number left
        left, need = s["left"], s["need"]
        with_it = F.when(need > 0, F.get(F.get(binomial, F.lit(pool_size) - 1 - i), (need - 1).cast("int"))).otherwise(F.lit(0).cast("long"))
        take = (need > 0) & (left < with_it)
        return F.struct(F.when(take, left).otherwise(left - with_it).alias("left"), F.when(take, need - 1).otherwise(need).cast("int").alias("need"), F.when(take, F.concat(s["out"], F.array(i))).otherwise(s["out"]).alias("out"))

    number = spark.range(total)
    picks = F.aggregate(F.sequence(F.lit(0), F.lit(pool_size - 1)), F.struct(F.col("id").alias("left"), F.lit(k).alias("need"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])
    places = number.select(picks.alias("places"))
    games = [r["game"] for r in arrays.select("game").collect()]  # one row for each game
    named = places.select(F.explode(F.array(*map(F.lit, games))).alias("game"), "places") if games else places.select(F.lit("").alias("game"), "places").limit(0)
    return named.join(arrays, "game").select("game", F.transform("places", lambda i: F.get(F.col("pool"), i)).alias("nums"))


def covered(tickets: DataFrame, targets: DataFrame, at_least: int) -> DataFrame:
    """Per game: targets, and those of which some ticket holds at_least numbers.

    The chosen tickets are few (a wheel has a ticket limit): they are one array for each
    game, and every target is looked at once, where it lies.
    """
    chosen = tickets.groupBy("game").agg(F.collect_list(mask(F.col("nums"))).alias("masks"))
    rows = targets.withColumn("t", mask(F.col("nums"))).join(chosen, "game", "left")
    hit = F.exists(F.coalesce("masks", F.array().cast("array<bigint>")), lambda c: F.bit_count(c.bitwiseAND(F.col("t"))) >= at_least)
    return rows.groupBy("game").agg(F.count("*").alias("targets"), F.count_if(hit).alias("covered")).withColumn("share", F.col("covered") / F.col("targets"))


def meetings(candidates: DataFrame, targets: DataFrame, at_least: int) -> DataFrame:
    """Distinct (m, t): the words of candidates and targets (nums) that share at_least numbers, through a key for each subset of so many."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        sizes = sorted(r["n"] for r in df.select(F.size("nums").alias("n")).distinct().collect())  # sizes of tickets and targets: one each
        places = {n: [list(c) for c in subsets(range(n), at_least)] for n in sizes if n >= at_least}
        parts = [df.where(F.size("nums") == n).select(mask(F.col("nums")).alias(name), F.explode(F.array(*(F.array(*map(F.lit, c)) for c in own))).alias("c"), "nums") for n, own in places.items()]
        rows = reduce(DataFrame.unionByName, parts) if parts else df.select(mask(F.col("nums")).alias(name), F.array().cast("array<int>").alias("c"), "nums").limit(0)
        return rows.select(name, mask(F.transform("c", lambda i: F.get(F.col("nums"), i))).alias("key"))

    return keyed(candidates, "m").join(keyed(targets, "t"), "key").select("m", "t").distinct()


def greedy_cover(candidates: DataFrame, targets: DataFrame, at_least: int, limit: int, overlap: float = 0.4) -> tuple[DataFrame, int]:
    """(rows (step, nums) of chosen tickets, targets left) for candidates and targets (nums) of one pool.

    Each step takes the candidate with the best gain, weighted by how near its mean
    overlap with those chosen is to `overlap`, the smallest numbers on ties. Which
    candidate meets which target is joined once (`meetings`); a target is taken off the gains of
    those that meet it once, in the step that covers it. The driver gets the chosen ticket
    of each step.
    """
    spark = candidates.sparkSession
    left = targets.select(mask(F.col("nums")).alias("t")).distinct().count()
    met = cut(meetings(candidates, targets, at_least))
    gains = met.groupBy("m").agg(F.count("*").alias("gain"))
    state = candidates.select("nums", mask(F.col("nums")).alias("m")).join(gains, "m").withColumn("near", F.lit(0.0))
    out, hits = [], []
    while left and len(out) < limit:
        state = cut(state)
        score = F.col("gain") * 0.7 + (F.lit(1.0) - F.abs(F.col("near") / max(len(out), 1) - overlap) if out else F.lit(1.0)) * F.col("gain") * 0.3
        best = state.where("gain > 0").withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), "nums").limit(1).collect()
        if not best:
            break
        out.append((len(out), best[0]["nums"]))
        chosen = F.lit(best[0]["m"])
        left -= best[0]["gain"]
        own = met.where(F.col("m") == chosen).select("t")
        hit = cut(own.join(reduce(DataFrame.unionByName, hits), "t", "left_anti") if hits else own)
        hits.append(hit)
        lost = met.join(hit, "t").groupBy("m").agg(F.count("*").alias("lost"))
        near = F.col("near") + F.bit_count(F.col("m").bitwiseAND(chosen)) / F.size("nums")
        state = state.where(F.col("m") != chosen).join(lost, "m", "left").select("nums", "m", (F.col("gain") - F.coalesce("lost", F.lit(0))).alias("gain"), near.alias("near"))
    return spark.createDataFrame(out, "step int, nums array<int>"), left


def exact_cover(candidates: list[list[int]], targets: list[list[int]], at_least: int, limit: int, nodes: int = 200_000) -> list[list[int]] | None:
    """A smallest set of candidates that covers every target, by branch and bound on the target with the fewest candidates; None beyond `limit` tickets, or if `nodes` steps don't prove one the smallest."""
    sets = [frozenset(c) for c in candidates]
    of = [frozenset(i for i, s in enumerate(sets) if len(s & frozenset(t)) >= at_least) for t in targets]
    if not all(of):
        return None
    covers = [frozenset(j for j, o in enumerate(of) if i in o) for i in range(len(sets))]
    widest = max(map(len, covers), default=1)
    best: list[int] | None = None
    left = nodes

    def search(chosen: list[int], open_: frozenset) -> None:
        nonlocal best, left
        left -= 1
        most = min(limit, len(best) - 1 if best is not None else limit)
        if not open_:
            if len(chosen) <= most:
                best = list(chosen)
            return
        if left <= 0 or len(chosen) + -(-len(open_) // widest) > most:
            return
        target = min(open_, key=lambda j: len(of[j]))
        for i in sorted(of[target], key=lambda i: -len(covers[i] & open_)):
            search([*chosen, i], open_ - covers[i])

    search([], frozenset(range(len(targets))))
    return [candidates[i] for i in best] if best is not None and left > 0 else None


def wheel(pool: DataFrame, game: str, at_least: int, condition: int, limit: int, prev: list[int] | None = None, filtered: bool = True) -> DataFrame:
    """A covering design over a pool (game, dezena): rows (ticket, nums, method, pool_size, targets, covered, coverage, cost).

    Tickets are combinations of the pool that pass the structural filter (all, if none
    does), targets its subsets of `condition` numbers. A smallest set is sought for at
    most 200 of each; else, or if none is proven, a greedy one.
    """
    g, spark = GAMES[game], pool.sparkSession
    size = pool.where(F.col("game") == game).count()
    every = combinations(pool.where(F.col("game") == game), g.k, size)
    kept = valid(every.withColumn("prev", F.array(*map(F.lit, prev))), "prev").drop("prev") if filtered and prev else valid(every) if filtered else every
    candidates = cut(kept)
    candidates = candidates if candidates.limit(1).count() else cut(every)
    targets = cut(combinations(pool.where(F.col("game") == game), condition, size))
    n = targets.count()
    exact = None
    if candidates.count() <= 200 and n <= 200:
        rows = [[r["nums"] for r in df.orderBy("nums").collect()] for df in (candidates, targets)]
        exact = exact_cover(*rows, at_least, limit)
    if exact is not None:
        chosen, left = spark.createDataFrame(list(enumerate(exact)), "step int, nums array<int>"), 0
    else:
        chosen, left = greedy_cover(candidates, targets, at_least, limit)
    tickets = chosen.count()
    return chosen.select(F.col("step").alias("ticket"), "nums", F.lit("greedy" if exact is None else "exact").alias("method"), F.lit(size).alias("pool_size"), F.lit(n).alias("targets"), F.lit(n - left).alias("covered"), F.lit((n - left) / max(1, n)).alias("coverage"), F.lit(tickets * g.ticket).alias("cost"))


def simulate(tickets: DataFrame, pool: DataFrame, drawn: DataFrame) -> DataFrame:
    """Per draw of the pool's game: tickets, the best one's hits, and how many of the pool (game, dezena) were drawn; the tickets (game, nums) of a wheel are few and go along as one array."""
    words = tickets.groupBy("game").agg(F.collect_list(mask(F.col("nums"))).alias("ms")).join(pool.groupBy("game").agg(mask(F.collect_list("dezena")).alias("p")), "game")
    rows = drawn.select("game", "numero", "mask").join(F.broadcast(words), "game")
    return rows.select("game", "numero", F.size("ms").alias("tickets"), F.array_max(F.transform("ms", lambda m: F.bit_count(m.bitwiseAND(F.col("mask"))))).alias("best"), F.bit_count(F.col("p").bitwiseAND(F.col("mask"))).alias("pool_hits"))


def best_of_group(checked: DataFrame) -> DataFrame:
    """Per draw, the ticket with the most hits, the smallest ticket on ties."""
    return checked.groupBy("game", "numero").agg(F.max_by(F.struct("ticket", "hits", "prize"), F.struct("hits", -F.col("ticket"))).alias("x")).select("game", "numero", "x.*")


def best_of_tickets(tickets: DataFrame, drawn: DataFrame) -> DataFrame:
    """best_of_group(check(tickets, drawn)) inside the draw's row: a game's tickets (few) are an array beside it, so no draw is multiplied or grouped."""
    held = tickets.groupBy("game").agg(F.collect_list(F.struct("ticket", "nums")).alias("tickets"))  # a row for each game
    rows = drawn.select("game", "numero", "dezenas").join(F.broadcast(held), "game")
    each = F.transform("tickets", lambda t: F.struct(F.size(F.array_intersect(t["nums"], F.col("dezenas"))).alias("hits"), (-t["ticket"]).alias("t")))
    best = rows.select("game", "numero", F.array_max(each).alias("x")).select("game", "numero", (-F.col("x.t")).alias("ticket"), "x.hits")
    return best.withColumn("prize", _prize())


def _prize() -> Column:
    return per_game(lambda g: F.coalesce(*(F.when(F.col("hits") == h, F.lit(p)) for h, p in g.prizes.items()), F.lit(0.0)))


def prized(tickets: DataFrame) -> DataFrame:
    """Tickets that stand beside their draw's `dezenas`, with hits, prize and whether they won."""
    return tickets.withColumn("hits", F.size(F.array_intersect("nums", "dezenas"))).withColumn("prize", _prize()).withColumn("won", per_game(lambda g: F.col("hits") >= g.check_from)).drop("dezenas")


def check(tickets: DataFrame, drawn: DataFrame) -> DataFrame:
    """Hits and prize of each ticket against the draws of its game (drawn: game, numero, dezenas)."""
    return prized(tickets.join(drawn.select("game", "numero", "dezenas"), "game"))


def weighted(weights: DataFrame, count: int, k: Column, seed: int = 42, power: float = 1.0) -> DataFrame:
    """`count` tickets for each game, k numbers without replacement in proportion to weight (game, dezena, weight): the k smallest of -ln(u) / weight."""
    u = F.rand(seed)
    race = weights.where("weight > 0").select("game", "dezena", "weight", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("ticket"))
    race = race.withColumn("t", -F.log(1 - u) / F.pow("weight", F.lit(power))).withColumn("r", F.row_number().over(Window.partitionBy("game", "ticket").orderBy("t", "dezena")))
    return race.where(F.col("r") <= k).groupBy("game", "ticket").agg(F.array_sort(F.collect_list("dezena")).alias("nums"))

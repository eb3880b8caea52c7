"""One registered query for each operator, on draws mapped from the order tables.

Integers leave as long and doubles rounded to six places, so that results compare
across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnwise.cluster import cut, ship
from urnwise.functions.scalar import date_text
from urnwise.games import GAMES, prizes
from urnwise.operators import bank as B
from urnwise.operators import descriptive as D
from urnwise.operators import diagnostics as G
from urnwise.operators import features as X
from urnwise.operators import hypotheses as H
from urnwise.operators import learning as L
from urnwise.operators import packed as P
from urnwise.operators import recommend as R
from urnwise.operators import refits as W
from urnwise.operators import simulation as M
from urnwise.operators import surrogates as U
from urnwise.operators import tickets as T
from urnwise.operators import validation as V
from urnwise.operators.sequence import last_draws
from urnwise.sources import draws as S
from urnwise.streaming import loop

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BASE = {"g6_60": [5, 17, 33], "g15_25": [2, 9, 20]}
POOLS = {"g6_60": 10, "g15_25": 17}
#: Names of every kind of the grammar, also those that only evolution makes.
EVOLVED = ["dia.inv>dsum", "conc.mod10>x2>sqrt", "set.prev@dia.add", "set.prev_viz@soma_prev.xor", "window.max_prev_alto→pares", "setop.prev_union_prev2", "setop.ausentes2_diff_prev_comp", "nest.(diaaddmes)mulconc100", "nest.(soma_prevmodamp_prev)xorlua"]


def neat(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles rounded, no negative zero."""

    def of(name, kind):
        c = F.col(name)
        return c.cast("long") if kind in ("int", "smallint", "tinyint") else F.round(c, 6) + F.lit(0.0) if kind == "double" else c

    return df.select(*(of(n, k).alias(n) for n, k in df.dtypes))


def query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return neat(f(spark, sf_dir))

    QUERIES[f.__name__] = run
    return f


@query
def item_frequency(spark, d):
    return D.frequency(S.draw_items(spark, d))


@query
def item_recency(spark, d):
    return D.recency(S.draw_items(spark, d))


@query
def draw_log(spark, d):
    return S.ctx(spark, d).select("game", "numero", "idx", date_text(F.col("data")).alias("data"), "local", "acumulado", "valor_arrecadado", "valor_estimado", F.array_join("dezenas", ",").alias("dezenas"), F.coalesce(F.array_join("prev", ","), F.lit("")).alias("prev"), F.coalesce(F.array_join("prev2", ","), F.lit("")).alias("prev2"))


@query
def order_drawn(spark, d):
    return S.order_drawn(spark, d)


@query
def high_water(spark, d):
    return S.high_water(S.draw_items(spark, d), "g6_60")


@query
def draw_count(spark, d):
    return S.draw_items(spark, d).groupBy("game").agg(F.count_distinct("numero").alias("draws"))


@query
def json_draws(spark, d):
    own = S.ctx(spark, d).where("game = 'g6_60'")
    text = F.to_json(F.struct("numero", date_text(F.col("data"), "dmy").alias("dataApuracao"), F.transform("dezenas", lambda x: F.lpad(x.cast("string"), 2, "0")).alias("listaDezenas"), F.col("local").alias("nomeMunicipioUFSorteio"), (F.col("acumulado") == 1).alias("acumulado"), F.col("valor_arrecadado").alias("valorArrecadado")))
    return S.normalise(own.select(text.alias("value")), "g6_60").select("game", "numero", date_text(F.col("data")).alias("data"), F.array_join("dezenas", ",").alias("dezenas"), "local", F.col("acumulado").cast("int").alias("acumulado"), "valor_acumulado", "valor_arrecadado", F.size("ordem_sorteio").alias("order_known"))


@query
def insert_absent(spark, d):
    rows = S.draws(spark, d).select("game", "numero", "valor_arrecadado")
    return S.insert_absent(rows.where("numero % 3 <> 0"), rows.withColumn("valor_arrecadado", F.lit(-1.0)), ["game", "numero"])


@query
def late_correction(spark, d):
    rows = S.draws(spark, d).select("game", "numero", "valor_acumulado", "valor_arrecadado")
    old = rows.withColumn("valor_acumulado", F.when(F.col("numero") % 2 == 0, 0.0).otherwise(F.col("valor_acumulado")))
    new = rows.where("numero % 5 <> 0").withColumn("valor_arrecadado", F.when(F.col("numero") % 4 == 0, 0.0).otherwise(F.col("valor_arrecadado") + 1))
    return S.correct_late(old, new, ["game", "numero"])


@query
def schema_evolution(spark, d):
    rows = S.draws(spark, d)
    return S.evolve(rows.where("numero % 2 = 0").select("game", "numero"), rows.where("numero % 2 = 1").select("game", "numero", "valor_arrecadado"))


@query
def top_pairs(spark, d):
    return D.top_pairs(S.draw_items(spark, d))


@query
def sum_stats(spark, d):
    return D.sum_stats(S.draw_items(spark, d))


@query
def pair_lift(spark, d):
    return D.pair_tests(S.draw_items(spark, d))


@query
def attracting_pairs(spark, d):
    return D.attracting(S.draw_items(spark, d)).drop("expected")


@query
def anti_pairs(spark, d):
    return D.repelling(S.draw_items(spark, d)).drop("expected")


@query
def cooc_bonus(spark, d):
    return D.cooccurrence_bonus(S.draw_items(spark, d), BASE)


@query
def draw_features(spark, d):
    return X.shape(S.log(spark, d))


@query
def last_digit_hist(spark, d):
    return X.last_digits(S.draw_items(spark, d))


@query
def calendar_parts(spark, d):
    return X.calendar(S.ctx(spark, d))


@query
def weekday_freq(spark, d):
    return D.conditional(S.draw_items(spark, d), S.draws(spark, d), F.weekday("data"))


@query
def month_freq(spark, d):
    return D.conditional(S.draw_items(spark, d), S.draws(spark, d), F.month("data"))


@query
def uf_freq(spark, d):
    place = F.trim(F.element_at(F.split("local", ","), -1))
    return D.conditional(S.draw_items(spark, d), S.draws(spark, d), F.when(F.contains("local", F.lit(",")), place), top=10)


@query
def deviations(spark, d):
    items, attributes = S.draw_items(spark, d), S.draws(spark, d)
    return D.deviations(items, {"month": D.conditional(items, attributes, F.month("data")), "weekday": D.conditional(items, attributes, F.weekday("data"))}, least=0.02)


@query
def number_series(spark, d):
    return X.number_series(S.log(spark, d))


@query
def rolling_share(spark, d):
    return X.rolling_share(S.log(spark, d))


@query
def profile_lags(spark, d):
    return X.profile_lags(X.shape(S.log(spark, d))).select("game", "numero", "soma_lag1", "soma_lag2", "soma_lag3", "soma_ma5", "soma_ma10", "amplitude_lag1", "pares_ma5", "primos_ma10", "consecutivos_lag2", "repetidos_lag3", "repetidos_ma5")


@query
def bias50(spark, d):
    own = last_draws(S.log(spark, d).select("game", "numero", "idx", "dezenas"), "game", 50).select("game", "numero", F.explode("dezenas").alias("dezena"))
    return D.bias(own)


@query
def hot_pool(spark, d):
    own = last_draws(S.log(spark, d).select("game", "numero", "idx", "dezenas"), "game", 30).select("game", "numero", F.explode("dezenas").alias("dezena"))
    return D.hot_pool(own, POOLS)


# -- hypotheses


@query
def hyp_unary(spark, d):
    return H.test(H.unary_tallies(S.ctx(spark, d)))


@query
def hyp_binary(spark, d):
    return H.test(H.binary_tallies(S.ctx(spark, d)))


@query
def hyp_sets(spark, d):
    return H.tallies_of(S.log(spark, d), H.set_names())


@query
def hyp_window(spark, d):
    return H.tallies(H.predictions(S.log(spark, d), H.window_names()))


@query
def hyp_evolved(spark, d):
    return H.tallies(H.predictions(S.ctx(spark, d), EVOLVED))


@query
def hyp_handwritten(spark, d):
    return H.named_tallies(S.with_order(S.ctx(spark, d), spark, d), {n: p for n, (_, p) in H.by_hand().items()})


@query
def hyp_p_values(spark, d):
    return H.with_p(H.test(H.unary_tallies(S.ctx(spark, d))))


@query
def hyp_exact(spark, d):
    return H.test(H.tallies(H.predictions(S.log(spark, d), H.set_names())), exact=True).select("game", "nome", "taxa_esp", "lift", "chi2")


@query
def hyp_top(spark, d):
    from pyspark.sql.window import Window

    rows = H.test(H.unary_tallies(S.ctx(spark, d)))
    order = Window.partitionBy("game").orderBy(F.desc(F.round("chi2", 6)), "nome")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("game", "rank", "nome", "chi2")


@query
def recent_test(spark, d):
    return H.test(H.unary_tallies(H.recent(S.ctx(spark, d), 500)))


# -- pattern bank; p is the bound exp(-chi2 / 2), which every engine can compute


def _tests(spark, d):
    both = cut(H.tallies_of(S.ctx(spark, d), H.programmatic_names(), since=500))  # some rows for each name
    p = F.exp(-F.col("chi2") / 2)
    old = H.test(both).withColumn("p_valor", p)
    new = H.test(both.select("game", "nome", *(F.col(f"{c}_recente").alias(c) for c in ("tentativas", "acertos", "previstos")))).withColumn("p_valor", p)
    return old, new


def _bank(spark, d):
    overall, recent = _tests(spark, d)
    s = B.scored(overall, recent)
    return cut(s.select("game", "nome", F.lit("prog").alias("cat"), F.col("nome").alias("descr"), "p_valor", "lift", "taxa_obs", "taxa_esp", "tentativas", F.lit(True).alias("ativo"), "p_valor_recente", "lift_recente", "score_confianca"))


@query
def bank_score(spark, d):
    return _bank(spark, d).select("game", "nome", "p_valor", "p_valor_recente", "lift_recente", "score_confianca")


def _merged(spark, d):
    bank = _bank(spark, d)
    third = F.length("nome") % 3
    return B.merge(bank.where(third != 0).withColumn("score_confianca", F.col("score_confianca") / 2), bank.where(third != 1))


@query
def bank_merge(spark, d):
    return _merged(spark, d).select("game", "nome", "score_confianca", F.col("ativo").cast("int").alias("ativo"))


@query
def bank_prune(spark, d):
    return B.prune(_merged(spark, d)).select("game", "nome", F.col("ativo").cast("int").alias("ativo"))


@query
def bank_stats(spark, d):
    return B.stats(B.prune(_merged(spark, d)))


@query
def bank_active(spark, d):
    return B.active(B.prune(_merged(spark, d))).where("rank <= 5").select("game", "nome", "rank")


@query
def bank_invalidate(spark, d):
    bank = _bank(spark, d)
    return B.invalidate(bank, bank.where("lift < 1")).select("game", "nome", F.col("ativo").cast("int").alias("ativo"))


@query
def bank_untested(spark, d):
    bank = _bank(spark, d)
    return B.untested(bank.select("game", "nome"), bank.where("lift > 1"))


# -- scores of numbers


@query
def basic_weights(spark, d):
    return R.basic_weights(S.draw_items(spark, d))


@query
def frequency_gap(spark, d):
    return R.frequency_gap(S.draw_items(spark, d))


@query
def meta_weights(spark, d):
    return R.meta_weights(H.predictions(last_draws(S.log(spark, d), "game", 10), H.set_names() + H.window_names()))


@query
def cross_bonus(spark, d):
    return R.cross_bonus(S.log(spark, d))


def _set_bank(ctx):
    rows = H.test(H.tallies(H.predictions(ctx, H.set_names())))
    return rows.select("game", "nome", F.lit(True).alias("ativo"), F.exp(-F.col("chi2") / 2).alias("p_valor"), "lift", F.lit(0.0).alias("score_confianca"))


def _fused(ctx):
    """Scores of the numbers for the draw that is still to come."""
    coming = H.predictions(S.next_draw(ctx), H.set_names())
    patterns = R.pattern_scores(coming, _set_bank(ctx), R.meta_weights(H.predictions(last_draws(ctx, "game", 10), H.set_names())))
    return cut(R.fuse(patterns.select("game", "dezena", "bonus"), R.cross_bonus(ctx), R.frequency_gap(S.items_of(ctx))))


@query
def next_row(spark, d):
    rows = S.next_draw(S.ctx(spark, d))
    return rows.select("game", "numero", "idx", date_text(F.col("data")).alias("data"), "local", "acumulado", "valor_arrecadado", "valor_estimado", F.array_join("dezenas", ",").alias("dezenas"), F.array_join("prev", ",").alias("prev"), F.array_join("prev2", ",").alias("prev2"))


@query
def next_predictions(spark, d):
    rows = H.predictions(S.next_draw(S.ctx(spark, d)), H.set_names() + EVOLVED)
    return rows.select("game", "numero", "nome", F.array_join(F.array_sort("pred"), ",").alias("pred"))


@query
def score_fusion(spark, d):
    return _fused(S.log(spark, d))


@query
def score_explained(spark, d):
    ctx = S.log(spark, d)
    coming = H.predictions(S.next_draw(ctx), H.set_names())
    return R.explained(R.pattern_scores(coming, _set_bank(ctx))).select("game", "dezena", "score", F.size("parts").alias("patterns"), F.array_join(F.array_sort(F.transform("parts", lambda p: p["nome"])), ",").alias("names"))


@query
def suggested_ticket(spark, d):
    return R.picks(_fused(S.log(spark, d))).select("game", F.array_join("nums", ",").alias("nums"))


@query
def recent_profile(spark, d):
    return R.recent_profile(X.shape(S.log(spark, d)))


def _tickets(ctx):
    """Every draw as a ticket."""
    return ctx.select("game", F.col("numero").alias("ticket"), F.col("dezenas").alias("nums"), "prev")


@query
def profile_fit(spark, d):
    ctx = S.log(spark, d)
    return R.profile_fit(_tickets(ctx), R.recent_profile(X.shape(ctx))).select("game", "ticket", "fit")


@query
def ticket_scores(spark, d):
    ctx = S.log(spark, d)
    return R.ticket_scores(_tickets(ctx), S.items_of(ctx))


@query
def integrated_scores(spark, d):
    ctx = S.log(spark, d)
    items = S.items_of(ctx)
    own = last_draws(ctx.select("game", "numero", "idx", "dezenas"), "game", 50).select("game", "numero", F.explode("dezenas").alias("dezena"))
    share = D.frequency(own).join(R.total_draws(own), "game").select("game", "dezena", (F.col("freq") / F.col("t")).alias("share"))
    return R.integrated(R.frequency_gap(items), share, D.bias(own))


# -- tickets and covering


@query
def filter_ticket(spark, d):
    rows = T.evaluate(_tickets(S.log(spark, d)).where("prev is not null"), "prev")
    return rows.select("game", "ticket", "soma", "impares", "max_seq", "repetidos", F.array_join("faixas", ",").alias("faixas"), "score", F.col("passou").cast("int").alias("passou"))


@query
def valid_tickets(spark, d):
    return T.valid(_tickets(S.log(spark, d)).drop("prev")).select("game", "ticket")


@query
def unpopularity(spark, d):
    return T.ranked(T.unpopularity(_tickets(S.log(spark, d))), "impopularidade").select("game", "ticket", "impopularidade", "rank")


@query
def sequence_penalty(spark, d):
    return _tickets(S.log(spark, d)).select("game", "ticket", T.longest_run(F.col("nums")).alias("run"), T.sequence_penalty(F.col("nums")).alias("penalty"))


@query
def best_of_equal(spark, d):
    rows = _tickets(S.log(spark, d)).select("game", "ticket", F.slice("nums", 1, 3).alias("nums"), F.col("ticket").cast("double").alias("v"))
    return T.best_of_equal(rows, "v").select("game", "ticket", F.array_join("nums", ",").alias("nums"))


def _pool(ctx, game):
    own = last_draws(ctx.select("game", "numero", "idx", "dezenas"), "game", 30).select("game", "numero", F.explode("dezenas").alias("dezena"))
    return D.hot_pool(own, POOLS).where(F.col("game") == game)


@query
def combos_pool(spark, d):
    return T.combinations(_pool(S.log(spark, d), "g6_60"), 6, POOLS["g6_60"]).select("game", F.array_join("nums", ",").alias("nums"))


@query
def coverage(spark, d):
    pool = cut(_pool(S.log(spark, d), "g6_60"))
    every = T.combinations(pool, 6, POOLS["g6_60"])
    chosen = every.where(F.aggregate("nums", F.lit(0), lambda a, x: a + x) % 10 == 0)
    return T.covered(chosen, T.combinations(pool, 5, POOLS["g6_60"]), 4)


#: Tickets that were played, fixed values.
PLAYED = {"g6_60": [[7, 16, 24, 36, 47, 51], [7, 11, 31, 37, 41, 48], [7, 9, 31, 32, 38, 48]], "g15_25": [[2, 3, 4, 5, 8, 9, 10, 11, 12, 15, 16, 17, 22, 23, 24]]}


def _played(spark):
    return spark.createDataFrame([(g, i, n) for g, ts in PLAYED.items() for i, n in enumerate(ts)], "game string, ticket int, nums array<int>")


@query
def bet_check(spark, d):
    return T.check(_played(spark), S.log(spark, d)).select("game", "ticket", "numero", "hits", "prize", F.col("won").cast("int").alias("won"))


@query
def roi_summary(spark, d):
    drawn = S.log(spark, d)
    last = last_draws(drawn, "game", 20).select("game", "numero", "dezenas")
    fixed = T.check(_played(spark), last).withColumn("branch", F.lit("played"))
    prior = drawn.select("game", "numero", "dezenas", F.col("prev").alias("nums"), "idx").where("nums is not null")
    prior = last_draws(prior, "game", 20).withColumn("ticket", F.lit(0)).withColumn("hits", F.size(F.array_intersect("nums", "dezenas")))
    prior = prior.join(prizes(spark), ["game", "hits"], "left").withColumn("prize", F.coalesce("prize", F.lit(0.0))).withColumn("branch", F.lit("previous"))
    cols = ("game", "branch", "numero", "hits", "prize")
    return V.roi(fixed.select(*cols).unionByName(prior.select(*cols)))


@query
def hit_distribution(spark, d):
    return V.hit_distribution(T.check(_played(spark), S.log(spark, d)))


@query
def prefix_scores(spark, d):
    return V.prefix_scores(S.log(spark, d))


@query
def retro(spark, d):
    ctx = S.log(spark, d)
    return V.retro(V.retro_ranking(ctx), ctx)


@query
def retro_verdict(spark, d):
    ctx = S.log(spark, d)
    return V.verdict(V.retro(V.retro_ranking(ctx), ctx))


# -- diagnostics


@query
def perm_entropy(spark, d):
    return G.permutation_entropy(S.log(spark, d))


@query
def changepoint_series(spark, d):
    return G.changepoint_series(S.log(spark, d))


@query
def changepoints(spark, d):
    return G.changepoints(cut(G.changepoint_series(S.log(spark, d))), 0.9)


@query
def recurrence(spark, d):
    return U.own_measures(S.log(spark, d)).drop("sample_entropy")


@query
def sample_entropy(spark, d):
    return U.own_measures(S.log(spark, d)).select("game", "n", "sample_entropy")


@query
def line_entropy(spark, d):
    return P.line_entropy(S.log(spark, d))


@query
def divergence(spark, d):
    return P.divergence(S.log(spark, d))


@query
def surrogates(spark, d):
    return U.bounds(U.measures(S.log(spark, d), 100, 7))


@query
def entropy_z(spark, d):
    return U.z_scores(U.measures(S.log(spark, d), 30, 11))


@query
def diagnostic_report(spark, d):
    ctx = S.log(spark, d)
    copies = U.all_measures(ctx, 100, 7)
    own = U.own_of(copies)
    return G.report(own.drop("sample_entropy"), own.select("game", "n", "sample_entropy"), P.divergence(ctx), G.changepoints(cut(G.changepoint_series(ctx))), U.bounds(copies), U.z_scores(copies.where("copy <= 30")))


@query
def event_windows(spark, d):
    return loop.event_windows(spark.read.parquet(f"{d}/events.parquet")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


# -- random and learned results


@query
def weighted_tickets(spark, d):
    return T.weighted(R.basic_weights(S.draw_items(spark, d)), 20, T.per_game(lambda g: F.lit(g.k)))


@query
def optimised_tickets(spark, d):
    ctx = S.log(spark, d)
    return R.optimised(_fused(ctx), S.items_of(ctx), R.recent_profile(X.shape(ctx)))


@query
def basic_tickets(spark, d):
    return M.basic_tickets(S.draw_items(spark, d))


@query
def integrated_tickets(spark, d):
    ctx = S.log(spark, d)
    return M.integrated_tickets(R.frequency_gap(S.items_of(ctx)), S.next_draw(ctx).select("game", "prev"))


@query
def retro_tickets(spark, d):
    ctx = S.log(spark, d)
    return M.retro_tickets(ctx, V.retro_ranking(ctx))


@query
def roi_branches(spark, d):
    ctx = S.log(spark, d)
    return M.roi_branches(ctx)


@query
def one_hot(spark, d):
    return M.one_hot(S.log(spark, d), "g15_25")


@query
def walk_forward(spark, d):
    return V.walk_forward_by_hand(cut(S.with_order(S.ctx(spark, d), spark, d)))


@query
def greedy_cover(spark, d):
    ctx = S.log(spark, d)
    prev = S.next_draw(ctx).where("game = 'g6_60'").head()["prev"]
    return T.wheel(cut(_pool(ctx, "g6_60")), "g6_60", 3, 4, 30, prev)


@query
def wheel_simulation(spark, d):
    ctx = S.log(spark, d)
    pool = _pool(ctx, "g6_60")
    chosen = T.combinations(pool, 6, POOLS["g6_60"]).where(F.aggregate("nums", F.lit(0), lambda a, x: a + x) % 10 == 0)
    return T.simulate(chosen, pool, ctx)


@query
def best_bet(spark, d):
    return T.best_of_tickets(_played(spark), S.log(spark, d))


@query
def family_union(spark, d):
    """Tallies of the hand-written, set, window and evolved families in one table; of names that several have, the last family's row."""
    rows = cut(S.with_order(S.ctx(spark, d), spark, d))
    hand = {n: p for n, (_, p) in H.by_hand().items()}
    cat = F.element_at(F.create_map(*(F.lit(x) for n, (c, _) in H.by_hand().items() for x in (n, c))), F.col("nome"))
    prog, evolved = H.tallies_of(rows, H.set_names() + H.window_names()), H.tallies_of(rows, [*EVOLVED, "set.prev"])
    return H.later_wins(H.named_tallies(rows, hand).withColumn("cat", cat), prog.withColumn("cat", F.lit("prog")), evolved.withColumn("cat", F.lit("evo")), keys=("game", "nome"))


def _learned(spark, d):
    ctx = S.ctx(spark, d)
    rows = L.draw_frame(ctx, L.context(ctx))
    return reduce(DataFrame.unionByName, [L.learned(rows, g, list(L.CONTEXT)) for g in GAMES])


def _draw_rows(spark, d, of_draw, of_number):
    ctx = S.ctx(spark, d)
    return L.wide(ctx, L.context(ctx) if set(of_draw) - {"soma"} else X.shape(ctx).select("game", "numero", "soma"), of_draw, of_number)


@query
def ml_probs(spark, d):
    """Probabilities of the numbers in the coming draw, and importances of the features."""
    return _learned(spark, d)


@query
def ml_tickets(spark, d):
    probs = _learned(spark, d).where("kind = 'number'").select("game", F.col("name").cast("int").alias("dezena"), F.col("value").alias("prob"))
    return L.suggestions(probs).select("game", "rank", F.array_join("nums", ",").alias("nums"), "score")


@query
def ml_backtest(spark, d):
    """Hits of the numbers that a model refitted at each of the last draws likes best, from all numbers' series."""
    return W.hits(W.refits(_draw_rows(spark, d, list(L.CONTEXT), list(L.SERIES))))


@query
def ml_refit_sum(spark, d):
    """Scores of the last draws from regressions on the sum of the draw before alone, refitted at each."""
    return W.refits(_draw_rows(spark, d, ["soma"], []), ridge=0.0).select("game", "numero", "n", "score")


@query
def profile_forecast(spark, d):
    return L.profiles_forecast(cut(X.shape(S.log(spark, d))))


@query
def profile_tickets(spark, d):
    """Random tickets that fit the profile of the games' logs."""
    shapes = cut(X.shape(S.log(spark, d)))
    made = reduce(DataFrame.unionByName, [L.profile_tickets(spark, w, g) for g, w in L.profile_windows(shapes).items()])
    return made.select("game", F.array_join("nums", ",").alias("nums"), "penalty")


@query
def prospect_round(spark, d):
    ctx = cut(S.with_order(S.ctx(spark, d), spark, d))
    names = [*H.by_hand(), *H.programmatic_names(), *B.evolve(H.programmatic_names(), 80, 1)]
    return loop.prospect(ctx, spark.createDataFrame([], B.BANK), names)

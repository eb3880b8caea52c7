"""Operators against plain Python, and golden values."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from urnwise.functions.scalar import FIELDS
from urnwise.operators import bank as B
from urnwise.operators import diagnostics as G
from urnwise.operators import features as X
from urnwise.operators import hypotheses as H
from urnwise.operators import learning as L
from urnwise.operators import refits as W
from urnwise.operators import surrogates as U
from urnwise.operators import tickets as T
from urnwise.operators.sequence import lagged, last_draws, numbered, running, windowed
from urnwise.sources import draws as S
from urnwise.streaming import loop


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = [(g, n, rng.randrange(100)) for g in ("a", "b") for n in sorted(rng.sample(range(30_000), 300))]
    return rows, spark.createDataFrame(rows, "game string, numero long, v int")


def test_numbered_and_windows_match_plain_lists(log):
    rows, df = log
    own = numbered(df)
    out = windowed(own, "game", 7, 3, lambda w: {"back": F.sum("v").over(w.rowsBetween(-7, -1)), "ahead": F.sum("v").over(w.rowsBetween(0, 3))}, chunk=16)
    out = running(out, "game", {"total": F.col("v"), "none": F.lit(None).cast("int")}, chunk=32)
    out = running(out, "game", {"top": F.when(F.col("v") > 90, F.col("v"))}, F.max, chunk=32)
    got = {(r["game"], r["numero"]): r for r in lagged(out, "game", {"lag": ("v", 2)}).collect()}
    for g in ("a", "b"):
        v = [(n, x) for game, n, x in rows if game == g]
        xs = [x for _, x in v]
        for i, (n, _) in enumerate(v):
            r = got[g, n]
            high = [x for x in xs[: i + 1] if x > 90]
            assert (r["idx"], r["lag"], r["total"], r["none"], r["top"]) == (i, xs[i - 2] if i > 1 else None, sum(xs[: i + 1]), None, max(high) if high else None)
            assert (r["back"], r["ahead"]) == (sum(xs[max(0, i - 7) : i]) if i else None, sum(xs[i : i + 4]))
    assert last_draws(own, "game", 5).count() == 10


def test_counts_of_families():
    assert len(H.unary_names()) == 144 and len(H.binary_names()) == 600 and len(H.set_names()) == 9 and len(H.window_names()) == 4


def test_forty_by_hand(ctx):
    assert len(H.by_hand()) == 40
    rows = H.by_hand_family(ctx).where("game = 'g6_60' and idx in (0, 1, 2, 200)").collect()
    days = {r["numero"]: r for r in ctx.where("game = 'g6_60'").collect()}
    for r in rows:
        c = days[r["numero"]]
        d, m, n, prev = c["data"].day, c["data"].month, c["numero"], c["prev"] or []
        rev = lambda v: int(f"{v:02d}"[::-1])
        keep = lambda *v: sorted({x for x in v if 1 <= x <= 60})
        want = {
            "dia_invertido": keep(rev(d)),
            "dia_mes_combo": keep(d, m, rev(d), rev(m)),
            "soma_digitos_data": keep(sum(map(int, c["data"].strftime("%d%m%Y")))),
            "produto_dia_mes": keep(d * m),
            "digitos_concurso": keep(*map(int, str(n))),
            "concurso_mod": [n % 60 or 60],
            "complemento": keep(*(61 - x for x in prev)),
            "vizinhos_anterior": sorted(set(keep(*(x + s for x in prev for s in (-1, 1)))) - set(prev)),
            "mediana_anterior": keep(prev[3]) if prev else [],
            "golden_ratio": keep(*(round(60 * k / ((1 + math.sqrt(5)) / 2)) % 60 or 60 for k in range(1, 10))),
            "quadrados_perfeitos": [1, 4, 9, 16, 25, 36, 49],
            "centesimos_concurso": keep(n % 100, rev(n % 100)),
        }
        if r["nome"] in want:
            assert sorted(r["pred"]) == want[r["nome"]], (r["nome"], n)


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10**6))
def test_evolved_names_are_in_the_grammar(spark, seed):
    names = B.evolve(H.unary_names() + H.binary_names(), 20, seed)
    assert len(names) == len(set(names)) == 20
    assert all(H.parse(n, F.lit(60)) is not None for n in names)
    assert B.evolve(H.unary_names() + H.binary_names(), 20, seed) == names


def test_names_outside_the_grammar(spark):
    for n in ("", "dia", "dia.", "nix.id", "dia.id>x", "set.nix", "set.prev@nix.add", "set.prev@dia.mul", "window.dia_alto→nix", "setop.prev_nix_prev2", "nest.(diaaddmes)", "dia+mes.nix", "dia." + ">".join(["id"] * 7)):
        assert H.parse(n, F.lit(60)) is None
    assert B.crossover("dia+mes.add", "conc+lua.xor") == "dia+mes.xor" and len(FIELDS) == 16


def test_p_value(spark):
    r = H.with_p(spark.createDataFrame([(0.0,), (3.841458820694124,)], "chi2 double")).collect()
    assert r[0]["p_valor"] == 1.0 and abs(r[1]["p_valor"] - 0.05) < 1e-12


def test_quantiles():
    assert abs(G.chi2_quantile(0.95, 1) - 3.841458820694124) < 1e-9
    assert abs(G.chi2_quantile(0.99, 59) - 87.16571) < 1e-4
    assert abs(G.chi2_tail(10, 4) - math.exp(-5) * 6) < 1e-12


def test_golden_tickets(spark):
    rows = [("g6_60", 1, [7, 16, 24, 36, 47, 51]), ("g6_60", 2, [7, 11, 31, 37, 41, 48]), ("g6_60", 3, [7, 9, 31, 32, 38, 48])]
    got = {r["ticket"]: r for r in T.evaluate(spark.createDataFrame(rows, "game string, ticket int, nums array<int>")).collect()}
    assert [(got[i]["soma"], 6 - got[i]["impares"]) for i in (1, 2, 3)] == [(181, 3), (175, 1), (165, 3)]
    assert [got[i]["max_seq"] for i in (1, 2, 3)] == [1, 1, 2]


def test_combinations(spark):
    pool = spark.createDataFrame([("g6_60", n) for n in (3, 8, 13, 21, 34, 55, 60, 2)], "game string, dezena int")
    got = sorted(tuple(r["nums"]) for r in T.combinations(pool, 5, 8).collect())
    assert got == sorted(itertools.combinations(sorted((3, 8, 13, 21, 34, 55, 60, 2)), 5))


def test_run_distribution_of_15_of_25(spark):
    """Longest runs over all combinations, read off windows of the number line."""
    want = {15: 11, 14: 110}
    # a run of 15 has 11 places; a run of exactly 14 leaves one number apart from it
    pool = [list(range(a, a + 15)) for a in range(1, 12)]
    fourteen = [sorted([*range(a, a + 14), x]) for a in range(1, 13) for x in range(1, 26) if x < a - 1 or x > a + 14]
    df = spark.createDataFrame([("g15_25", i, n) for i, n in enumerate(pool + fourteen)], "game string, ticket int, nums array<int>")
    got = {r["run"]: r["count"] for r in df.select(T.longest_run(F.col("nums")).alias("run")).groupBy("run").count().collect()}
    assert got == want


def test_covers(spark):
    pool = list(range(1, 9))
    c = [list(x) for x in itertools.combinations(pool, 4)]
    t = [list(x) for x in itertools.combinations(pool, 3)]
    exact = T.exact_cover(c, t, 2, 12, 20_000)
    covers = lambda chosen, need: all(any(len(set(a) & set(b)) >= need for a in chosen) for b in t)
    assert exact and covers(exact, 2)
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "nums array<int>")
    chosen, left = T.greedy_cover(frame(c), frame(t), 3, 40)
    chosen = [r["nums"] for r in chosen.orderBy("step").collect()]
    assert left == 0 and covers(chosen, 3) and chosen == plain_greedy(c, t, 3)
    assert T.greedy_cover(frame(c), frame(t), 3, 2)[1] > 0 and T.exact_cover(c, [[20, 21, 22]], 2, 5) is None
    assert T.exact_cover(c, t, 2, 12, 3) is None  # not proven the smallest
    numbers = spark.createDataFrame([("g6_60", n) for n in (3, 14, 25, 36, 47, 58, 9)], "game string, dezena int")
    rows = T.wheel(numbers, "g6_60", 3, 4, 10).collect()
    assert rows[0]["method"] == "exact" and rows[0]["covered"] == rows[0]["targets"] == 35 and rows[0]["cost"] == 5.0 * len(rows)


def plain_greedy(candidates, targets, need, overlap=0.4):
    chosen, left = [], [set(t) for t in targets]
    while left:
        def score(c):
            gain = sum(len(set(c) & t) >= need for t in left)
            near = 1 - abs(sum(len(set(c) & set(x)) / len(c) for x in chosen) / len(chosen) - overlap) if chosen else 1
            return round(gain * 0.7 + near * gain * 0.3, 9)

        best = max((c for c in candidates if c not in chosen), key=lambda c: (score(c), [-x for x in c]))
        chosen.append(best)
        left = [t for t in left if len(set(best) & t) < need]
    return chosen


def test_later_family_wins_and_sinks(spark, tmp_path):
    a, b = (spark.createDataFrame(x, "nome string, cat string") for x in ([("p", "a"), ("q", "a")], [("q", "b")]))
    assert sorted(map(tuple, H.later_wins(a, b).collect())) == [("p", "a"), ("q", "b")]
    at = str(tmp_path / "probs")
    rows = spark.createDataFrame([("g6_60", 1, 0.5), ("g15_25", 1, 0.2)], "game string, dezena int, prob double")
    S.write_probabilities(rows, at)
    S.write_probabilities(rows.where("game = 'g6_60'").withColumn("prob", F.lit(0.1)), at)
    assert {r["game"]: r["prob"] for r in spark.read.parquet(at).collect()} == {"g6_60": 0.1, "g15_25": 0.2}


def test_weighted_tickets_are_valid_and_seeded(spark):
    w = spark.createDataFrame([("g6_60", n, float(n)) for n in range(1, 61)], "game string, dezena int, weight double")
    a, b = (sorted((r["ticket"], tuple(r["nums"])) for r in T.weighted(w, 50, F.lit(6), 9).collect()) for _ in range(2))
    assert a == b and all(len(set(n)) == 6 for _, n in a)
    assert np.mean([x for _, n in a for x in n]) > 35


def test_unpopular_arithmetic_progression(spark):
    df = spark.createDataFrame([("g6_60", [2, 4, 6, 8, 10, 12]), ("g6_60", [33, 38, 46, 52, 57, 59])], "game string, nums array<int>")
    a, b = (r["impopularidade"] for r in T.unpopularity(df).collect())
    assert a < 0.1 < b


def brute_recurrence(x, dim=3):
    """RR, DET, LAM and entropy of diagonal lines from the whole matrix."""
    e = np.lib.stride_tricks.sliding_window_view(x, dim)
    r = (np.abs(e[:, None, :] - e[None, :, :]).max(axis=2) == 0).astype(int)
    np.fill_diagonal(r, 0)
    n, total = len(r), r.sum()
    lines = lambda v: [len(g) for k, group in itertools.groupby(v.tolist()) if k for g in [list(group)] if len(g) > 1]
    diagonal = [k for i in range(1, n) for k in lines(np.diag(r, i))]
    vertical = [k for i in range(n) for k in lines(r[:, i])]
    _, c = np.unique(diagonal, return_counts=True)
    p = c / c.sum()
    return total / (n * (n - 1)), 2 * sum(diagonal) / total, sum(vertical) / total, -(p * np.log2(p)).sum(), len(diagonal), max(diagonal)


def brute_divergence(x, apart=5, steps=50):
    e = np.lib.stride_tricks.sliding_window_view(x, 3).astype(float)
    n = len(e)
    steps, gaps = min(n // 4, steps), {}
    for i in range(n - steps):
        d = ((e - e[i]) ** 2).sum(axis=1)
        same = np.flatnonzero(d == 0)
        if np.abs(same - i).max() > apart:
            continue
        best = None
        for v in np.unique(e[d > 0], axis=0):
            at = np.flatnonzero((e == v).all(axis=1))
            j = at[0] if abs(at[0] - i) > apart else at[-1] if abs(at[-1] - i) > apart else None
            if j is not None and (best is None or (d[j], j) < best):
                best = (d[j], j)
        for k in range(min(steps, n - max(i, best[1]))) if best else ():
            own = np.sqrt(((e[i + k] - e[best[1] + k]) ** 2).sum())
            if own > 0:
                gaps.setdefault(k, []).append(np.log(own))
    t = sorted(gaps)[:20]
    return float(np.polyfit(t, [np.mean(gaps[k]) for k in t], 1)[0]) if len(t) >= 5 else 0.0


def test_diagnostics_equal_brute_force(spark, monkeypatch):
    from urnwise.operators import sequence

    rng = np.random.default_rng(1)
    walk = np.clip(np.cumsum(rng.integers(-1, 2, 300)), -4, 4)
    walk[100:140] = 1  # a long island
    flat = rng.integers(0, 5, 300)
    own = {1: walk, 2: flat}
    df = spark.createDataFrame([("g6_60", n, i, int(v)) for n, x in own.items() for i, v in enumerate(x)], "game string, n int, idx long, c long").cache()
    rows = {r["n"]: r for r in G.recurrence(df).collect()}
    lines = {r["n"]: r for r in G.line_entropy(df).collect()}
    sample = {r["n"]: r["sample_entropy"] for r in G.sample_entropy(df).collect()}
    slope = {r["n"]: r["lyapunov"] for r in G.divergence(df).collect()}
    for n, x in own.items():
        rr, det, lam, entr, count, longest = brute_recurrence(x)
        assert np.allclose([rows[n]["RR"], rows[n]["DET"], rows[n]["LAM"]], [rr, det, lam])
        assert (lines[n]["lines"], lines[n]["longest"]) == (count, longest) and abs(lines[n]["ENTR"] - entr) < 1e-9
        pairs = lambda m, x=x: sum((x[i : i + m] == x[j : j + m]).all() for i in range(len(x) - m) for j in range(i))
        assert abs(sample[n] + math.log(pairs(3) / pairs(2))) < 1e-9
        assert abs(slope[n] - brute_divergence(x)) < 1e-9
        order = np.argsort(np.lib.stride_tricks.sliding_window_view(x, 3), axis=1, kind="stable") @ np.array([9, 3, 1])
        p = np.unique(order, return_counts=True)[1] / len(order)
        assert abs(rows[n]["entropy"] + (p * np.log2(p)).sum() / math.log2(6)) < 1e-9
    wide = df.withColumn("c", F.col("c") * 100)
    assert all(r["RR"] is None for r in G.recurrence(wide).collect()) and not G.line_entropy(wide).count()


def series_frame(spark, own, game="g6_60"):
    """Series of one game as draws (game, idx, codes)."""
    table = np.stack(list(own), axis=1)
    return spark.createDataFrame([(game, i, [int(v) for v in row]) for i, row in enumerate(table)], "game string, idx long, codes array<tinyint>")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 30, 397])
def test_permutations_are_bijections(spark, n):
    a, b = U.halves(n)
    assert a * b >= n
    rows = spark.range(n).select(F.lit("g6_60").alias("game"), F.col("id").alias("idx"))
    got = U.permuted(rows, 5, 3).collect()
    orders = {}
    for r in got:
        orders.setdefault(r["copy"], {})[r["p"]] = r["idx"]
    assert len(got) == 6 * n and all(sorted(o) == list(range(n)) and sorted(o.values()) == list(range(n)) for o in orders.values())
    assert orders[0] == {i: i for i in range(n)}
    if n > 100:  # neighbours are torn apart, and copies differ
        assert len({tuple(o[i] for i in range(n)) for o in orders.values()}) == 6
        assert all(sum(abs(o[i + 1] - o[i]) < 3 for i in range(n - 1)) < n / 8 for c, o in orders.items() if c)


def test_surrogates_of_order_and_of_chance(spark):
    rng = np.random.default_rng(2)
    walk = np.clip(np.cumsum(rng.integers(-1, 2, 400)), -5, 5) + 5
    walk[60:90] = 4
    own = (walk, rng.integers(0, 6, 400), np.full(400, 3))
    rows = U.permuted(series_frame(spark, own), 20, 5).cache()
    orders = {}
    for r in rows.collect():
        orders.setdefault(r["copy"], {})[r["p"]] = r["codes"]
    got = {(r["n"], r["copy"]): r for r in U.stretch_counts(rows).collect()}
    assert len(got) == 63
    for n in (1, 2, 3):
        for copy in (0, 1, 7):
            x = np.array([orders[copy][i][n - 1] for i in range(400)])
            assert copy or (x == own[n - 1]).all()
            rr, det, lam, *_ = brute_recurrence(x)
            r = got[n, copy]
            assert np.allclose([2 * r["n3"] / (398 * 397), (2 * r["n4"] - r["n5"]) / r["n3"], r["vertical"] / (2 * r["n3"])], [rr, det, lam])
            pattern = np.lib.stride_tricks.sliding_window_view(x, 3)
            order = (pattern[:, 0] <= pattern[:, 1]) + 2 * (pattern[:, 1] <= pattern[:, 2]) + 4 * (pattern[:, 0] <= pattern[:, 2])
            assert [r[f"o{i}"] for i in range(8)] == np.bincount(order, minlength=8).tolist()
    same = sorted(map(tuple, U.stretch_counts(rows).collect()))
    for chunk in (5, 64, 399):
        assert sorted(map(tuple, U.stretch_counts(rows, chunk).collect())) == same


def test_measures_of_a_log(spark, ctx):
    """The order as it is gives what `recurrence` gives; a walk stands out from its copies, chance does not."""
    rows = U.measures(ctx, 20, 7).cache()
    real = {(r["game"], r["n"]): r for r in rows.where("copy = 0").collect()}
    for r in G.recurrence(G.codes(ctx)).collect():
        own = real[r["game"], r["n"]]
        assert all(a is None and b is None or abs(a - b) < 1e-9 for a, b in ((own["PE"], r["entropy"]), (own["DET"], r["DET"]), (own["LAM"], r["LAM"]), (own["RR"], r["RR"])))
    tests = U.bounds(rows).collect()
    assert sum(r["outside"] for r in tests if r["measure"] == "PE") > len(real) / 2  # overlapping windows make order
    z = U.z_scores(rows).collect()
    assert len(z) == len(real) and all((r["pe_std"] > 0) and abs(r["z"] - (r["pe"] - r["pe_mean"]) / r["pe_std"]) < 1e-9 for r in z)


def test_report_holds_any_of_five(spark):
    keys = "game string, n int, "
    of = lambda rows, cols: spark.createDataFrame(rows, keys + cols)
    n = range(1, 8)
    recurrences = of([("g6_60", i, 100, 0.1, 0.2 if i == 3 else 0.05, 0.0) if i != 7 else ("g6_60", 7, 100, None, None, None) for i in n] + [("g15_25", 1, 9, 0.1, 0.01, 0.0)], "points long, RR double, DET double, LAM double")
    both = [("g6_60", i) for i in n] + [("g15_25", 1)]
    samples = of([(*k, 1.0) for k in both], "sample_entropy double")
    slopes = of([(*k, 0.02 if k[1] == 4 else 0.01) for k in both], "lyapunov double")
    tests = of([(*k, m, m == "LAM" and k[1] == 2) for k in both for m in ("PE", "LAM")] + [("g6_60", 7, "DET", None)], "measure string, outside boolean")
    scores = of([(*k, 0.9, 2.0, k[1] == 5) for k in both], "pe double, z double, significant boolean")
    none = spark.createDataFrame([], "game string, position long, chi2 double")
    one = spark.createDataFrame([("g15_25", 70, 99.0), ("g15_25", 90, 99.0)], none.schema)
    got = {(r["game"], r["n"]): (r["signals"], r["verdict"]) for r in G.report(recurrences, samples, slopes, none, tests, scores).collect()}
    assert got == {("g15_25", 1): ("", "compatible with chance")} | {("g6_60", i): ({2: "surrogate", 3: "determinism", 4: "chaos", 5: "entropy"}.get(i, ""), "structure" if i in (2, 3, 4, 5) else "compatible with chance") for i in n}
    got = {(r["game"], r["n"]): (r["signals"], r["changepoints"]) for r in G.report(recurrences, samples, slopes, one, tests, scores).collect()}
    assert got["g15_25", 1] == ("changepoints", 2) and got["g6_60", 1] == ("", 0)


def marked(spark, rows):
    """A log of draws (game, idx, dezenas) with their words."""
    from urnwise.functions.scalar import mask

    return spark.createDataFrame(rows, "game string, idx long, dezenas array<int>").withColumn("numero", F.col("idx")).withColumn("mask", mask(F.col("dezenas")))


def test_changepoint_found(spark):
    log = marked(spark, [("g6_60", i, list(range(1, 31) if i < 150 else range(31, 61))) for i in range(300)])
    got = G.changepoints(G.changepoint_series(log)).collect()
    assert len(got) == 1 and got[0]["position"] == 150
    flat = marked(spark, [("g6_60", i, list(range(1, 61))) for i in range(300)])
    assert not G.changepoints(G.changepoint_series(flat)).count()


def test_bit_counters(spark):
    from urnwise.functions.scalar import age_bits, count_of, seen_bit, tally_bits

    rng = np.random.default_rng(4)
    rows = [(i, [int(x) for x in rng.integers(0, 2**62, k)]) for i, k in enumerate((0, 1, 2, 17, 50, 63))]
    df = spark.createDataFrame(rows, "i int, w array<long>").select("*", F.explode(F.sequence(F.lit(0), F.lit(61))).alias("n"), tally_bits(F.col("w")).alias("t"), age_bits(F.col("w")).alias("a"))
    for r in df.select("w", "n", count_of(F.col("t"), F.col("n")).alias("c"), count_of(F.col("a"), F.col("n")).alias("age"), seen_bit(F.col("a"), F.col("n")).alias("seen")).collect():
        bits = [w >> r["n"] & 1 for w in r["w"]]
        assert r["c"] == sum(bits) and r["seen"] == (1 in bits)
        assert not r["seen"] or r["age"] == bits[::-1].index(1)


def test_number_series_over_long_gaps(spark):
    """Numbers that stay away for longer than the counters' reach."""
    rng = np.random.default_rng(6)
    draws = [[int(x) for x in rng.choice(np.arange(1, 26), 3, replace=False)] if i % 130 < 10 else [25] for i in range(400)]
    got = {(r["idx"], r["n"]): r for r in X.number_series(marked(spark, [("g15_25", i, sorted(d)) for i, d in enumerate(draws)])).collect()}
    last = dict.fromkeys(range(1, 26), 0)
    for i, d in enumerate(draws):
        for n in range(1, 26):
            last[n] = i if n in d else last[n]
            r = got[i, n]
            assert r["gap"] == i - last[n] and r["lag10"] == int(i >= 10 and n in draws[i - 10])
            assert abs(r["freq50"] - (np.mean([n in x for x in draws[max(0, i - 50) : i]]) if i else 0)) < 1e-12


def test_next_draw(spark, ctx):
    coming = {r["game"]: r for r in S.next_draw(ctx).collect()}
    for g, r in coming.items():
        last = ctx.where(F.col("game") == g).orderBy(F.desc("idx")).limit(2).collect()
        assert r["numero"] == last[0]["numero"] + 1 and r["idx"] == last[0]["idx"] + 1 and r["dezenas"] == []
        assert r["prev"] == last[0]["dezenas"] and r["prev2"] == last[1]["dezenas"] and (r["data"] - last[0]["data"]).days == 3


def test_tallies_of_any_names(spark, ctx):
    names = [*H.unary_names()[:5], *H.binary_names()[::100], "set.prev", "window.soma_alta→altos", "fibonacci", "dia.inv>dsum", "nonsense"]
    own = ctx.where("idx < 120")
    plain = H.predictions(own, [n for n in names if n not in H.by_hand()]).unionByName(H.by_hand_family(own).where("nome = 'fibonacci'").drop("cat"))
    key = lambda df: sorted(tuple(r[c] for c in ("game", "nome", "tentativas", "acertos", "previstos", "tentativas_recente", "acertos_recente", "previstos_recente")) for r in df.collect())
    assert key(H.tallies_of(own, names, 30)) == key(H.tallies(plain, 30))


def test_models_speak_of_the_coming_draw(spark, ctx):
    own = ctx.where("game = 'g15_25' and idx < 120")
    rows = L.frame(own, L.context(own)).cache()
    top = own.agg(F.max("idx")).head()[0]
    assert rows.where("label is null").select("idx").distinct().collect() == [(top + 1,)] and rows.where("idx = 5").count() == 25
    hit = {(r["idx"], r["n"]): r["hit"] for r in X.hits(own).collect()}
    assert all(r["label"] == hit[r["idx"], r["n"]] for r in rows.where("label is not null").collect())
    probs, weights = L.discover(rows, "g15_25", trees=3, rounds=2)
    assert probs.count() == 25 and probs.where("prob < 0 or prob > 1").count() == 0 and weights.count() == 30
    tickets = L.suggestions(probs.cache(), 4).collect()
    assert len({tuple(r["nums"]) for r in tickets}) == 4 and all(len(set(r["nums"])) == 15 for r in tickets)
    scores = W.refits(W.draw_rows(rows, list(L.CONTEXT), list(L.SERIES)), last=3)
    made = W.hits(scores).collect()
    assert len(made) == 3 and all(0 <= r["hits"] <= r["hits_wide"] <= 15 for r in made) and scores.count() == 75
    told = L.forecast(X.shape(own), "g15_25", ("soma", "pares"), trees=3, rounds=2).collect()
    assert {r["property"] for r in told} == {"soma", "pares"} and all(r["low"] < r["forecast"] < r["high"] and r["mae"] > 0 for r in told)


def test_bank_round(spark):
    schema = B.BANK
    row = lambda n, p, s, on=True: ("g", n, "c", n, p, 1.2, 0.5, 0.4, 50, on, 0.5, 1.1, s)
    old = spark.createDataFrame([row("a", 0.01, 0.5), row("b", 0.04, 0.5), row("c", 0.01, 0.02)], schema)
    new = spark.createDataFrame([row("a", 0.02, 0.05), row("d", 0.01, 0.05)], schema)
    got = {r["nome"]: (r["p_valor"], r["ativo"]) for r in B.merge(old, new).collect()}
    assert got == {"a": (0.02, False), "b": (0.04, True), "c": (0.01, True), "d": (0.01, True)}
    assert {r["nome"] for r in B.prune(old).where("ativo").collect()} == {"a"}
    assert {r["nome"] for r in B.active(B.invalidate(old, new)).collect()} == {"b", "c"}
    assert B.threshold(10) == 0.05 and B.threshold(1000) == 0.005


def test_prospect_round(spark, ctx):
    bank = loop.prospect(ctx, spark.createDataFrame([], B.BANK), H.unary_names()[:9])
    again = loop.prospect(ctx, spark.createDataFrame(bank.collect(), B.BANK), H.unary_names()[:9], seed=1)
    assert {r["nome"] for r in bank.collect()} == {r["nome"] for r in again.collect()}


def test_ingest_stream(spark, tmp_path):
    landing, store, mark = (str(tmp_path / x) for x in ("landing", "store", "mark"))
    (tmp_path / "landing").mkdir()
    draw = lambda n, **more: json.dumps({"numero": n, "dataApuracao": "05/03/2024", "listaDezenas": ["01", "09", "60", "33", "20", "07"], **more})

    def go(name, *lines):
        (tmp_path / "landing" / name).write_text("\n".join(lines))
        q = loop.ingest(spark, landing, store, mark, "g6_60")
        q.awaitTermination(120)
        assert q.exception() is None
        return {r["numero"]: r for r in loop.stored(spark, store).collect()}

    first = go("a.json", draw(1), draw(2, valorAcumuladoProximoConcurso=5.0), "not json", "{}")
    assert set(first) == {1, 2} and first[1]["dezenas"] == [1, 7, 9, 20, 33, 60] and str(first[1]["data"]) == "2024-03-05"
    second = go("b.json", draw(1, valorArrecadado=9.0, valorAcumuladoProximoConcurso=4.0), draw(2, valorArrecadado=9.0), draw(3))
    assert set(second) == {1, 2, 3}
    assert (second[1]["valor_acumulado"], second[1]["valor_arrecadado"]) == (4.0, 9.0)
    assert (second[2]["valor_acumulado"], second[2]["valor_arrecadado"]) == (5.0, 0.0)


def test_event_stream_matches_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = loop.event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((r["start"], r["event_type"], r["n"], round(r["total"], 6)) for r in rows)
    assert key(spark.table("windows").collect()) == key(loop.event_windows(events).collect())


def test_sources(spark, tmp_path):
    old = spark.createDataFrame([("g", 1, 0.0), ("g", 2, 7.0)], "game string, numero int, valor_acumulado double").withColumn("valor_arrecadado", F.lit(0.0))
    new = spark.createDataFrame([("g", 1, 3.0, 5.0), ("g", 1, 3.0, 5.0), ("g", 3, 1.0, 0.0)], "game string, numero int, valor_acumulado double, valor_arrecadado double")
    assert S.insert_absent(old, new, ["game", "numero"]).count() == 3
    assert S.insert_absent(old.limit(0), new, ["game", "numero"]).count() == 2
    got = {r["numero"]: r["valor_acumulado"] for r in S.correct_late(old, new, ["game", "numero"]).collect()}
    assert got == {1: 3.0, 2: 7.0}
    assert S.high_water(old, "nix").head()[0] == 0
    S.write_draws(old, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("game = 'g'").count() == 2
    S.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "place int, line string"), str(tmp_path / "report"))
    assert "".join(p.read_text() for p in (tmp_path / "report").glob("part*")) == "a\nb\n"


def test_http_source(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from urnwise.sources import http

    class Draws(BaseHTTPRequestHandler):
        def do_GET(self):
            last = self.path.rsplit("/", 1)[-1]
            n = int(last) if last.isdigit() else 7
            self.send_response(404 if n == 3 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"numero": n, "dataApuracao": "05/03/2024", "listaDezenas": ["02", "01"]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Draws)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    http.register(spark)
    assert http.latest(base, "six") == 7
    rows = spark.read.format("draws_http").option("base", base).option("game_path", "six").option("first", 1).option("last", 7).option("draws_per_task", 2).load()
    got = rows.collect()
    assert [r["numero"] for r in got if r["error"]] == [3] and len(got) == 7
    assert S.normalise(rows.where("error is null"), "g6_60").count() == 6
    stored = spark.createDataFrame([("g6_60", 1), ("g6_60", 5)], "game string, numero int")
    assert sorted(r["numero"] for r in http.missing(stored, "g6_60", 7).collect()) == [2, 3, 4, 6, 7]
    from urnwise.__main__ import collect

    at = str(tmp_path / "store")
    collect(spark, base, "six", "g6_60", "1", "4", at)
    collect(spark, base, "six", "g6_60", "1", "6", at)
    assert sorted(r["numero"] for r in loop.stored(spark, at).collect()) == [1, 2, 4, 5, 6]
    server.shutdown()


def test_families_agree_with_the_parser(spark, ctx):
    some = H.unary_names()[::40] + H.binary_names()[::150] + ["set.prev"]
    own = ctx.where("idx < 40")
    key = lambda df: sorted((r["game"], r["numero"], r["nome"], tuple(r["pred"])) for r in df.collect())
    assert key(H.predictions(own, some)) == key(H.predictions(own, some, wide=0))
    assert H.predictions(own, []).count() == 0


def test_commands_name_queries():
    from urnwise.__main__ import COMMANDS, main
    from urnwise.plans.queries import QUERIES

    assert all(n in QUERIES for names in COMMANDS.values() for n in names)
    assert main([]) == 0 and main(["nothing"]) == 1 and main(["coletar"]) == 1


@pytest.mark.parametrize("chunk", [3, 40, 1 << 16])
def test_repeats_equal_brute_force(spark, monkeypatch, chunk):
    from urnwise.operators import suffixes

    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    own = {1: np.clip(np.cumsum(rng.integers(-1, 2, 130)), -3, 3) + 3, 2: rng.integers(0, 3, 120), 3: np.zeros(60, int), 4: np.tile([1, 2, 0, 5], 16), 5: np.array([3]), 6: np.arange(100)}
    df = spark.createDataFrame([("g6_60", n, i, int(v)) for n, x in own.items() for i, v in enumerate(x)], "game string, n int, idx long, c long")
    if chunk == 40:  # values below 0 and far apart
        df = df.withColumn("c", F.col("c") * 1000 - 7)
    got = {}
    for r in suffixes.repeats(df).collect():
        got.setdefault(r["n"], {})[r["length"]] = r["pairs"]
    for n, x in own.items():
        want = {}
        for i in range(len(x)):
            for j in range(i):
                k = 0
                while i + k < len(x) and x[i + k] == x[j + k]:
                    k += 1
                    want[k] = want.get(k, 0) + 1
        assert got.get(n, {}) == want, n


def test_refits_equal_fits_on_earlier_rows(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(40, 6)) * [1, 5, 0, 1, 1, 100] + 3, (rng.random((40, 4)) < 0.4).astype(float)
    x[:, 4] = x[:, 3]  # twice the same
    df = spark.createDataFrame([("g6_60", i, 100 + i, x[i].tolist(), y[i].tolist() if i < 39 else None) for i in range(40)], "game string, idx long, numero long, x array<double>, y array<double>").repartition(5)
    for ridge in (10.0, 0.0):
        got = {(r["numero"], r["n"]): (r["label"], r["score"]) for r in W.refits(df, 8, ridge).collect()}
        assert len(got) == 32
        for t in range(31, 39):
            mean, spread = x[:t].mean(axis=0), x[:t].std(axis=0)
            some = spread > 1e-6
            z = (x[:t, some] - mean[some]) / spread[some]
            beta = np.linalg.lstsq(np.vstack([z, np.sqrt(ridge) * np.eye(some.sum())]), np.vstack([y[:t] - y[:t].mean(axis=0), np.zeros((some.sum(), 4))]), rcond=None)[0]
            score = np.clip(y[:t].mean(axis=0) + (x[t, some] - mean[some]) / spread[some] @ beta, 0, 1)
            for n in range(4):
                assert got[100 + t, n + 1][0] == y[t, n] and abs(got[100 + t, n + 1][1] - score[n]) < 1e-6


def test_http_stream_with_offsets(spark, tmp_path):
    """A load that fails between commits loses and repeats nothing, goes on from its offset, and takes late money."""
    import threading
    import time
    from collections import Counter
    from http.server import BaseHTTPRequestHandler, HTTPServer

    state = {"last": 23, "broken": 13, "money": 0.0}
    asked = Counter()

    class Draws(BaseHTTPRequestHandler):
        def do_GET(self):
            last = self.path.rsplit("/", 1)[-1]
            n = int(last) if last.isdigit() else state["last"]
            if last.isdigit():
                asked[n] += 1
            self.send_response(500 if last.isdigit() and n == state["broken"] else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"numero": n, "dataApuracao": "05/03/2024", "listaDezenas": ["02", "01"], "valorArrecadado": state["money"]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Draws)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, store, mark = f"http://127.0.0.1:{server.server_port}", str(tmp_path / "store"), str(tmp_path / "mark")

    def go(done, per_batch=5):
        q = loop.ingest_http(spark, base, "six", store, mark, "g6_60", per_batch=per_batch, per_task=2, processingTime="200 milliseconds")
        end = time.time() + 120
        while time.time() < end and q.isActive and not done():
            time.sleep(0.5)
        failed = q.exception()
        q.stop()
        rows = loop.stored(spark, store)
        return failed, sorted(r["numero"] for r in rows.collect()) if rows is not None else []

    have = lambda n: lambda: (rows := loop.stored(spark, store)) is not None and rows.count() >= n
    failed, got = go(have(23))
    assert failed is not None and got == list(range(1, 11))  # two batches are committed, the third is not
    state["broken"] = None
    asked.clear()
    failed, got = go(have(23))
    assert failed is None and got == list(range(1, 24)) and spark.read.parquet(store).count() == 23
    assert set(asked) == set(range(11, 24)) and set(asked.values()) == {1}
    loop.compact(spark, store)
    loop.compact(spark, store)
    assert spark.read.parquet(store).select("batch").distinct().count() == 1
    state["last"] = 25
    asked.clear()
    loop.load_http(spark, base, "six", store, mark, "g6_60")
    assert sorted(r["numero"] for r in loop.stored(spark, store).collect()) == list(range(1, 26)) and set(asked) == {24, 25}
    server.shutdown()


def test_merge_keeps_state_by_draw(spark, tmp_path):
    landing, store, mark = (str(tmp_path / x) for x in ("landing", "store", "mark"))
    (tmp_path / "landing").mkdir()
    draw = lambda n, **more: json.dumps({"numero": n, "dataApuracao": "05/03/2024", "listaDezenas": ["01", "09"], **more})

    def go(name, *lines):
        (tmp_path / "landing" / name).write_text("\n".join(lines))
        q = loop.ingest(spark, landing, store, mark, "g6_60")
        q.awaitTermination(120)
        assert q.exception() is None
        return {r["numero"]: r["valor_arrecadado"] for r in loop.stored(spark, store).collect()}

    assert go("a.json", *(draw(n) for n in range(1, 9))) == dict.fromkeys(range(1, 9), 0.0)
    got = go("b.json", draw(2), draw(3, valorArrecadado=5.0), draw(3, valorArrecadado=5.0), draw(9))
    assert got == dict.fromkeys(range(1, 10), 0.0) | {3: 5.0}
    written = spark.read.parquet(store)
    assert written.groupBy("batch").count().orderBy("batch").collect()[-1]["count"] == 2  # the new one and the corrected one
    got = go("c.json", draw(3, valorArrecadado=6.0, valorAcumuladoProximoConcurso=1.0), draw(3, valorArrecadado=9.0))
    loop.compact(spark, store)
    assert got[3] in (6.0, 9.0) and loop.stored(spark, store).count() == 9


def test_tallies_by_increments(spark, ctx):
    """Three rounds on a growing log give the sums of one count, and read neither old draws nor more names than asked for."""
    from urnwise.operators import increments

    own = ctx.where("idx < 160").cache()
    names = [*H.unary_names()[:6], *H.set_names()[:3], "dia_invertido", H.binary_names()[0]]
    state = None
    for top, asked in ((70, names[:8]), (95, names), (95, []), (159, names[:1])):
        have = own.where(f"idx <= {top}")
        if state is not None:  # old draws outside the window may be anything
            last = state.agg(F.max("top")).head()[0]
            have = have.withColumn("dezenas", F.when(F.col("idx") <= last - 20, F.array(F.lit(1))).otherwise(F.col("dezenas"))) if top > last else have
            have = have.withColumn("mask", F.when(F.col("idx") <= last - 20, F.lit(1)).otherwise(F.col("mask")).cast("long")) if top > last else have
        state = spark.createDataFrame(increments.advance(state, have, asked, 20).collect(), increments.STATE).cache()
        # a name that comes later is counted from the start, on a log that is still whole
        if top == 95 and asked:
            late = [n for n in names if n not in names[:8]]
            whole = increments.advance(None, own.where("idx <= 95"), late, 20)
            state = spark.createDataFrame([*state.where(~F.col("nome").isin(late)).collect(), *whole.collect()], increments.STATE).cache()
    want = {(r["game"], r["nome"]): [r[c] for c in increments.SUMS] + [r[f"{c}_recente"] for c in increments.SUMS] for r in H.tallies_of(own, names, 20).collect()}
    got = {(r["game"], r["nome"]): [r[c] for c in increments.SUMS] + [r[f"{c}_recente"] for c in increments.SUMS] for r in state.collect()}
    assert got == want and max(r["top"] for r in state.collect()) == 159


def test_transactional_store(spark, tmp_path):
    """Versions appear whole or not at all; a failing task leaves the last one, a repeated run changes nothing."""
    from urnwise.sources import store

    at = str(tmp_path / "store")
    rows = spark.range(100).repartition(4).select(F.col("id").alias("numero"), F.lit("g6_60").alias("game"), F.array(F.lit(1), F.lit(2)).alias("dezenas"))
    assert store.read(spark, at) is None
    store.write(rows, at, "first")
    assert store.read(spark, at).count() == 100
    store.write(rows, at, "first")
    assert store.read(spark, at).count() == 100 and len(store.manifests(at)) == 1
    broken = rows.withColumn("numero", F.when(F.col("numero") == 57, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("numero")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception):
            store.write(broken, at, "second", mode)
        assert store.read(spark, at).count() == 100 and len(store.manifests(at)) == 1
    store.write(rows.where("numero < 10"), at, "second")
    assert store.read(spark, at).count() == 110 and store.read(spark, at, 1).count() == 100
    store.write(rows.where("numero < 7"), f"file://{at}", "third", "overwrite")
    got = store.read(spark, f"file://{at}")
    assert got.count() == 7 and got.schema["dezenas"].dataType.simpleString() == "array<int>" and [m["run"] for m in store.manifests(at)] == ["first", "second", "third"]

"""Predictors of draws, each known by a name, and one test for all of them.

A prediction is a set of numbers for a draw, made from the draws before and from the
calendar. Families over fields stay in long form: the fields of a draw are one array,
crossed with the operations inside the row, so that one aggregation by name tests all
of them; no plan has a column for each hypothesis.

`parse` turns any name of the grammar (also names of mutated predictors) into a Column:
    field.op[>op...]             chain of unary operations on a field
    fa+fb.op                     binary operation on two fields
    set.s                        a set extractor
    set.s@f.op                   a set with a field folded into each number
    window.soma_{alta,baixa}→h   half h of the domain if the last sum is high or low
    window.f_{alto,baixo}→h      half or parity class if a field is high or low
    setop.a_{inter,union,diff}_b set algebra on two extractors
    nest.(fa op1 fb)op2 fc       nested binary operations, written without spaces
"""

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from urnwise.cluster import ship
from urnwise.functions.scalar import BINARY, FIELDS, SETS, UNARY, bit_of, digit_sum, extractors, fields, money_digits, moon_age, moon_phase, reversed_or_null, within, wrap
from urnwise.games import GAMES, PRIMES
from urnwise.operators.features import size_of
from urnwise.operators.sequence import last_draws

NONE = "array<int>"


def empty() -> Column:
    return F.array().cast(NONE)


def unary_names() -> list[str]:
    return [f"{f}.{op}" for f in FIELDS for op in UNARY]


def binary_names() -> list[str]:
    return [f"{a}+{b}.{op}" for a, b in combinations(FIELDS, 2) for op in BINARY]


def set_names() -> list[str]:
    return [f"set.{s}" for s in SETS]


def window_names() -> list[str]:
    return [f"window.soma_{t}→{h}" for t in ("alta", "baixa") for h in ("baixos", "altos")]


def halves(m: Column) -> dict[str, Column]:
    """Named parts of the domain 1..m."""
    half = F.floor(m / 2).cast("int")
    return {"baixos": F.sequence(F.lit(1), half), "altos": F.sequence(half + 1, m), "pares": F.sequence(F.lit(2), m, F.lit(2)), "impares": F.sequence(F.lit(1), m, F.lit(2))}


def vocabulary(m: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Fields and set extractors, to be built once for many names."""
    return fields(), extractors(m)


def parse(name: str, m: Column, words: tuple[dict[str, Column], dict[str, Column]] | None = None) -> Column | None:
    """The prediction of a name as an array column over ctx; null for a name outside the grammar."""
    f, sets = words or vocabulary(m)
    one = lambda v: F.array(wrap(v, m))
    head, _, rest = name.partition(".")
    if head == "window":
        rule, _, part = rest.partition("→")
        cond, _, way = rule.rpartition("_")
        if part not in halves(m):
            return None
        if cond == "soma" and way in ("alta", "baixa") and part in ("baixos", "altos"):
            some = F.size(F.coalesce("prev", empty())) > 0
            high = f["soma_prev"] > m * 7.5
            return F.when(some & (high if way == "alta" else ~high), halves(m)[part]).otherwise(empty())
        if cond in f and way in ("alto", "baixo"):
            high = f[cond] > F.floor(m / 2)
            return F.when(high if way == "alto" else ~high, halves(m)[part]).otherwise(empty())
        return None
    if head == "set":
        s, at, tail = rest.partition("@")
        if s not in sets:
            return None
        if not at:
            return sets[s]
        field, _, op = tail.rpartition(".")
        if field not in f or op not in ("add", "sub", "xor"):
            return None
        return F.array_distinct(F.transform(sets[s], lambda d: wrap(BINARY[op](d.cast("long"), f[field]), m)))
    if head == "setop":
        for a in SETS:
            for op, how in (("inter", F.array_intersect), ("union", F.array_union), ("diff", F.array_except)):
                if rest.startswith(f"{a}_{op}_") and rest[len(a) + len(op) + 2 :] in sets:
                    return how(sets[a], sets[rest[len(a) + len(op) + 2 :]])
        return None
    if head == "nest":
        for a in FIELDS:
            for op in BINARY:
                if rest.startswith(f"({a}{op}"):
                    for b in FIELDS:
                        for op2 in BINARY:
                            if rest.startswith(f"({a}{op}{b}){op2}") and rest[len(a + op + b + op2) + 2 :] in f:
                                return one(BINARY[op2](BINARY[op](f[a], f[b]), f[rest[len(a + op + b + op2) + 2 :]]))
        return None
    a, plus, b = head.partition("+")
    if plus:
        return one(BINARY[rest](f[a], f[b])) if a in f and b in f and rest in BINARY else None
    ops = rest.split(">")
    if head not in f or not 1 <= len(ops) <= 6 or any(o not in UNARY for o in ops):
        return None
    return one(reduce(lambda v, o: UNARY[o](v), ops, f[head]))


def predictions(ctx: DataFrame, names: list[str], wide: int = 24) -> DataFrame:
    """Long rows (game, numero, idx, dezenas, nome, pred) of named predictors, one for each draw and name.

    More than `wide` names of the unary or binary family come from that family's long
    form; all others are expressions of their own.
    """
    m, rest, parts = size_of(), list(dict.fromkeys(names)), []
    for every, family in ((unary_names(), unary_family), (binary_names(), binary_family)):
        own = sorted(set(every) & set(rest))
        if len(own) > wide:
            parts.append(family(ctx).where(F.col("nome").isin(own)))
            rest = [n for n in rest if n not in set(own)]
    words = vocabulary(m) if rest else None
    each = [F.struct(F.lit(n).alias("nome"), p.alias("pred")) for n in rest if (p := parse(n, m, words)) is not None]
    if each or not parts:
        x = F.explode(F.array(*each) if each else F.array().cast("array<struct<nome:string,pred:array<int>>>")).alias("x")
        parts.append(ctx.select("game", "numero", "idx", "dezenas", x).select("game", "numero", "idx", "dezenas", "x.nome", "x.pred"))
    return reduce(DataFrame.unionByName, parts)


def unary_family(ctx: DataFrame) -> DataFrame:
    """All field.op predictions in long form; fields are one array, operations another step inside the row."""
    f, m = fields(), size_of()
    stacked = ctx.select("game", "numero", "idx", "dezenas", m.alias("m"), F.explode(F.array(*(F.struct(F.lit(n).alias("f"), f[n].alias("v")) for n in FIELDS))).alias("x"))
    v = F.col("x.v")
    ops = F.array(*(F.struct(F.lit(n).alias("op"), op(v).cast("long").alias("r")) for n, op in UNARY.items()))
    rows = stacked.select("game", "numero", "idx", "dezenas", "m", F.col("x.f").alias("f"), F.explode(ops).alias("o"))
    return rows.select("game", "numero", "idx", "dezenas", F.concat_ws(".", "f", "o.op").alias("nome"), F.array(wrap(F.col("o.r"), F.col("m"))).alias("pred"))


def binary_family(ctx: DataFrame) -> DataFrame:
    """All fa+fb.op predictions in long form: pairs of a draw's fields come from its own array, no join."""
    f = fields()
    stacked = ctx.select("game", "numero", "idx", "dezenas", size_of().alias("m"), F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("f"), f[n].alias("v")) for i, n in enumerate(FIELDS))).alias("xs"))
    left = stacked.select("*", F.explode("xs").alias("a")).select("*", F.explode(F.filter("xs", lambda x: x["i"] > F.col("a.i"))).alias("b"))
    a, b = F.col("a.v"), F.col("b.v")
    ops = F.array(*(F.struct(F.lit(n).alias("op"), op(a, b).cast("long").alias("r")) for n, op in BINARY.items()))
    rows = left.select("game", "numero", "idx", "dezenas", "m", F.concat(F.col("a.f"), F.lit("+"), F.col("b.f")).alias("f"), F.explode(ops).alias("o"))
    return rows.select("game", "numero", "idx", "dezenas", F.concat_ws(".", "f", "o.op").alias("nome"), F.array(wrap(F.col("o.r"), F.col("m"))).alias("pred"))


def _lows(ctx: DataFrame, since: int | None) -> DataFrame | None:
    return None if since is None else ctx.groupBy("game").agg(F.greatest(F.max("idx") + 1 - since, F.lit(0)).alias("_low"))


def _reversed(v: np.ndarray) -> np.ndarray:
    """The digits in reverse order, of at least two digits."""
    out, rest = np.zeros_like(v), v.copy()
    while (going := rest > 0).any():
        out = np.where(going, out * 10 + rest % 10, out)
        rest //= 10
    return np.where(v < 10, v * 10, out)


def _digit_sum(v: np.ndarray) -> np.ndarray:
    out, rest = np.zeros_like(v), v.copy()
    while rest.any():
        out += rest % 10
        rest //= 10
    return out


def _unary_results(v: np.ndarray) -> dict[str, np.ndarray]:
    """UNARY on an array of numbers that are not negative."""
    root = np.floor(np.sqrt(v.astype(np.float64))).astype(np.int64)
    return {"id": v, "mod10": v % 10, "mod7": v % 7, "inv": _reversed(v), "dsum": _digit_sum(v), "sqrt": root, "log2": np.where(v > 0, np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1, 0), "x2": v * 2, "half": v // 2}


def _pair_results(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """BINARY on arrays of numbers that are not negative."""
    return {"add": a + b, "sub": np.abs(a - b), "mul": a * b, "xor": a ^ b, "mod": np.where(b != 0, a % np.where(b != 0, b, 1), 0)}


def _family_tallies(ctx: DataFrame, names: list[str], results: Callable[[np.ndarray], Iterator[np.ndarray]], since: int | None) -> DataFrame:
    """Tallies of predictions of one number each: tasks count results(fields of their draws, a row for each field) in the order of names, and hand on a row for each game and name."""
    ship(ctx.sparkSession)
    f = fields()
    rows = ctx.where("idx > 0")
    late = F.lit(False)
    if since is not None:
        rows = rows.join(F.broadcast(_lows(ctx, since)), "game")  # one row for each game
        late = F.col("idx") > F.col("_low")
    rows = rows.select("game", size_of().cast("long").alias("m"), "mask", late.alias("late"), F.array(*(f[n] for n in FIELDS)).alias("v"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for game in batch.column("game").unique().to_pylist():
                own = batch.filter(pc.equal(batch.column("game"), game))
                m, mask = own.column("m")[0].as_py(), own.column("mask").to_numpy()
                recent, v = own.column("late").to_numpy(zero_copy_only=False), own.column("v").flatten().to_numpy().reshape(own.num_rows, -1).T.copy()
                out, some = np.zeros((len(names), 3), np.int64), recent.any()  # hits, recent draws, hits among those
                out[:, 1] = recent.sum()
                for k, r in enumerate(results(v)):
                    r = r % m
                    r[r == 0] = m
                    hit = (mask >> r & 1).astype(bool)
                    out[k, 0] = np.count_nonzero(hit)
                    if some:
                        out[k, 2] = np.count_nonzero(hit & recent)
                n, total = sums.get(game, (0, 0))
                sums[game] = n + own.num_rows, total + out
        for game, (n, total) in sums.items():
            k = np.arange(len(names), dtype=np.int32)
            columns = [pa.array([game] * len(k)), pa.array(k), pa.array(np.full(len(k), n)), *map(pa.array, total.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["game", "k", "n", "hits", "late", "late_hits"])

    made = rows.mapInArrow(count, "game string, k int, n long, hits long, late long, late_hits long")
    per = made.groupBy("game", "k").agg(*(F.sum(c).alias(c) for c in ("n", "hits", "late", "late_hits")))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
    recent = [F.col("late").alias("tentativas_recente"), F.col("late_hits").alias("acertos_recente"), F.col("late").alias("previstos_recente")] if since is not None else []
    return per.select("game", F.col("n").alias("tentativas"), F.col("hits").alias("acertos"), F.col("n").alias("previstos"), *recent, name.alias("nome"))


def unary_tallies(ctx: DataFrame, since: int | None = None) -> DataFrame:
    """tallies(unary_family(ctx), since), counted by tasks."""
    return _family_tallies(ctx, unary_names(), lambda v: (r for x in v for r in _unary_results(x).values()), since)


def binary_tallies(ctx: DataFrame, since: int | None = None) -> DataFrame:
    """tallies(binary_family(ctx), since), counted by tasks."""
    return _family_tallies(ctx, binary_names(), lambda v: (r for a, b in combinations(v, 2) for r in _pair_results(a, b).values()), since)


def programmatic_names() -> list[str]:
    return unary_names() + binary_names() + set_names() + window_names()


def later_wins(*families: DataFrame, keys: tuple[str, ...] = ("nome",)) -> DataFrame:
    """The union of families of equal columns; of rows with one key, that of the last family that has it."""
    rows = reduce(DataFrame.unionByName, (f.withColumn("_family", F.lit(i)) for i, f in enumerate(families)))
    rest = [c for c in rows.columns if c not in (*keys, "_family")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_family").alias("x")).select(*keys, "x.*")


def tallies_of(ctx: DataFrame, names: list[str], since: int | None = None) -> DataFrame:
    """Tallies of any names: of the unary and the binary family at once, of hand-written predictors (known by their names) and of further names of the grammar."""
    wanted, parts = set(names), []
    for every, family in ((unary_names(), unary_tallies), (binary_names(), binary_tallies)):
        own = sorted(wanted & set(every))
        if own:
            parts.append(family(ctx, since).where(F.col("nome").isin(own)))
    hand = sorted(n for n in wanted if "." not in n)  # the grammar's names have a point
    if hand:
        every = by_hand()
        parts.append(named_tallies(ctx if "ordem" in ctx.columns else ctx.withColumn("ordem", empty()), {n: every[n][1] for n in hand if n in every}, since))
    rest = sorted(wanted - set(unary_names()) - set(binary_names()) - set(hand))  # few
    if rest or not parts:
        m = size_of()
        words = vocabulary(m)
        parts.append(named_tallies(ctx, {n: p for n in rest if (p := parse(n, m, words)) is not None}, since))
    return reduce(DataFrame.unionByName, parts)


def by_hand() -> dict[str, tuple[str, Column]]:
    """The 40 hand-written predictors: name -> (category, prediction)."""
    m = size_of()
    none = empty()
    day, month, n = F.day("data"), F.month("data"), F.col("numero")
    prev = F.coalesce("prev", none)
    some = F.size(prev) > 0
    inside = lambda *v: within(F.array(*(x.cast("long") for x in v)), m)
    digits = lambda v: F.transform(F.split(v.cast("string"), ""), lambda c: F.when(c != "", c.cast("int")))
    n_text = n.cast("string")
    twos = F.when(F.length(n_text) > 1, F.transform(F.sequence(F.lit(1), F.length(n_text) - 1), lambda i: F.substring(n_text, i, F.lit(2)).cast("int"))).otherwise(none)
    money = lambda c: money_digits(F.coalesce(c, F.lit(0.0)), m)
    size = F.size(prev)
    total = F.aggregate(prev, F.lit(0).cast("long"), lambda a, x: a + x)
    sets = extractors(m)
    const = lambda of: F.coalesce(*(F.when(F.col("game") == g.key, F.array(*map(F.lit, sorted(of(g.m))))) for g in GAMES.values()))
    fib = lambda top: {1, 2, 3, 5, 8, 13, 21, 34, 55} & set(range(1, top + 1))
    phi = (1 + math.sqrt(5)) / 2
    golden = lambda top: {round(top * k / phi) % top or top for k in range(1, 10)}
    squares = const(lambda top: {i * i for i in range(1, math.isqrt(top) + 1)})
    if_prev = lambda *v: F.when(some, inside(*v)).otherwise(none)
    first = F.try_element_at(F.col("ordem"), F.lit(1))
    value = F.coalesce("valor_estimado", F.lit(0.0))
    phase_part = F.when(moon_phase(F.col("data")).isin("nova", "cheia"), halves(m)["baixos"]).otherwise(halves(m)["altos"])
    return {
        "dia_invertido": ("data", inside(reversed_or_null(day))),
        "mes_invertido": ("data", inside(reversed_or_null(month))),
        "dia_mes_combo": ("data", inside(day, month, reversed_or_null(day), reversed_or_null(month))),
        "soma_digitos_data": ("data", inside(digit_sum(day) + digit_sum(month) + digit_sum(F.year("data")))),
        "diff_dia_mes": ("data", inside(F.abs(day - month))),
        "produto_dia_mes": ("data", inside(day * month)),
        "dia_mes_aritmetica": ("data", inside(day + month, F.abs(day - month), F.when((day < 10) & (month < 10), day * 10 + month), F.when((day < 10) & (month < 10), month * 10 + day))),
        "digitos_concurso": ("concurso", within(digits(n), m)),
        "concurso_mod": ("concurso", F.array(wrap(n, m))),
        "soma_digitos_concurso": ("concurso", inside(digit_sum(n))),
        "pares_digitos_concurso": ("concurso", within(twos, m)),
        "dia_do_ano_mod": ("temporal", F.array(wrap(F.dayofyear("data"), m))),
        "semana_do_ano": ("temporal", F.array(wrap(F.weekofyear("data"), m))),
        "fase_lua": ("temporal", inside(F.floor(moon_age(F.col("data"))) + 1)),
        "lua_metade": ("temporal", phase_part),
        "digitos_acumulado": ("financeiro", money(F.col("valor_acumulado"))),
        "digitos_estimado": ("financeiro", money(F.col("valor_estimado"))),
        "digitos_arrecadado": ("financeiro", money(F.col("valor_arrecadado"))),
        "magnitude_premio": ("financeiro", F.when(value > 0, inside(F.log10(F.when(value > 0, value)).cast("int"))).otherwise(none)),
        "repeticoes_anterior": ("inter-sorteio", sets["prev"]),
        "complemento": ("inter-sorteio", sets["prev_comp"]),
        "vizinhos_anterior": ("inter-sorteio", sets["prev_viz"]),
        "espelho_anterior": ("inter-sorteio", sets["prev_esp"]),
        "soma_pares_consecutivos": ("inter-sorteio", sets["prev_soma2"]),
        "gaps_anterior": ("inter-sorteio", sets["prev_gaps"]),
        "media_anterior": ("inter-sorteio", if_prev(F.rint(total / size))),
        "mediana_anterior": ("inter-sorteio", if_prev(F.try_element_at(prev, (F.floor(size / 2) + 1).cast("int")))),
        "dobro_max_anterior": ("inter-sorteio", F.when(some, F.array(wrap(F.array_max(prev) * 2, m))).otherwise(none)),
        "fibonacci": ("matemática", const(fib)),
        "golden_ratio": ("matemática", const(golden)),
        "primos": ("matemática", const(lambda top: {p for p in PRIMES if p <= top})),
        "quadrados_perfeitos": ("matemática", squares),
        "multiplos_7": ("matemática", F.sequence(F.lit(7), m, F.lit(7))),
        "vizinhos_primeira_bola": ("ordem", F.when(first.isNotNull(), inside(first - 1, first + 1)).otherwise(none)),
        "quadrados_apos_quadrados": ("2a-ordem", F.when(F.size(F.array_intersect(prev, squares)) >= 2, squares).otherwise(none)),
        "soma_anterior_mod": ("2a-ordem", F.when(some, F.array(wrap(total, m))).otherwise(none)),
        "xor_anterior": ("2a-ordem", sets["prev_xor"]),
        "centesimos_concurso": ("concurso", inside(n % 100, reversed_or_null(n % 100))),
        "amplitude_anterior": ("2a-ordem", if_prev(F.array_max(prev) - F.array_min(prev))),
        "ausentes_2_pares": ("2a-ordem", F.filter(sets["ausentes2"], lambda d: d % 2 == 0)),
    }


def by_hand_family(ctx: DataFrame) -> DataFrame:
    """The hand-written predictions in long form; ctx may bring `ordem` (numbers in order of draw)."""
    rows = ctx if "ordem" in ctx.columns else ctx.withColumn("ordem", empty())
    each = [F.struct(F.lit(n).alias("nome"), F.lit(c).alias("cat"), p.alias("pred")) for n, (c, p) in by_hand().items()]
    return rows.select("game", "numero", "idx", "dezenas", F.explode(F.array(*each)).alias("x")).select("game", "numero", "idx", "dezenas", "x.nome", "x.cat", "x.pred")


def tallies(rows: DataFrame, since: int | None = None) -> DataFrame:
    """Per game and name over draws after the first: attempts (not empty predictions), hits, predicted numbers.

    since: also, as *_recente, over each game's last `since` draws after the first of them,
    in the same pass.
    """
    parts = {"tentativas": F.lit(1), "acertos": F.arrays_overlap("pred", "dezenas").cast("int"), "previstos": F.size("pred")}
    some = rows.where((F.col("idx") > 0) & (F.size("pred") > 0))
    sums = [F.sum(c).alias(n) for n, c in parts.items()]
    if since is not None:
        low = rows.groupBy("game").agg(F.greatest(F.max("idx") + 1 - since, F.lit(0)).alias("_low"))  # one row for each game
        some = some.join(F.broadcast(low), "game")
        sums += [F.sum(F.when(F.col("idx") > F.col("_low"), c).otherwise(0)).alias(f"{n}_recente") for n, c in parts.items()]
    return some.groupBy("game", "nome").agg(*sums)


def named_tallies(ctx: DataFrame, predictors: dict[str, Column], since: int | None = None) -> DataFrame:
    """tallies() of predictors (name -> prediction over ctx): of a draw's predictions only sizes and hits become rows, counted by place; names come last."""
    names = list(predictors)
    rows = ctx.where("idx > 0").select("game", "idx", "dezenas", F.array(*predictors.values()).cast("array<array<int>>").alias("p"))
    each = F.transform("p", lambda p: F.struct(F.size(p).alias("s"), F.arrays_overlap(p, F.col("dezenas")).cast("int").alias("h")))
    parts = {"tentativas": F.lit(1), "acertos": F.col("x.h"), "previstos": F.col("x.s")}
    rows = rows.select("game", "idx", F.posexplode(each).alias("i", "x")).where("x.s > 0")
    sums = [F.sum(c).alias(n) for n, c in parts.items()]
    if since is not None:
        rows = rows.join(F.broadcast(_lows(ctx, since)), "game")  # one row for each game
        sums += [F.sum(F.when(F.col("idx") > F.col("_low"), c).otherwise(0)).alias(f"{n}_recente") for n, c in parts.items()]
    name = F.element_at(F.array(*map(F.lit, names)).cast("array<string>"), F.col("i") + 1)
    return rows.groupBy("game", "i").agg(*sums).select("game", name.alias("nome"), *(c for c in (*parts, *(f"{n}_recente" for n in parts if since is not None))))


def test(tally: DataFrame, least: int = 30, exact: bool = False) -> DataFrame:
    """Observed and expected rate, lift and chi-square of one degree of freedom for each tally that is large enough.

    exact takes the chance of a hit without replacement at the mean set size (rounded)
    instead of the approximation with replacement.
    """
    k = F.coalesce(*(F.when(F.col("game") == g.key, F.lit(g.k)) for g in GAMES.values()))
    m, size = size_of(), F.col("previstos") / F.col("tentativas")
    if exact:
        whole = F.round(size).cast("int")
        chance = F.lit(1.0) - F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(1.0), lambda p, i: p * F.greatest(F.lit(0), m - whole - i) / (m - i))
    else:
        chance = F.lit(1.0) - F.pow((m - k) / m, size)
    rows = tally.where(F.col("tentativas") >= least).withColumn("taxa_obs", F.col("acertos") / F.col("tentativas")).withColumn("taxa_esp", F.when((chance <= 0) | (chance >= 1), k / m).otherwise(chance))
    yes, no = F.col("tentativas") * F.col("taxa_esp"), F.col("tentativas") * (1 - F.col("taxa_esp"))
    d = F.col("acertos") - yes
    rows = rows.where((yes >= 5) & (no >= 5)).withColumn("chi2", d * d / yes + d * d / no)
    return rows.select("game", "nome", "tentativas", "acertos", "previstos", "taxa_obs", "taxa_esp", (F.col("taxa_obs") / F.col("taxa_esp")).alias("lift"), "chi2")


@F.pandas_udf(DoubleType())
def _tail(chi2: pd.Series) -> pd.Series:
    return chi2.map(lambda c: math.erfc(math.sqrt(max(c, 0.0) / 2)))


def with_p(tested: DataFrame) -> DataFrame:
    """tested with `p_valor`: erfc(sqrt(chi2 / 2)), which Spark has no function for; a few hundred rows reach Python."""
    return tested.withColumn("p_valor", _tail(F.col("chi2")))


def recent(rows: DataFrame, n: int = 50) -> DataFrame:
    """Predictions on each game's last n draws, renumbered from 0 as a log of its own."""
    own = last_draws(rows, "game", n)
    start = own.groupBy("game").agg(F.min("idx").alias("_low"))
    return own.join(start, "game").withColumn("idx", F.col("idx") - F.col("_low")).drop("_low")

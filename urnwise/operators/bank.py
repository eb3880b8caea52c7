"""The pattern bank: scored predictors with upsert, pruning and recent validation, and evolution of names."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urnwise.functions.scalar import BINARY, FIELDS, SETS, UNARY

BANK = "game string, nome string, cat string, descr string, p_valor double, lift double, taxa_obs double, taxa_esp double, tentativas long, ativo boolean, p_valor_recente double, lift_recente double, score_confianca double"


def confidence(p: Column, p_recent: Column, lift: Column, lift_recent: Column) -> Column:
    """Confidence of a pattern: significance overall and in recent draws, and strength of both lifts."""
    zero = F.lit(0.0)
    force = lambda x: F.least(F.abs(x - 1), F.lit(0.5)) * 2
    return F.greatest(zero, 1 - p / 0.05) * 0.25 + F.greatest(zero, 1 - p_recent / 0.10) * 0.35 + force(lift) * 0.15 + force(lift_recent) * 0.25


def threshold(tested: int) -> float:
    """The largest p of a pattern worth keeping when so many are tested in a round."""
    return min(0.05, 0.05 * 100 / max(tested, 1))


def scored(overall: DataFrame, recent: DataFrame) -> DataFrame:
    """Tests with p_valor, joined with their recent tests (missing: p 1, lift 1) and scored."""
    r = recent.select("game", "nome", F.col("p_valor").alias("p_valor_recente"), F.col("lift").alias("lift_recente"))
    rows = overall.join(r, ["game", "nome"], "left").fillna({"p_valor_recente": 1.0, "lift_recente": 1.0})
    return rows.withColumn("score_confianca", confidence(F.col("p_valor"), F.col("p_valor_recente"), F.col("lift"), F.col("lift_recente")))


def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (game, nome): a new pattern is active; an updated one if its score exceeds 0.1; others stay."""
    keys = ["game", "nome"]
    fixed = ("cat", "descr")
    fields = [c for c in stored.columns if c not in (*keys, *fixed, "ativo")]
    a, b = stored.withColumn("_old", F.lit(True)).alias("a"), new.dropDuplicates(keys).withColumn("_new", F.lit(True)).alias("b")
    rows = a.join(b, keys, "full_outer")
    pick = lambda c: F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    active = F.when(F.col("_new") & F.col("_old"), F.col("b.score_confianca") > 0.1).when(F.col("_new"), F.lit(True)).otherwise(F.col("a.ativo"))
    out = {c: pick(c) for c in fields} | {c: F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in fixed if c in stored.columns} | {"ativo": active.alias("ativo")}
    return rows.select(*(out.get(c, F.col(c)) for c in stored.columns))


def invalidate(stored: DataFrame, failed: DataFrame) -> DataFrame:
    """Patterns named in failed (game, nome) become inactive."""
    hit = failed.select("game", "nome").distinct().withColumn("_hit", F.lit(True))
    return stored.join(hit, ["game", "nome"], "left").withColumn("ativo", F.col("ativo") & F.col("_hit").isNull()).select(*stored.columns)


def prune(stored: DataFrame) -> DataFrame:
    """Weak or decaying patterns become inactive."""
    weak = (F.col("score_confianca") < 0.05) | ((F.col("p_valor_recente") > 0.3) & (F.col("p_valor") > 0.03))
    return stored.withColumn("ativo", F.col("ativo") & ~weak)


def active(stored: DataFrame) -> DataFrame:
    """Active patterns of each game, the best score first (`rank`)."""
    order = Window.partitionBy("game").orderBy(F.desc("score_confianca"), "nome")
    return stored.where("ativo").withColumn("rank", F.row_number().over(order))


def stats(stored: DataFrame) -> DataFrame:
    """Per game: patterns, active ones, the least p and the largest score among those."""
    on = F.col("ativo")
    return stored.groupBy("game").agg(F.count("*").alias("total"), F.count_if(on).alias("ativos"), F.min(F.when(on, F.col("p_valor"))).alias("melhor_p"), F.max(F.when(on, F.col("score_confianca"))).alias("melhor_score"))


def untested(names: DataFrame, stored: DataFrame) -> DataFrame:
    """Names that the bank doesn't hold yet."""
    return names.join(stored.select("game", "nome"), ["game", "nome"], "left_anti")


# -- evolution: names only; hypotheses.parse gives each of them its meaning


def mutate_unary(name: str, rng: random.Random) -> str:
    f, _, op = name.partition(".")
    return f"{rng.choice(FIELDS)}.{op}" if rng.random() < 0.5 else f"{f}.{rng.choice(list(UNARY))}"


def mutate_binary(name: str, rng: random.Random) -> str:
    head, _, op = name.partition(".")
    a, _, b = head.partition("+")
    way = rng.randrange(3)
    return f"{rng.choice(FIELDS) if way == 0 else a}+{rng.choice(FIELDS) if way == 1 else b}.{rng.choice(list(BINARY)) if way == 2 else op}"


def crossover(one: str, other: str) -> str:
    """The fields of one binary pattern with the operation of another."""
    return f"{one.partition('.')[0]}.{other.partition('.')[2]}"


def chain(name: str, rng: random.Random) -> str | None:
    """One more unary operation, at most six in all."""
    return f"{name}>{rng.choice(list(UNARY))}" if name.count(">") < 5 else None


def evolve(bank: list[str], count: int, seed: int) -> list[str]:
    """Up to `count` new distinct names from a seeded mix of the eight ways, in at most ten tries for each."""
    rng, out = random.Random(seed), {}
    unary = [n for n in bank if n.partition(".")[0] in FIELDS and n.partition(".")[2] in UNARY] or [f"{f}.id" for f in FIELDS]
    binary = [n for n in bank if "+" in n] or ["dia+mes.add", "conc+soma_prev.xor"]
    ways = {
        "mutate_unary": lambda: mutate_unary(rng.choice(unary), rng),
        "mutate_binary": lambda: mutate_binary(rng.choice(binary), rng),
        "crossover": lambda: crossover(rng.choice(binary), rng.choice(binary)),
        "chain": lambda: chain(rng.choice(unary), rng),
        "set_field": lambda: f"set.{rng.choice(SETS)}@{rng.choice(FIELDS)}.{rng.choice(('add', 'sub', 'xor'))}",
        "window": lambda: f"window.{rng.choice(FIELDS)}_{rng.choice(('alto', 'baixo'))}→{rng.choice(('baixos', 'altos', 'pares', 'impares'))}",
        "setop": lambda: "setop.{}_{}_{}".format((s := rng.sample(SETS, 2))[0], rng.choice(("inter", "union", "diff")), s[1]),
        "nest": lambda: "nest.({}{}{}){}{}".format((f := rng.sample(FIELDS, 3))[0], rng.choice(list(BINARY)), f[1], rng.choice(list(BINARY)), f[2]),
    }
    weights = (0.18, 0.14, 0.10, 0.13, 0.10, 0.10, 0.10, 0.15)
    known = set(bank)
    for _ in range(10 * count):
        if len(out) >= count:
            break
        name = ways[rng.choices(list(ways), weights)[0]]()
        if name and name not in known:
            out[name] = True
    return list(out)

"""Nonlinear diagnostics of the draw log: entropies, recurrence, surrogates, changepoints, divergence.

All run over whole logs and series as Spark windows and aggregations; no series is one task.
Lengths of repeats come from `suffixes`, shuffled copies from `surrogates`; `packed` has line
entropy and divergence of the log's own series, a task for each number.

Series are whole numbers on a grid (how many of the last draws hold a number). Where the
limit under which two stretches count as alike is less than one step, alike is equal, and
comparing every point with every other is counting equal stretches: c equal ones are
c (c - 1) / 2 pairs. A diagonal line of recurrence is a longer equal stretch, a vertical
line an island of equal points in time, so rates, determinism, laminarity and line
entropy are sums over groups; no pair is ever a row. Where the limit reaches one step,
the measures are null.

Two readings are offered where the usual one is an artefact: numbers sorted inside each
draw force rising runs (`permutation_entropy(column)` takes another order), and the mean
of all numbers' shares is constant by construction (each number has a series of its own).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from urnwise.cluster import cut
from urnwise.games import GAMES
from urnwise.operators.blocks import Block, by_chunk, typed
from urnwise.operators.features import counts_before
from urnwise.operators.sequence import running, windowed
from urnwise.operators.suffixes import repeats


def _times(values: str, k: int) -> Column:
    return F.coalesce(F.size(F.filter(values, lambda v: v == k)), F.lit(0))


def permutation_entropy(ctx: DataFrame, column: str = "dezenas") -> DataFrame:
    """Per game: entropy of the order patterns of three successive values of the flat series, over log2(6); equal values keep their order."""
    rows = windowed(ctx.select("game", "idx", F.col(column).alias("d")), "game", 0, 1, lambda w: {"next": F.lead("d", 1).over(w)})
    series = F.concat("d", F.coalesce(F.slice("next", 1, 2), F.array().cast("array<int>")))
    n = F.size(series)
    # a pattern is the outcome of three comparisons; a row gives how many triples have each of the eight, six of which can occur
    code = lambda i: (F.get(series, i) <= F.get(series, i + 1)).cast("int") + 2 * (F.get(series, i + 1) <= F.get(series, i + 2)).cast("int") + 4 * (F.get(series, i) <= F.get(series, i + 2)).cast("int")
    coded = rows.select("game", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), code)).alias("codes"))
    sums = coded.groupBy("game").agg(*(F.sum(_times("codes", k)).alias(f"o{k}") for k in range(8)))
    total = sum((F.col(f"o{k}") for k in range(8)), F.lit(0))
    part = lambda k: F.when(F.col(f"o{k}") > 0, F.col(f"o{k}") / total * F.log2(F.col(f"o{k}") / total)).otherwise(0.0)
    return sums.where(total > 0).select("game", (-sum((part(k) for k in range(8)), F.lit(0.0)) / math.log2(6)).alias("entropy"))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution: regularised incomplete gamma by series or continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_quantile(p: float, df: int) -> float:
    """The value that a chi-square variable stays below with probability p, by bisection."""
    low, high = 0.0, 10.0 * df + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi2_tail(mid, df) < p else (low, mid)
    return (low + high) / 2


def changepoint_series(log: DataFrame, width: int = 50) -> DataFrame:
    """Rows (game, idx, chi2): the counts of the `width` draws before against those of the `width` draws from idx on; all numbers inside a draw's row."""
    schema = T.StructType([T.StructField("game", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("chi2", T.DoubleType())])

    def compare(block: Block) -> pa.Table:
        l, r = block.count(-width, 0).astype(np.float64), block.count(0, width)
        both = l + r
        # both halves expect e = (l + r) / 2, so their squares over e add up to (l - r)^2 / (l + r)
        part = np.where(both > 0, (l - r) * (l - r) / np.maximum(both, 1), 2e-10)
        return typed({"game": block.rows.column("game"), "idx": block.idx, "chi2": np.cumsum(part, axis=1)[:, -1]}, schema)

    rows = by_chunk(log, [], width, width, compare, schema)
    top = log.groupBy("game").agg((F.max("idx") + 1).alias("total"))
    return rows.join(F.broadcast(top), "game").where((F.col("idx") >= width) & (F.col("idx") < F.col("total") - width)).select("game", "idx", "chi2")  # one row for each game


def changepoints(series: DataFrame, p: float = 0.99) -> DataFrame:
    """The highest point of each run of draws above the chi-square quantile; a run at the end counts too."""
    limit = F.coalesce(*(F.when(F.col("game") == g.key, F.lit(chi2_quantile(p, g.m - 1))) for g in GAMES.values()))
    above = series.where(F.col("chi2") > limit)  # islands: few rows
    island = above.withColumn("island", F.col("idx") - F.row_number().over(Window.partitionBy("game").orderBy("idx")))
    return island.groupBy("game", "island").agg(F.max_by("idx", F.struct("chi2", -F.col("idx"))).alias("position"), F.max("chi2").alias("chi2")).select("game", "position", "chi2")


# -- series of numbers: rows (game, n, idx, c), c whole

#: Limits in deviations of the series.
SAMPLE_LIMIT, RECURRENCE_LIMIT = 0.2, 0.1


def codes(log: DataFrame, width: int = 30) -> DataFrame:
    """Rows (game, n, idx, c) for each number: how many of the `width` draws before hold it, from the first full window on, idx from 0."""
    return counts_before(log, width).where(F.col("idx") >= width).select("game", "n", (F.col("idx") - width).alias("idx"), F.col("f").alias("c"))


def stretches(series: DataFrame, by: tuple[str, ...], base: int, n: int) -> DataFrame:
    """series with `w`: its values at idx + base and the n - 1 places after, fewer at the end."""
    return windowed(series, "game", 0, base + n, lambda w: {"w": F.collect_list("c").over(w.rowsBetween(base, base + n - 1))}, by)


def _pairs() -> Column:
    return (F.col("k") * (F.col("k") - 1) / 2).cast("long")


def moments(series: DataFrame, by: tuple[str, ...] = ("n",)) -> DataFrame:
    """Per series: points, and whether both limits are less than one step."""
    spread = F.stddev_pop("c")
    return series.groupBy("game", *by).agg(F.count("*").alias("points"), (spread * SAMPLE_LIMIT < 1).alias("fine"))


def islands(series: DataFrame, by: tuple[str, ...] = ("n",)) -> DataFrame:
    """Per series, from embedded points (three values each): pairs of equal ones (n3), points of vertical lines of two or more (vertical), and the permutation entropy of the order of the three values."""
    keys = ["game", *by]
    rows = windowed(series, "game", 1, 2, lambda w: {"x": F.lead("c", 1).over(w), "y": F.lead("c", 2).over(w), "z": F.lag("c", 1).over(w)}, by).where("y is not null")
    new = F.coalesce((F.col("z") != F.col("c")) | (F.col("c") != F.col("x")) | (F.col("x") != F.col("y")), F.lit(True))
    rows = running(rows.select(*keys, "idx", "c", "x", "y", new.cast("int").alias("new")), "game", {"island": F.col("new")}, F.sum, by=by)
    run = rows.groupBy(*keys, "c", "x", "y", "island").agg(F.count("*").alias("len"))
    per = run.groupBy(*keys, "c", "x", "y").agg(F.sum("len").alias("k"), F.sum(F.when(F.col("len") > 1, F.col("len")).otherwise(0)).alias("lines"), F.sum(F.when(F.col("len") > 1, F.col("len") + 2).otherwise(0)).alias("own"))
    first, last = (F.col("c") <= F.col("x")).cast("int"), (F.col("x") <= F.col("y")).cast("int")
    order = F.concat(first, last, (F.col("c") <= F.col("y")).cast("int"))
    cells = cut(per.withColumn("order", order))
    # in its own column a point is no neighbour of itself: an island of len points loses len + 2 of its len^2 places
    sums = cells.groupBy(*keys).agg(F.sum(_pairs()).alias("n3"), (F.sum(F.col("k") * F.col("lines")) - F.sum("own")).alias("vertical"))
    patterns = cells.groupBy(*keys, "order").agg(F.sum("k").alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy(*keys))
    entropy = patterns.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p")) / math.log2(6)).alias("entropy"))
    return sums.join(entropy, keys)


def longer(series: DataFrame, length: int, by: tuple[str, ...] = ("n",)) -> DataFrame:
    """Per series: pairs of equal stretches of that length."""
    rows = stretches(series, by, 0, length).where(F.size("w") == length)
    counts = rows.groupBy("game", *by, F.xxhash64("w").alias("h")).agg(F.count("*").alias("k"))
    return counts.groupBy("game", *by).agg(F.sum(_pairs()).alias(f"n{length}"))


def recurrence(series: DataFrame, by: tuple[str, ...] = ("n",)) -> DataFrame:
    """Per series: points, permutation entropy, recurrence rate (RR), determinism (DET) and laminarity (LAM) of embedded points."""
    keys = ["game", *by]
    rows = moments(series, by).join(islands(series, by), keys).join(longer(series, 4, by), keys).join(longer(series, 5, by), keys)
    of = lambda x: F.when(F.col("fine"), F.when(F.col("n3") > 0, x).otherwise(0.0))
    e = F.col("points") - 2
    return rows.select(*keys, "points", "entropy", of(2 * F.col("n3") / (e * (e - 1))).alias("RR"), of((2 * F.col("n4") - F.col("n5")) / F.col("n3")).alias("DET"), of(F.col("vertical") / (2 * F.col("n3"))).alias("LAM"))


def sample_entropy(series: DataFrame) -> DataFrame:
    """Per series: -log of the share of pairs of equal stretches of two values that still are at three; null without any."""
    total = F.broadcast(series.groupBy("game", "n").agg((F.max("idx") + 1).alias("total")))  # one row for each series
    of = lambda m: stretches(series, ("n",), 0, m).where(F.size("w") == m).join(total, ["game", "n"]).where(F.col("idx") + m < F.col("total")).groupBy("game", "n", "w").agg(F.count("*").alias("k")).groupBy("game", "n").agg(F.sum(_pairs()).alias(f"m{m}"))
    rows = of(2).join(of(3), ["game", "n"]).join(moments(series), ["game", "n"])
    return rows.select("game", "n", F.when(F.col("fine") & (F.col("m2") > 0) & (F.col("m3") > 0), -F.log(F.col("m3") / F.col("m2"))).alias("sample_entropy"))


def line_entropy(series: DataFrame) -> DataFrame:
    """Per series: diagonal lines of two or more embedded points (lines), the longest, and the entropy of their lengths (ENTR)."""
    keys, n = ["game", "n"], cut(repeats(series))
    of = lambda less, k: F.struct((F.col("length") - less).alias("l"), (F.col("pairs") * k).alias("k"))
    exact = n.select(*keys, F.explode(F.array(of(2, 1), of(3, -2), of(4, 1))).alias("x")).groupBy(*keys, "x.l").agg(F.sum("x.k").alias("k")).where("l >= 2 and k > 0")
    sums = exact.groupBy(*keys).agg(F.sum("k").alias("lines"), F.sum(F.col("k") * F.log2("k")).alias("s"))
    tops = n.groupBy(*keys).agg(F.greatest(F.max("length") - 2, F.lit(0)).alias("longest"))
    entropy = F.coalesce(F.log2("lines") - F.col("s") / F.col("lines"), F.lit(0.0))
    rows = tops.join(sums, keys, "left").select(*keys, F.coalesce("lines", F.lit(0)).alias("lines"), "longest", entropy.alias("ENTR"))
    return rows.join(moments(series), keys).where("fine").select(*keys, "lines", "longest", "ENTR")


def divergence(series: DataFrame, apart: int = 5, steps: int = 50, fitted: int = 20) -> DataFrame:
    """Per series: the largest Lyapunov exponent after Rosenstein, Collins and De Luca (1993), the slope of the mean log distance of neighbours as time goes on.

    A point (three values) has as neighbour the nearest other one, earliest first, in the
    first occurrence of its values, or the last if the first is within `apart` places; a
    point whose values recur farther away than that has distance 0 and no logarithm, and
    counts for nothing, as do points too near the end. Neighbours are sought in cells
    whose width doubles until each point left has found one.
    """
    keys, xyz = ["game", "n"], ["c", "x", "y"]
    rows = windowed(series, "game", 0, 2, lambda w: {"x": F.lead("c", 1).over(w), "y": F.lead("c", 2).over(w)}, ("n",)).where("y is not null")
    points = cut(rows.select(*keys, F.col("idx").alias("i"), *xyz))
    size = points.groupBy(*keys).agg(F.count("*").alias("size"), (F.max("c") - F.min("c") + 1).alias("span"))
    widest = size.agg(F.max("span")).head()[0] or 0
    size = size.withColumn("steps", F.least(F.floor(F.col("size") / 4), F.lit(steps)))
    classes = cut(points.groupBy(*keys, *xyz).agg(F.min("i").alias("first"), F.max("i").alias("last")))
    rare = points.join(classes, [*keys, *xyz]).join(F.broadcast(size), keys).where((F.col("i") - F.col("first") <= apart) & (F.col("last") - F.col("i") <= apart) & (F.col("i") < F.col("size") - F.col("steps")) & (F.col("size") >= 20))
    left, found, width = cut(rare.select(*keys, "i", *xyz)), [], 1
    while width < 2 * widest and left.limit(1).count():
        cell = lambda df, tag="": df.select("*", *(F.floor(F.col(v) / width).alias(f"b{v}{tag}") for v in xyz))  # noqa: B023, E731
        near = cell(left)
        for v in xyz:
            near = near.withColumn(f"b{v}", F.explode(F.array(F.col(f"b{v}") - 1, F.col(f"b{v}"), F.col(f"b{v}") + 1)))
        other = cell(classes).select(*keys, *(F.col(v).alias(f"o{v}") for v in xyz), *(f"b{v}" for v in xyz), "first", "last")
        d = sum(((F.col(v) - F.col(f"o{v}")) * (F.col(v) - F.col(f"o{v}")) for v in xyz), F.lit(0))
        j = F.when(F.abs(F.col("i") - F.col("first")) > apart, F.col("first")).when(F.abs(F.col("i") - F.col("last")) > apart, F.col("last"))
        met = near.join(other, [*keys, *(f"b{v}" for v in xyz)]).select(*keys, "i", d.alias("d"), j.alias("j")).where((F.col("d") > 0) & (F.col("d") <= width * width) & F.col("j").isNotNull())
        got = cut(met.groupBy(*keys, "i").agg(F.min(F.struct("d", "j")).alias("x")).select(*keys, "i", "x.j"))
        found.append(got)
        left = cut(left.join(got, [*keys, "i"], "left_anti"))
        width *= 2
    empty = size.select(*keys)
    if found:
        walk = reduce(DataFrame.unionByName, found).join(F.broadcast(size), keys).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("steps"), F.col("size") - F.greatest("i", "j")) - 1)))
        at = lambda side: points.select(*keys, F.col("i").alias(f"at_{side}"), *(F.col(v).alias(f"{v}_{side}") for v in xyz))
        walk = walk.select(*keys, "k", (F.col("i") + F.col("k")).alias("at_i"), (F.col("j") + F.col("k")).alias("at_j")).join(at("i"), [*keys, "at_i"]).join(at("j"), [*keys, "at_j"])
        d = sum(((F.col(f"{v}_i") - F.col(f"{v}_j")) * (F.col(f"{v}_i") - F.col(f"{v}_j")) for v in xyz), F.lit(0))
        mean = walk.withColumn("d", d).where("d > 0").groupBy(*keys, "k").agg(F.avg(F.log("d") / 2).alias("y"))
        first = mean.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("k"))).where(F.col("r") <= fitted)  # `steps` rows a series
        slope = first.groupBy(*keys).agg(F.when(F.count("*") >= 5, F.regr_slope("y", "k")).alias("lyapunov"))
        empty = empty.join(slope, keys, "left")
    else:
        empty = empty.withColumn("lyapunov", F.lit(None).cast("double"))
    return empty.withColumn("lyapunov", F.coalesce("lyapunov", F.lit(0.0)))


def report(recurrences: DataFrame, samples: DataFrame, slopes: DataFrame, points: DataFrame, tests: DataFrame, scores: DataFrame) -> DataFrame:
    """Per series, which of five signals of structure hold: a significant entropy, a measure outside its shuffled copies, determinism over 0.05, changepoints of the log, an exponent over 0.01; any of them is structure."""
    keys = ["game", "n"]
    outside = tests.groupBy(*keys).agg(F.coalesce(F.max("outside"), F.lit(False)).alias("outside"))
    rows = recurrences.select(*keys, "points", "RR", "DET", "LAM").join(samples, keys).join(slopes, keys).join(outside, keys).join(scores.select(*keys, "pe", "z", "significant"), keys)
    changes = points.groupBy("game").agg(F.count("*").alias("changepoints"))  # a row for each game
    rows = rows.join(F.broadcast(changes), "game", "left").fillna({"changepoints": 0})
    held = [("entropy", F.col("significant")), ("surrogate", F.col("outside")), ("determinism", F.coalesce(F.col("DET") > 0.05, F.lit(False))), ("changepoints", F.col("changepoints") > 0), ("chaos", F.col("lyapunov") > 0.01)]
    signals = F.array_join(F.array_compact(F.array(*(F.when(x, name) for name, x in held))), ",")
    return rows.withColumn("signals", signals).withColumn("verdict", F.when(signals == "", "compatible with chance").otherwise("structure"))

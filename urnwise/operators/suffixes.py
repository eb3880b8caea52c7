"""Repeats of series: how many pairs of places agree for at least so many values, by prefix doubling.

Every place of a series stands for the stretch that begins there. Places are ranked by
their first values (as many as go into one long), then by pairs of ranks at distances
that double, until no two are equal: as many rounds as the longest repeat, over as many,
has binary digits. Ranks count the smaller places inside slices, so a series that is one
group of equal stretches is no single task. What two neighbours in that order share is
found from the longest stretch down, one pair of joins a length.

Stretches that agree for v values are an interval of the order in which no two
neighbours share less; an interval of s places whose surroundings share u adds
s (s - 1) / 2 pairs to every length in (u, v]. Chunks of the order give the intervals
that end inside them and hand on only places with nothing smaller on one side: at most
two for each length that the chunk has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urnwise.cluster import cut, ship
from urnwise.operators.sequence import running, windowed

#: (bits of a value, values in one long), the first that is wide enough for the series; 0 stands beyond the end.
PACKS = ((8, 7), (16, 3), (56, 1))
#: Places of the order in a chunk.
CHUNK = 1 << 16
KEYS = ["game", "n"]


def packed(series: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """(rows (game, n, i, head): the values from each place on, first value highest; bits of a value and values in a head)."""
    low, high = series.agg(F.min("c").cast("long"), F.max("c").cast("long")).head()
    low, high = low or 0, high or 0
    bits, chars = next(p for p in PACKS if high - low + 2 <= 1 << p[0])
    rows = windowed(series, "game", 0, chars, lambda w: {"w": F.collect_list("c").over(w.rowsBetween(0, chars - 1))}, ("n",))
    head = sum(((F.coalesce(F.get("w", F.lit(j)).cast("long") - low + 1, F.lit(0)) * (1 << bits * (chars - 1 - j))) for j in range(chars)), F.lit(0).cast("long"))
    return rows.select(*KEYS, F.col("idx").alias("i"), head.alias("head")), (bits, chars)


def _ranked(rows: DataFrame, within: list[str], by: str, first: Column, chunk: int) -> DataFrame:
    """rows with r: `first` and the rows of the same KEYS and `within` whose `by` is smaller."""
    cells = rows.groupBy(*KEYS, *within, by).agg(F.count("*").alias("k"))
    below = running(cells.withColumn("idx", F.col(by)), "game", {"upto": F.col("k")}, by=("n", *within), chunk=chunk)
    return rows.join(below.select(*KEYS, *within, by, (F.col("upto") - F.col("k")).alias("below")), [*KEYS, *within, by]).withColumn("r", first + F.col("below"))


def ranks(heads: DataFrame, chars: int) -> list[DataFrame]:
    """Rows (game, n, i, r) for stretches of so many values, of twice as many and so on: equal stretches have one rank; in the last all differ."""
    out = [cut(_ranked(heads, [], "head", F.lit(0), 1 << 32).select(*KEYS, "i", "r"))]
    while out[-1].groupBy(*KEYS, "r").count().where("count > 1").limit(1).count():
        apart = chars << (len(out) - 1)
        next_ = out[-1].select(*KEYS, (F.col("i") - apart).alias("i"), F.col("r").alias("r2"))
        pairs = out[-1].withColumnRenamed("r", "r1").join(next_, [*KEYS, "i"], "left").withColumn("r2", F.coalesce("r2", F.lit(-1)) + 1)
        out.append(cut(_ranked(cut(pairs), ["r1"], "r2", F.col("r1"), 4096).select(*KEYS, "i", "r")))
    return out


def shared(heads: DataFrame, levels: list[DataFrame], bits: int, chars: int) -> DataFrame:
    """Rows (game, n, at, h): how many values the places of rank at - 1 and at share."""
    last = levels[-1]
    rows = last.select(*KEYS, (F.col("r") + 1).alias("at"), F.col("i").alias("a")).join(last.select(*KEYS, F.col("r").alias("at"), F.col("i").alias("b")), [*KEYS, "at"]).withColumn("h", F.lit(0).cast("long"))
    of = lambda df, side, name: df.select(*KEYS, F.col("i").alias(f"_{side}"), F.col(df.columns[-1]).alias(name))

    def both(df: DataFrame) -> DataFrame:
        out = rows
        for side in "ab":
            out = out.withColumn(f"_{side}", F.col(side) + F.col("h")).join(of(df, side, f"{side}_"), [*KEYS, f"_{side}"], "left").drop(f"_{side}")
        return out

    for k in reversed(range(len(levels) - 1)):
        rows = cut(both(levels[k]).withColumn("h", F.col("h") + F.when(F.col("a_") == F.col("b_"), chars << k).otherwise(0)).drop("a_", "b_"))
    byte = lambda c, j: F.shiftright(c, bits * (chars - 1 - j)).bitwiseAND(F.lit((1 << bits) - 1))
    more = F.lit(0)
    for j in reversed(range(chars)):  # 0 stands beyond the end and agrees with nothing
        more = F.when((byte("a_", j) == byte("b_", j)) & (byte("a_", j) > 0), more + 1).otherwise(0)
    return both(heads).select(*KEYS, "at", (F.col("h") + more).alias("h"))


def _intervals(at: np.ndarray, h: np.ndarray, left: np.ndarray, inner: bool) -> tuple[list, list]:
    """(intervals (u, v, places), open places (at, h, left)) of a stretch of the order; inner: only intervals with something smaller on both sides."""
    found, open_, stack = [], [], []
    for t, v, a in zip(at.tolist(), h.tolist(), left.tolist(), strict=True):
        while stack and stack[-1][1] > v:
            _, own, a = top = stack.pop()
            if inner and not stack:
                open_.append(top)
            else:
                found.append((max(v, stack[-1][1] if stack else 0), own, t - a + 1))
        if not stack or stack[-1][1] < v:
            stack.append((t, v, a))
    return found, open_ + stack


def repeats(series: DataFrame) -> DataFrame:
    """Rows (game, n, length, pairs): pairs of places whose stretches agree for at least `length` values, for each length that any pair has."""
    ship(series.sparkSession)
    made, (bits, chars) = packed(series)
    heads = cut(made)
    rows = shared(heads, ranks(heads, chars), bits, chars).withColumn("chunk", F.expr(f"at div {CHUNK}"))

    def table(group: pa.Table, found: list, open_: list) -> pa.Table:
        # a pair count from u + 1 on, and as many less from v + 1 on
        places = [(u + 1, s * (s - 1) // 2, None) for u, v, s in found] + [(v + 1, -(s * (s - 1) // 2), None) for u, v, s in found]
        every = places + [(t, v, a) for t, v, a in open_]
        one = lambda x, kind: pa.array([group.column(x)[0].as_py()] * len(every), kind)
        return pa.table([one("game", pa.string()), one("n", pa.int32()), *(pa.array([x[j] for x in every], pa.int64()) for j in range(3))], names=["game", "n", "at", "h", "a"])

    def inside(group: pa.Table) -> pa.Table:
        at, h = group.column("at").to_numpy(), group.column("h").to_numpy()
        order = np.argsort(at)
        return table(group, *_intervals(at[order], h[order], at[order], True))

    def across(group: pa.Table) -> pa.Table:
        at, h, a = (group.column(x).to_numpy() for x in ("at", "h", "a"))
        order = np.argsort(at)
        end = int(group.column("last")[0].as_py())
        found, _ = _intervals(np.append(at[order], end + 1), np.append(h[order], 0), np.append(a[order], end + 1), False)
        return table(group, [x for x in found if x[1] > 0], [])

    kind = "game string, n int, at long, h long, a long"
    first = cut(rows.groupBy(*KEYS, "chunk").applyInArrow(inside, kind))
    ends = F.broadcast(series.groupBy(*KEYS).agg(F.max("idx").alias("last")))  # one row for each series
    rest = first.where("a is not null").join(ends, KEYS).groupBy(*KEYS).applyInArrow(across, kind)
    steps = first.where("a is null").unionByName(rest).groupBy(*KEYS, F.col("at").alias("idx")).agg(F.sum("h").alias("step"))
    upto = running(steps, "game", {"pairs": F.col("step")}, by=("n",))
    # steps stand where the count changes; lengths between two of them have the count of the lower one
    ahead = upto.withColumn("next", F.lead("idx").over(Window.partitionBy(*KEYS).orderBy("idx")))  # a row for each length at most
    return ahead.where("pairs > 0").select(*KEYS, F.explode(F.sequence("idx", F.col("next") - 1)).alias("length"), "pairs")

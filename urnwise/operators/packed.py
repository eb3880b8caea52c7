"""Measures of a number's whole series, a byte for each draw: line entropy and divergence.

Tasks pack the counts of many draws (`surrogates._pieces`); a series meets as bytes in a
task of its own, so no row is a draw and number. A task's memory grows with the log, by
some fifty bytes for each draw of a game and eight for each doubling of the longest repeat.
`diagnostics` has both for series of any values and rows (game, n, idx, c).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnwise.cluster import cut, ship
from urnwise.operators import surrogates as U
from urnwise.operators.diagnostics import SAMPLE_LIMIT
from urnwise.operators.suffixes import _intervals

#: Values of a stretch that is ranked first; up to this length pairs are counted from runs of the order, longer ones from its intervals.
HEAD, RUNS = 8, 64
#: Points that are compared with all classes at once.
POINTS = 128


def each(rows: DataFrame, of: Callable[[np.ndarray], tuple | None], columns: str) -> DataFrame:
    """Rows (game, n, columns): of(series) of every number of rows (game, idx, codes) whose places are 0, 1, 2 and so on; None gives no row."""
    spark = rows.sparkSession
    ship(spark)
    sizes = {r["game"]: r["n"] for r in rows.groupBy("game").agg((F.max("idx") + 1).alias("n")).collect()}  # one for each game
    schema = f"game string, n int, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for game in batch.column("game").unique().to_pylist():
                own = batch.filter(pc.equal(batch.column("game"), game))
                yield U._pieces(game, 0, sizes[game], own.column("idx").to_numpy(), U._codes_of(own), 1)

    def measure(group: pa.Table) -> pa.Table:
        head, series = U._unpacked(group)
        made = of(series[:, 0])
        values = [] if made is None else [(head["game"], head["block"] + 1, *made)]
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        return pa.table([pa.array([v[j] for v in values], kinds[c.split()[1]]) for j, c in enumerate(schema.split(", "))], names=names)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a series' bytes say little about the work
    return rows.select("game", "idx", "codes").mapInArrow(pack, U.PIECE).repartition(tasks, "game", "block").groupBy("game", "block").applyInArrow(measure, schema)


def _dense(key: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    rank = np.zeros(len(key), np.int32)
    rank[order[1:]] = np.cumsum(key[1:] != key[:-1], dtype=np.int32)
    return rank


def shared(c: np.ndarray) -> np.ndarray:
    """How many values neighbours share in the order of the stretches that begin at each place (see `suffixes`)."""
    n = len(c)
    ended = np.zeros(n + HEAD, np.uint64)
    ended[:n] = c.astype(np.uint64) + np.uint64(1)  # 0 stands beyond the end
    head = np.zeros(n, np.uint64)
    for k in range(HEAD):
        head = head << np.uint64(8) | ended[k : n + k]
    levels = [_dense(head)]
    del head, ended
    while (top := int(levels[-1].max())) < n - 1:
        apart, rank = HEAD << (len(levels) - 1), levels[-1]
        key = rank.astype(np.int64) * (top + 2)
        key[: max(n - apart, 0)] += rank[apart:].astype(np.int64) + 1
        levels.append(_dense(key))
        del key
    order = np.empty(n, np.int32)
    order[levels[-1]] = np.arange(n, dtype=np.int32)
    a, b = order[:-1].copy(), order[1:].copy()

    def agree(values: np.ndarray) -> np.ndarray:
        inside = np.maximum(a, b) < n
        out = np.zeros(len(a), bool)
        out[inside] = values[a[inside]] == values[b[inside]]
        return out

    levels.pop()
    for k in reversed(range(len(levels))):
        step = agree(levels.pop()) * np.int32(HEAD << k)
        a += step
        b += step
    going = np.ones(len(a), bool)
    for _ in range(HEAD):
        going &= agree(c)
        a += going
        b += going
    return a - order[:-1]


def pair_steps(c: np.ndarray) -> dict[int, int]:
    """By length, how many more pairs of places agree for so many values than for one less (for 1: than none), where the number changes."""
    if len(c) < 2:
        return {}
    h = shared(c)
    steps: dict[int, int] = {}
    before, at = 0, np.flatnonzero(h > 0)
    for length in range(1, RUNS + 1):
        at = at[h[at] >= length]
        ends = np.flatnonzero(np.diff(at) > 1)
        run = np.diff(np.concatenate([[-1], ends, [len(at) - 1]])) if len(at) else np.zeros(0, np.int64)
        pairs = int((run * (run + 1) // 2).sum())
        steps[length] = pairs - before
        before = pairs
    at = at[h[at] > RUNS]
    if len(at):
        # an interval ends at the place after it, which shares no more than RUNS
        at = np.union1d(at, at + 1)
        own = np.append(h, 0)[at]
        found, _ = _intervals(at, np.where(own > RUNS, own, 0), at, False)
        for u, v, s in found:
            if v > RUNS:
                for length, pairs in ((max(u, RUNS) + 1, s * (s - 1) // 2), (v + 1, -(s * (s - 1) // 2))):
                    steps[length] = steps.get(length, 0) + pairs
    steps[RUNS + 1] = steps.get(RUNS + 1, 0) - before
    return {k: v for k, v in steps.items() if v}


def _lines(c: np.ndarray) -> tuple | None:
    values = c.astype(np.int64)
    n, total, squares = len(c), int(values.sum()), int((values * values).sum())
    steps = pair_steps(c)
    if not steps or not ((n * squares - total * total) ** 0.5 / n) * SAMPLE_LIMIT < 1:
        return None
    # lines of exactly k points are pairs of k + 2 values less twice those of k + 3, and those of k + 4
    exact: dict[int, int] = {}
    for length, s in steps.items():
        exact[length - 4] = exact.get(length - 4, 0) + s
        exact[length - 3] = exact.get(length - 3, 0) - s
    counts = np.array([v for k, v in sorted(exact.items()) if k >= 2 and v > 0], np.float64)
    if not len(counts):
        return None
    p = counts / counts.sum()
    return int(counts.sum()), max(max(steps) - 3, 0), float(-(p * np.log2(p)).sum())


def line_entropy(log: DataFrame) -> DataFrame:
    """`diagnostics.line_entropy` of `codes(log)`; series without lines have no row."""
    return each(cut(U.coded(log)), _lines, "lines long, longest long, ENTR double")


def exponent(c: np.ndarray, apart: int = 5, steps: int = 50, fitted: int = 20) -> float:
    """`diagnostics.divergence` of one series: all points whose values recur nowhere else against all classes of values."""
    e = np.lib.stride_tricks.sliding_window_view(c.astype(np.int64), 3)
    size, base = len(e), int(c.max()) + 1
    steps, at = min(size // 4, steps), np.arange(size)
    key = (e[:, 0] * base + e[:, 1]) * base + e[:, 2]
    first, last = np.full(base**3, -1), np.full(base**3, -1)
    last[key], first[key[::-1]] = at, at[::-1]
    rare = at[(at - first[key] <= apart) & (last[key] - at <= apart) & (at < size - steps)] if size >= 20 else at[:0]
    known = np.flatnonzero(last >= 0)
    other = np.stack([known // base**2, known // base % base, known % base], axis=1)
    first, last = first[known], last[known]
    total, count = np.zeros(steps), np.zeros(steps, np.int64)
    far = np.iinfo(np.int64).max
    for k in range(0, len(rare), POINTS):
        i = rare[k : k + POINTS, None]
        d = ((e[i] - other) ** 2).sum(axis=2)
        j = np.where(abs(i - first) > apart, first, np.where(abs(i - last) > apart, last, -1))
        best = np.where((d > 0) & (j >= 0), d << 40 | j, far).min(axis=1)  # the nearest, of these the earliest
        i, best = i[:, 0][best < far], best[best < far]
        j = best & (1 << 40) - 1
        for t in range(steps):
            inside = np.maximum(i, j) + t < size
            own = ((e[i[inside] + t] - e[j[inside] + t]) ** 2).sum(axis=1)
            own = own[own > 0]
            total[t] += np.log(own).sum() / 2
            count[t] += len(own)
    t = np.flatnonzero(count)[:fitted]
    if len(t) < 5:
        return 0.0
    y, x = total[t] / count[t], t - t.mean()
    return float((x * (y - y.mean())).sum() / (x * x).sum())


def divergence(log: DataFrame) -> DataFrame:
    """`diagnostics.divergence` of `codes(log)`."""
    return each(cut(U.coded(log)), lambda c: (exponent(c),) if len(c) > 2 else None, "lyapunov double")

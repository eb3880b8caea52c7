"""Shuffled copies of all series of a game by implicit permutations.

A copy's order is a seeded bijection of the places 0..n-1, worked out from the place
alone: a Feistel network on the places written as (left, right) with a x b >= n of
them, in whole-number arithmetic; a place that falls among the few beyond n walks on
until it is back (no more steps than there are such places). So no copy is sorted,
numbered or joined, and one bijection shuffles all numbers of a game.

What a copy is measured by are counts of equal stretches of three, four and five values
(`diagnostics` says why). A task gets a game's draws as words of bits and makes some copies
of all series itself (`log_counts`); for each, a table of all stretches of five is counted,
whose margins are those of four and three. So no row is a draw of a copy, and what moves
between tasks doesn't grow with the numbers. `copied_counts` does the same from rows with
values, whose placed bytes move; tests hold one against the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urnwise.cluster import cut, ship
from urnwise.games import GAMES
from urnwise.operators.blocks import Block, by_chunk, lists

#: The modulus and the multipliers of the rounds' function, and how many rounds there are.
PRIME, TIMES, SPREAD = 2147483647, 48271, (7919, 104729, 1299709)
ROUNDS = 6
#: Draws that a task places at once; numbers whose series go to one task; places of a series that are counted at once.
CHUNK, BLOCK, PART = 1 << 16, 5, 1 << 20


def coded(log: DataFrame, width: int = 30) -> DataFrame:
    """Rows (game, idx, codes) of draws from the first full window on, idx from 0: how many of the `width` draws before hold each number, in an array."""

    def code(block: Block) -> pa.Table:
        some = block.idx >= width
        own = pa.table({"game": block.rows.column("game").filter(pa.array(some)), "idx": block.idx[some] - width})
        return own.append_column("codes", lists(block.count(-width, 0)[some].astype(np.int8)))

    return by_chunk(log, [], width, 0, code, "game string, idx long, codes array<tinyint>")


def halves(n: int) -> tuple[int, int]:
    """(a, b), neither far from the root of n, with the least a b >= n."""
    root = max(1, math.isqrt(n))
    a = min(range(max(1, root // 4), root + 1), key=lambda a: (-n % a, -a))
    return a, -(-n // a)


def _round_key(copy: Column, r: int, seed: int) -> Column:
    t = (copy.cast("long") * SPREAD[0] + r * SPREAD[1] + seed * SPREAD[2]) % PRIME
    return (t * t + TIMES) % PRIME


def _mixed(x: Column, key: Column) -> Column:
    u = (x * TIMES + key) % PRIME
    v = (u * u + key) % PRIME
    return (v * v + u) % PRIME


def _turned(df: DataFrame, seed: int) -> DataFrame:
    """df with p moved by one pass of the network on (a, b); p >= size moves on, smaller ones stay after the first pass."""
    df = df.withColumn("_l", F.expr("p div b")).withColumn("_r", F.col("p") % F.col("b"))
    for r in range(ROUNDS):
        side, other, size = ("_l", "_r", "a") if r % 2 == 0 else ("_r", "_l", "b")
        df = df.withColumn(side, (F.col(side) + _mixed(F.col(other), F.col(f"_k{r}"))) % F.col(size))
    return df.withColumn("_p", F.col("_l") * F.col("b") + F.col("_r"))


def permuted(rows: DataFrame, copies: int, seed: int) -> DataFrame:
    """rows (game, idx, ..) once for each copy, with `copy`, the place `p` in it and the points of the series (`size`); copy 0 is the order as it is."""
    sizes = [(r["game"], r["n"], *halves(r["n"])) for r in rows.groupBy("game").agg((F.max("idx") + 1).alias("n")).collect()]  # one for each game
    beyond = max((a * b - n for _, n, a, b in sizes), default=0)
    known = F.broadcast(rows.sparkSession.createDataFrame(sizes, "game string, size long, a long, b long"))
    out = rows.join(known, "game").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies)))).withColumn("p", F.col("idx"))
    out = out.withColumns({f"_k{r}": _round_key(F.col("copy"), r, seed) for r in range(ROUNDS)})
    out = _turned(out, seed).withColumn("p", F.when(F.col("copy") == 0, F.col("idx")).otherwise(F.col("_p")))
    for _ in range(beyond):
        out = _turned(out, seed).withColumn("p", F.when(F.col("p") >= F.col("size"), F.col("_p")).otherwise(F.col("p")))
    return out.select(*rows.columns, "copy", "p", "size")


KINDS = (3, 4, 5)
SUMS = ("n3", "n4", "n5", "vertical", *(f"o{i}" for i in range(8)), "m2", "m3", "s1", "s2")


def _pairs(counts: np.ndarray) -> int:
    counts = counts.ravel()
    return (int(np.dot(counts, counts)) - int(counts.sum())) // 2


def _runs(ordered: np.ndarray) -> np.ndarray:
    return np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))


def _summed(c: np.ndarray) -> list[int]:
    """SUMS of one series of small whole numbers; m2 and m3 leave out the last stretch, which nothing follows."""
    c = c.astype(np.uint8)
    c -= c.min()
    n, b = len(c), int(c.max()) + 1
    base = b + 1  # b stands beyond the end, so stretches that reach there are each alone
    ended = np.concatenate([c, np.full(4, b, np.uint8)])
    kind = np.int32 if base**5 < 1 << 31 else np.int64

    def stretch(first: int, last: int) -> np.ndarray:
        value = ended[first : last + 4].astype(kind)
        two = value[:-1] * kind(base) + value[1:]
        four = two[:-2] * kind(base**2) + two[2:]
        return four[:-1] * kind(base) + value[4:]

    same = np.arange(b)
    alike = same * (base**3 + base**2 + base + 1)  # four equal values
    if base**5 <= max(8 * n, 1 << 16):
        part = max(PART, base**5)  # no table is added more often than it has places
        five = np.zeros(base**5, np.int64)
        for first in range(0, n, part):
            five += np.bincount(stretch(first, min(n, first + part)), minlength=base**5)
        four = five.reshape(-1, base).sum(axis=1)
        three, n4, n5 = four.reshape(-1, base).sum(axis=1), _pairs(four), _pairs(five)
        equal4, equal5 = four[alike], five[alike * base + same]
    else:
        value = np.concatenate([stretch(first, min(n, first + PART)) for first in range(0, n, PART)])
        value.sort()
        n5, n4 = _pairs(_runs(value)), _pairs(_runs(value // base))
        three = np.bincount(value // base**2, minlength=base**3)
        held = lambda low, high: np.searchsorted(value, high) - np.searchsorted(value, low)
        equal4, equal5 = held(alike * base, (alike + 1) * base), held(alike * base + same, alike * base + same + 1)
    cube = three.reshape(base, base, base)[:b, :b, :b]
    # equal neighbours among points of three are runs of four equal values or more: a run of k has k - 3 stretches of four and k - 4 of five
    vertical = int((cube[same, same, same] * (2 * equal4 - equal5)).sum() - (4 * equal4 - 3 * equal5).sum())
    x, y, z = np.ogrid[:b, :b, :b]
    pattern = (x <= y) + 2 * (y <= z).astype(np.int64) + 4 * (x <= z)
    order = [int(cube[pattern == k].sum()) for k in range(8)]
    followed = cube.copy()
    if n > 2:
        followed[tuple(c[-3:])] -= 1
    held = three.reshape(base, -1).sum(axis=1)[:b]
    return [_pairs(cube), n4, n5, vertical, *order, _pairs(cube.sum(axis=2)), _pairs(followed), int((held * same).sum()), int((held * same * same).sum())]


def _moved(idx: np.ndarray, copy: int, seed: int, size: int, a: int, b: int) -> np.ndarray:
    """The places of a copy, as `permuted` has them."""
    if copy == 0:
        return idx
    keys = []
    for r in range(ROUNDS):
        t = (copy * SPREAD[0] + r * SPREAD[1] + seed * SPREAD[2]) % PRIME
        keys.append((t * t + TIMES) % PRIME)

    def turned(p: np.ndarray) -> np.ndarray:
        sides, sizes = [p // b, p % b], (a, b)
        for r, key in enumerate(keys):
            own, other = r % 2, 1 - r % 2
            u = (sides[other] * TIMES + key) % PRIME
            v = (u * u + key) % PRIME
            sides[own] = (sides[own] + (v * v + u) % PRIME) % sizes[own]
        return sides[0] * b + sides[1]

    p = turned(idx)
    while len(beyond := np.flatnonzero(p >= size)):
        p[beyond] = turned(p[beyond])
    return p


COUNTS = "game string, n int, copy int, size long, " + ", ".join(f"{x} long" for x in SUMS)
PIECE = "game string, copy int, block int, size long, width int, first long, steps binary, codes binary"


def _pieces(game: str, copy: int, size: int, p: np.ndarray, codes: np.ndarray, width: int = BLOCK) -> pa.RecordBatch:
    """Draws of one copy, in order of their places: a row for each block of numbers, with the steps between places and the values, a byte each."""
    order = np.argsort(p, kind="stable")
    p, codes = p[order], codes[order]
    steps = np.diff(p, prepend=p[:1])
    steps = steps.astype(np.uint16 if len(p) < 2 or steps.max() < 1 << 16 else np.uint32).tobytes()
    blocks = range(0, codes.shape[1], width)
    one = lambda x, kind: pa.array([x] * len(blocks), kind)
    return pa.RecordBatch.from_arrays(
        [one(game, pa.string()), one(copy, pa.int32()), pa.array([k // width for k in blocks], pa.int32()), one(size, pa.int64()), pa.array([min(width, codes.shape[1] - k) for k in blocks], pa.int32()),
         one(int(p[0]), pa.int64()), one(steps, pa.binary()), pa.array([codes[:, k : k + width].tobytes() for k in blocks], pa.binary())],
        names=["game", "copy", "block", "size", "width", "first", "steps", "codes"],
    )


def _codes_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("codes").flatten().to_numpy().astype(np.uint8).reshape(batch.num_rows, -1)


def _unpacked(group: pa.Table) -> tuple[dict, np.ndarray]:
    """(keys of PIECEs that make up one block of numbers, a column for each of its series)."""
    head = {x: group.column(x)[0].as_py() for x in ("game", "copy", "block", "size", "width")}
    series = np.zeros((head["size"], head["width"]), np.uint8)
    for batch in group.select(["first", "steps", "codes"]).to_batches():
        for first, steps, codes in zip(*batch.columns, strict=True):
            values = np.frombuffer(codes.as_buffer(), np.uint8).reshape(-1, head["width"])
            steps = np.frombuffer(steps.as_buffer(), np.uint16 if len(steps.as_buffer()) == 2 * len(values) else np.uint32)
            series[first.as_py() + np.cumsum(steps, dtype=np.int64)] = values
    return head, series


def _counted(pieces: DataFrame) -> DataFrame:
    """Rows (game, n, copy, size, SUMS) of PIECEs: a task has a few numbers of one copy, a byte for each draw and number."""

    def count(group: pa.Table) -> pa.Table:
        head, series = _unpacked(group)
        sums = [_summed(series[:, j]) for j in range(head["width"])]
        one = lambda x, kind: pa.array([head[x]] * len(sums), kind)
        n = head["block"] * BLOCK + 1 + np.arange(len(sums), dtype=np.int32)
        return pa.table([one("game", pa.string()), pa.array(n), one("copy", pa.int32()), one("size", pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*sums, strict=True))], names=["game", "n", "copy", "size", *SUMS])

    return pieces.groupBy("game", "copy", "block").applyInArrow(count, COUNTS)


def stretch_counts(placed: DataFrame, chunk: int | None = None) -> DataFrame:
    """Rows (game, n, copy, size, SUMS) of rows (game, copy, p, size, codes): pairs of equal stretches of 3, 4, 5 values, points beside vertical lines, how many points have each order of three values, pairs of 2 and 3 values that another follows, and sums of values above the least and of their squares.

    chunk: rows of one batch that are packed at once.
    """
    ship(placed.sparkSession)
    chunk = chunk or CHUNK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, chunk) for k in range(0, whole.num_rows, chunk)):
                keys = pa.table({"game": batch.column("game"), "copy": batch.column("copy")}).group_by(["game", "copy"]).aggregate([]).to_pylist()
                for key in keys:
                    own = batch.filter(pc.and_(pc.equal(batch.column("game"), key["game"]), pc.equal(batch.column("copy"), key["copy"])))
                    yield _pieces(key["game"], key["copy"], own.column("size")[0].as_py(), own.column("p").to_numpy().astype(np.int64), _codes_of(own))

    return _counted(placed.select("game", F.col("copy").cast("int").alias("copy"), F.col("p").cast("long").alias("p"), F.col("size").cast("long").alias("size"), "codes").mapInArrow(pack, PIECE))


def copied_counts(rows: DataFrame, copies: int, seed: int) -> DataFrame:
    """stretch_counts(permuted(rows, copies, seed)) without a row for each draw and copy: tasks place CHUNK draws at a time in all copies and hand on packed bytes."""
    ship(rows.sparkSession)
    sizes = {r["game"]: (r["n"], *halves(r["n"])) for r in rows.groupBy("game").agg((F.max("idx") + 1).alias("n")).collect()}  # one for each game

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def packed(game: str) -> Iterator[pa.RecordBatch]:
            idx, codes = (np.concatenate(x) for x in zip(*held.pop(game), strict=True))
            for copy in range(copies + 1):
                yield _pieces(game, copy, sizes[game][0], _moved(idx, copy, seed, *sizes[game]), codes)

        for batch in batches:
            for game in batch.column("game").unique().to_pylist():
                own = batch.filter(pc.equal(batch.column("game"), game))
                held.setdefault(game, []).append((own.column("idx").to_numpy().astype(np.int64), _codes_of(own)))
                if sum(len(i) for i, _ in held[game]) >= CHUNK:
                    yield from packed(game)
        for game in list(held):
            yield from packed(game)

    return _counted(rows.select("game", "idx", "codes").mapInArrow(place, PIECE))


#: The eight numbers of each value of a byte of bits, a byte for each.
SPREAD_BITS = (np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).view(np.uint64).ravel()
#: Copies that a task makes.
SHARE = 4


def log_counts(log: DataFrame, copies: int, seed: int, width: int = 30) -> DataFrame:
    """copied_counts(coded(log, width), copies, seed) from the draws' bits: what moves is eight bytes of a draw for each SHARE copies.

    A task places the series of some copies itself, eight numbers at once, and counts them one by
    one; it holds some sixty bytes for each draw of a game.
    """
    spark = log.sparkSession
    ship(spark)
    sizes = {r["game"]: (r["n"], *halves(r["n"])) for r in log.groupBy("game").agg((F.max("idx") + 1 - width).alias("n")).where("n > 0").collect()}  # one for each game
    bytes_of = {g: range(GAMES[g].m // 8 + 1) for g in sizes}
    # few copies are dealt by numbers as well
    parts = {g: [(k, list(x)) for k in range(0, copies + 1, SHARE) for x in ([[j] for j in bytes_of[g]] if copies < SHARE else [bytes_of[g]])] for g in sizes}

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        return pa.table({"game": group.column("game")[:1], "chunk": group.column("chunk")[:1], "bits": pa.array([group.column("mask").to_numpy().tobytes()], pa.binary())})

    def count(game: str, part: int, bits: np.ndarray) -> pa.RecordBatch:
        size, m, (first, own) = sizes[game], GAMES[game].m, parts[game][part]
        made: list[tuple] = []
        for copy in range(first, min(first + SHARE, copies + 1)):
            places = np.empty(size[0] if copy else 0, np.int32 if size[0] < 1 << 31 else np.int64)
            for k in range(0, len(places), CHUNK):
                places[k : k + CHUNK] = _moved(np.arange(k, min(k + CHUNK, size[0])), copy, seed, *size)
            for j in own:
                codes = np.empty(size[0], np.uint64)
                for k in range(0, size[0], CHUNK):
                    some = bits[k : k + CHUNK + width, j]  # draw i's count is over the `width` rows from i on, as idx begins at the first full window
                    sums = np.zeros(len(some) + 1, np.uint64)
                    np.cumsum(SPREAD_BITS[some], out=sums[1:])
                    value = (sums[width:] - sums[:-width])[: min(CHUNK, size[0] - k)]  # no count exceeds a byte
                    codes[places[k : k + CHUNK] if copy else slice(k, k + CHUNK)] = value
                columns = codes.view(np.uint8).reshape(-1, 8)
                made += [(8 * j + k, copy, *_summed(columns[:, k])) for k in range(8) if 1 <= 8 * j + k <= m]
        n, of, *values = zip(*made, strict=True)
        one = lambda x, kind: pa.array([x] * len(made), kind)
        return pa.RecordBatch.from_arrays([one(game, pa.string()), pa.array(n, pa.int32()), pa.array(of, pa.int32()), one(size[0], pa.int64()), *(pa.array(x, pa.int64()) for x in values)], names=["game", "n", "copy", "size", *SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}  # mostly of one part
        for batch in batches:
            for game, chunk, part, bits in zip(*(batch.column(c) for c in ("game", "chunk", "part", "bits")), strict=True):
                key, bits, at = (game.as_py(), part.as_py()), np.frombuffer(bits.as_buffer(), np.uint8).reshape(-1, 8), chunk.as_py() * CHUNK
                if key not in held:
                    held[key] = np.zeros((sizes[key[0]][0] + width, 8), np.uint8)
                held[key][at : at + len(bits)] = bits
        for key in sorted(held):
            yield count(*key, held.pop(key))

    if not sizes:
        return spark.createDataFrame([], COUNTS)
    packed = log.where(F.col("game").isin(list(sizes))).select("game", F.col("idx").cast("long").alias("idx"), "mask", F.expr(f"idx div {CHUNK}").alias("chunk"))
    packed = cut(packed.groupBy("game", "chunk").applyInArrow(pack, "game string, chunk long, bits binary"))
    each = reduce(lambda a, b: a.when(F.col("game") == b, F.lit(len(parts[b]))), sizes, F).otherwise(F.lit(0))
    dealt = packed.withColumn("part", F.explode(F.sequence(F.lit(0), each - 1)))
    tasks = sum(map(len, parts.values()))  # each is work for a task
    slot = sum((F.when(F.col("game") == g, F.col("part") + sum(len(parts[x]) for x in list(sizes)[:i])).otherwise(0) for i, g in enumerate(sizes)), F.lit(0))
    return dealt.repartitionById(tasks, slot.cast("int")).mapInArrow(run, COUNTS)


def own_measures(log: DataFrame, width: int = 30) -> DataFrame:
    """Rows (game, n, points, entropy, RR, DET, LAM, sample_entropy) of every number's series: `diagnostics.recurrence` and `sample_entropy` of `codes(log, width)`, from packed series."""
    return own_of(_measured(log, 0, 0, width))


def own_of(rows: DataFrame) -> DataFrame:
    """The series themselves among rows of `all_measures`."""
    return rows.where("copy = 0").select("game", "n", F.col("size").alias("points"), F.col("PE").alias("entropy"), "RR", "DET", "LAM", "sample_entropy")


def measures(log: DataFrame, copies: int, seed: int, width: int = 30) -> DataFrame:
    """Rows (game, n, copy, PE, DET, LAM, RR) of every number's series (copy 0) and its copies; recurrence is null where its limit reaches a step of the grid."""
    return _measured(log, copies, seed, width).select("game", "n", "copy", "PE", "DET", "LAM", "RR")


def all_measures(log: DataFrame, copies: int, seed: int, width: int = 30) -> DataFrame:
    """Rows of `measures`, also with size, RR and sample entropy, written once."""
    return cut(_measured(log, copies, seed, width))


def _measured(log: DataFrame, copies: int, seed: int, width: int) -> DataFrame:
    from urnwise.operators.diagnostics import RECURRENCE_LIMIT, SAMPLE_LIMIT

    counts = log_counts(log, copies, seed, width)
    spread = F.sqrt((F.col("size") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double")) / F.col("size")
    counts = counts.withColumn("fine", spread * max(SAMPLE_LIMIT, RECURRENCE_LIMIT) < 1)  # both limits are less than one step
    total = sum((F.col(f"o{i}") for i in range(8)), F.lit(0))
    entropy = -sum((F.when(F.col(f"o{i}") > 0, F.col(f"o{i}") / total * F.log2(F.col(f"o{i}") / total)).otherwise(0.0) for i in range(8)), F.lit(0.0)) / math.log2(6)
    of = lambda x: F.when(F.col("fine"), F.when(F.col("n3") > 0, x).otherwise(0.0))
    e = F.col("size") - 2
    sample = F.when(F.col("fine") & (F.col("m2") > 0) & (F.col("m3") > 0), -F.log(F.col("m3") / F.col("m2")))
    return counts.select("game", "n", "copy", "size", sample.alias("sample_entropy"), entropy.alias("PE"), of((2 * F.col("n4") - F.col("n5")) / F.col("n3")).alias("DET"), of(F.col("vertical") / (2 * F.col("n3"))).alias("LAM"), of(2 * F.col("n3") / (e * (e - 1))).alias("RR"))


def bounds(rows: DataFrame) -> DataFrame:
    """Per series and measure: the real value, the 2.5 and 97.5 percentiles of the copies, and whether it lies outside."""
    each = rows.select("game", "n", "copy", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("PE", "DET", "LAM")))).alias("x")).select("game", "n", "copy", "x.*")
    copy = F.when(F.col("copy") > 0, F.col("v"))
    out = each.groupBy("game", "n", "measure").agg(F.max(F.when(F.col("copy") == 0, F.col("v"))).alias("real"), F.percentile(copy, 0.025).alias("low"), F.percentile(copy, 0.975).alias("high"))
    return out.withColumn("outside", (F.col("real") < F.col("low")) | (F.col("real") > F.col("high")))


def z_scores(rows: DataFrame) -> DataFrame:
    """Per series: permutation entropy, its mean and deviation over the copies, z and significance."""
    copy = F.when(F.col("copy") > 0, F.col("PE"))
    per = rows.groupBy("game", "n").agg(F.max(F.when(F.col("copy") == 0, F.col("PE"))).alias("pe"), F.avg(copy).alias("pe_mean"), F.stddev_pop(copy).alias("pe_std"))
    z = F.when(F.col("pe_std") > 0, (F.col("pe") - F.col("pe_mean")) / F.col("pe_std")).otherwise(0.0)
    return per.withColumn("z", z).withColumn("significant", F.abs("z") > 1.96)

"""Repair of conversations by a retained-subsequence dynamic program.

A conversation is to read as an optional system turn and user-assistant pairs. Turns
are kept (0), given the role user or assistant (REROLE) or deleted (DELETE; blank turns
and repeated ones must be), and empty turns are inserted (INSERT); a truncated turn
that stays costs TRUNCATED. The program chooses the turns that are retained, kept or
with a new role. The deletions between two retained turns are a difference of prefix
sums, so for each role of the last retained turn one running minimum of cost less
prefix sum prices all gaps; the pair of roles tells how many turns go in between. Of
equal costs the edits' initials (D, I, K, R) that come first in ASCII win: deletions of
a gap stand before its insertions, and two ways that have used the same turns and end
with a retained one are never prefixes of each other, so the lesser of two stays the
lesser whatever follows.

Turns are numbered in order and dealt into blocks of BLOCK. A block gives the least
cost and edits from each role that may come before it to each that may follow; the
blocks of a conversation are then combined in order. So a conversation of any length is
as many tasks as it has blocks; only its edits as one string, which are a value of the
result, and the digest of its repaired text, which is a chain by its nature and is
streamed, are made in one place.

Defined results: null role, text, key or turn counts as one space where it is read as
text; rows of a null conv_id are one conversation; rows of equal turn stand in order of
the digest of role and text; a conversation without rows has no edits, cost 0 and an
empty repaired text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pieces, runs, small_batches, table
from .order import placed
from .prefix_trie import digest

BLOCK = 2048
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
ENDS = ".!?"
SPACES = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, CUT_OFF = range(4)
#: Roles that may follow each other without an insertion.
LEGAL = {"su", "ua", "au"}
#: Turns to insert between two roles ("": nothing before, or the end after).
BETWEEN = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "u"): 1, ("u", "a"): 0, ("a", "u"): 0, ("a", "a"): 1, ("", ""): 0, ("s", ""): 2, ("u", ""): 1, ("a", ""): 0}
NAMES = {"u": "user", "a": "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32(conv_id:turn) % 20: 0 no row, 1 no text, 2 no sentence ends, 3 the row twice, 4 role user."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    text = F.when(act == 1, "").when(act == 2, F.translate(as_text("text"), ENDS, "")).otherwise(as_text("text"))
    rows = conversations.where(act != 0).select("conv_id", "turn", F.when(act == 4, "user").otherwise(as_text("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(act == 3, 2).otherwise(1))))
    return rows.drop("col")


def solve(initials: list[str], faults: list[int], before: list[str]) -> dict[tuple[str, str], tuple[int, str]]:
    """{(role before, role of the last retained turn): (cost, edits)} of one block, the cheapest and of these the first."""
    n, out = len(initials), {}
    for start in before:
        # role: (cost less the prefix sum of deletions, edits, turns used): the running minimum
        best = {start: (0, "", 0)}
        for j, (own, fault) in enumerate(zip(initials, faults, strict=True)):
            if fault in (BLANK, DUPLICATE):
                continue
            new = {}
            for role in "sua":
                if own == role:
                    price, letter = 0, "K"
                elif role == "s":
                    continue
                else:
                    price, letter = REROLE, "R"
                price += TRUNCATED * (fault == CUT_OFF)
                for last, (cost, edits, used) in best.items():
                    gap = BETWEEN.get((last, role))
                    if gap is None:
                        continue
                    total = cost + DELETE * j + INSERT * gap + price
                    if role in new and total > new[role][0]:
                        continue
                    way = (total, edits + "D" * (j - used) + "I" * gap + letter)
                    new[role] = min(new.get(role, way), way)
            for role, (total, edits) in new.items():
                way = (total - DELETE * (j + 1), edits, j + 1)
                held = best.get(role)
                if held is None or way[0] < held[0] or way[0] == held[0] and edits < held[1] + "D" * (j + 1 - held[2]):
                    best[role] = way
        out |= {(start, last): (cost + DELETE * n, edits + "D" * (n - used)) for last, (cost, edits, used) in best.items()}
    return out


def follow(ways: dict[str, tuple[int, list[str], list[str]]], block: dict[tuple[str, str], tuple[int, str]]) -> dict[str, tuple[int, list[str], list[str]]]:
    """ways {last role: (cost, edits of each block, role before each block)} with one more block."""
    out: dict = {}
    for (before, last), (cost, edits) in block.items():
        if before in ways:
            done, parts, roles = ways[before]
            way = (done + cost, [*parts, edits], [*roles, before])
            held = out.get(last)
            if held is None or way[0] < held[0] or way[0] == held[0] and "".join(way[1]) < "".join(held[1]):
                out[last] = way
    return out


def ended(ways: dict[str, tuple[int, list[str], list[str]]]) -> tuple[int, list[str], list[str]]:
    """The best of ways with the turns that end it."""
    ends = [(cost + INSERT * BETWEEN[last, ""], [*parts[:-1], parts[-1] + "I" * BETWEEN[last, ""]], roles) for last, (cost, parts, roles) in ways.items()]
    return min(ends, key=lambda x: (x[0], "".join(x[1])))


def walk(rows: Iterator, edits: str, last: str) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of the repaired turns of a block: rows (role, text) under its edits, after the role `last`."""
    for edit in edits:
        wanted = "a" if last == "u" else "u"
        if edit == "I":
            yield edit, NAMES[wanted], ""
            last = wanted
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        yield edit, role if edit == "K" else NAMES[wanted], text
        last = role[:1] if edit == "K" else wanted


def turns(rows: DataFrame) -> DataFrame:
    """(c, pos, turn, role, text, initial, fault), written: rows (conv_id, turn, role, text) in order, with each one's first fault."""
    plain = rows.select(F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(x, F.lit(" ")).alias(x) for x in ("role", "text")))
    order = cut(placed(plain.withColumn("digest", digest(F.col("role"), F.col("text"))), ["turn", "digest"], "pos"))
    first = order.groupBy("c", "digest").agg(F.min("pos").alias("pos")).select(F.col("c").alias("_c"), F.col("pos").alias("_pos"))
    kept = F.rtrim("text", F.lit(SPACES))
    fault = F.when(kept == "", BLANK).when(F.col("_pos").isNull(), DUPLICATE).when(~F.right(kept, F.lit(1)).isin(*ENDS), CUT_OFF).otherwise(OK)
    joined = order.join(first, F.col("c").eqNullSafe(F.col("_c")) & (F.col("pos") == F.col("_pos")), "left")
    return joined.select("c", "pos", "turn", "role", "text", F.left("role", F.lit(1)).alias("initial"), fault.cast("int").alias("fault"))


def _block() -> Column:
    return F.expr(f"pos div {BLOCK}").alias("block")


def plans(rows: DataFrame) -> DataFrame:
    """(c, cost, illegal, edits, befores) of turns: the cheapest edits of each conversation, block by block, and the role before each block."""
    small_batches(rows.sparkSession)
    blocks = rows.select("c", _block(), F.xxhash64("c", _block()).alias("task"), "pos", "initial", "fault")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["c", "block"]):
            initials, faults = group.column("initial").to_pylist(), group.column("fault").to_pylist()
            block = group.column("block")[0].as_py()
            ways = solve(initials, faults, [""] if block == 0 else ["", "s", "u", "a"])
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            yield [group.column("c")[0].as_py(), block, initials[0], initials[-1], illegal, [{"before": a, "last": b, "cost": x[0], "edits": x[1]} for (a, b), x in ways.items()]]

    kind = pa.list_(pa.struct([("before", pa.string()), ("last", pa.string()), ("cost", pa.int64()), ("edits", pa.string())]))
    schema = pa.schema([("c", pa.int64()), ("block", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64()), ("ways", kind)])
    solved = blocks.repartition("task").sortWithinPartitions("c", "block", "pos").mapInArrow(_rows(one, schema), "c long, block long, head string, tail string, illegal long, ways array<struct<before: string, last: string, cost: long, edits: string>>")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["c"]):
            ways, illegal, tail = {"": (0, [], [])}, 0, None
            for row in group.to_pylist():
                ways = follow(ways, {(x["before"], x["last"]): (x["cost"], x["edits"]) for x in row["ways"]})
                illegal += row["illegal"] + (tail is not None and tail + row["head"] not in LEGAL)
                tail = row["tail"]
            cost, parts, befores = ended(ways)
            yield [group.column("c")[0].as_py(), cost, illegal, parts, befores]

    texts = pa.list_(pa.string())
    schema = pa.schema([("c", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()), ("edits", texts), ("befores", texts)])
    return cut(solved.repartition("c").sortWithinPartitions("c", "block").mapInArrow(_rows(whole, schema), "c long, cost long, illegal long, edits array<string>, befores array<string>"))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """`runs` by several whole-number keys, null among them."""

    def numbered() -> Iterator[pa.RecordBatch]:
        last, number = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [x for k in keys for x in (batch.column(k).fill_null(0).to_numpy(zero_copy_only=False), batch.column(k).is_valid().to_numpy(zero_copy_only=False))]
            table_ = np.stack([x.astype(np.int64) for x in columns])
            new = np.concatenate([[last is None or (table_[:, 0] != last).any()], (table_[:, 1:] != table_[:, :-1]).any(axis=0)])
            ids = number + np.cumsum(new)
            last, number = table_[:, -1], int(ids[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], names=[*batch.schema.names, "_run"])

    return runs(numbered(), "_run")


def _rows(make, schema: pa.Schema, many: int = 512):
    """A function for mapInArrow from one that yields rows as lists; batches of at most so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for row in make(batches):
            held.append(row)
            if len(held) == many:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


def _walked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(c, block, pos, role, text) of turns, and before each block's turns, at pos -1, its edits (as text) and the role before (as role)."""
    at = found.select("c", F.posexplode(F.arrays_zip("edits", "befores")).alias("block", "x")).select("c", F.col("block").cast("long").alias("block"), F.lit(-1).cast("long").alias("pos"), F.col("x.befores").alias("role"), F.col("x.edits").alias("text"))
    return rows.select("c", _block(), "pos", "role", "text").unionByName(at)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, Iterator]]:
    """(c, block, repaired turns) of sorted rows of `_walked`, one block after the other; each must be used up before the next."""
    stream = ((c, b, p, role, text) for batch in batches for part in pieces(iter([batch]), "text") for c, b, p, role, text in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True))
    for c, block, _, before, edits in stream:  # each step begins at pos -1
        yield c, block, walk(((role, text) for _, _, _, role, text in stream), edits, before)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, block, place, edit, role, text): the repaired conversations, in order of block and place; edit: K, R or I."""
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        for c, block, steps in _steps(batches):
            for place, (edit, role, text) in enumerate(steps):
                yield [c, block, place, edit, role, text]

    both = _walked(rows, found)
    return both.repartition("c", "block").sortWithinPartitions("c", "block", "pos").mapInArrow(_rows(run, schema, 16), "conv_id long, block long, place long, edit string, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(c, repaired_sha256): the hash of each repaired conversation's `role:text`, newline-joined, streamed."""
    schema = pa.schema([("c", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches):
        last, sha, some = None, None, False
        for c, _, steps in _steps(batches):
            if sha is None or c != last:
                if sha is not None:
                    yield [last, sha.hexdigest()]
                last, sha, some = c, hashlib.sha256(), False
            for _, role, text in steps:
                sha.update((("\n" if some else "") + role + ":" + text).encode())
                some = True
        if sha is not None:
            yield [last, sha.hexdigest()]

    return _walked(rows, found).repartition("c").sortWithinPartitions("c", "block", "pos").mapInArrow(_rows(run, schema), "c long, repaired_sha256 string")


def faults(rows: DataFrame) -> DataFrame:
    """(c, gaps, blank, duplicate, truncated) of turns."""
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return rows.groupBy("c").agg(F.coalesce(spread, F.lit(0)).alias("gaps"), *(F.count_if(F.col("fault") == code).alias(x) for x, code in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT_OFF))))


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one for each of ids (conv_id), of rows (conv_id, turn, role, text)."""
    own = cut(turns(rows))
    found = plans(own)
    out = ids.select(F.col("conv_id").alias("id")).distinct()
    by = lambda df: df.withColumnRenamed("c", "_c")
    for part in (faults(own), found.select("c", "illegal", "cost", F.array_join("edits", "").alias("audit")), digests(own, found)):
        out = out.join(by(part), F.col("id").eqNullSafe(F.col("_c")), "left").drop("_c")
    none = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias("conv_id"), *(F.coalesce(x, none).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after damage."""
    conversations = table(spark, sf_dir, "conversations")
    return report(damaged(conversations), conversations.select("conv_id"))

"""Shared plumbing of the corpus operators: tables, lineage cuts, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnwise.cluster import cut, discard, shared_dir, ship  # noqa: F401

#: Bytes of text that one step of a Python stage works on (one document at least).
CHUNK_BYTES = 2 << 20
#: Bytes of rows in one Arrow batch (one row at least).
BATCH_BYTES = 1 << 20
#: Rows of a table that may be broadcast after its rows have been counted (8 to 40 bytes each).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Before Python stages: this package on the workers, and at most BATCH_BYTES of rows in an Arrow batch.

    Results run when their caller asks for them, so the session keeps that setting; it
    bounds memory and changes no result.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A cut for one side of a join: broadcast if its counted rows allow, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


@lru_cache(maxsize=2)
def byte_level(ranks: str):
    """The tokenizer of a file of byte-level ranks, one copy in each Python worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def fresh(name: str, taken: list[str]) -> str:
    """name, with as many `_` behind it as no column of that name needs."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the strings of column stay near CHUNK_BYTES (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin, total = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > CHUNK_BYTES:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield batch.slice(begin)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of rows with equal key from batches that are sorted by it; holds one group at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        column = rows.column(key).combine_chunks()
        change = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False).nonzero()[0] + 1
        bounds = [0, *change.tolist(), rows.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            now = column[a].as_py()
            if held and now != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(rows.slice(a, b - a))
            last = now
    if held:
        yield pa.concat_tables(held).combine_chunks()


def by_key(df: DataFrame, key: str, body: Callable, schema: str) -> DataFrame:
    """body(group as Arrow table) -> RecordBatch, for each value of key; groups must be bounded by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, key):
            out = body(group)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v: long) as rows (node, component = smallest node reachable).

    Hooking to the smallest neighbouring root and pointer jumping, each a join or a
    pre-aggregated minimum, so a node with very many neighbours is no single group;
    every round is written to the shared folder and ends when no parent changes.
    Null ends and loops are ignored; an empty input gives no rows.
    """
    e = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    e = cut(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    p = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("parent"))
    p = cut(p)
    while True:
        near = e.join(p.select(F.col("node").alias("v"), F.col("parent").alias("root")), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("m"))
        seen = p.join(near, "node")
        hooks = seen.select("node", F.least("parent", "m").alias("parent")).union(seen.select(F.col("parent").alias("node"), F.least("parent", "m").alias("parent")))
        hooked = cut(hooks.groupBy("node").agg(F.min("parent").alias("parent")))
        jumped = hooked.join(hooked.select(F.col("node").alias("parent"), F.col("parent").alias("up")), "parent", "left").select("node", F.coalesce(F.least("up", "parent"), "parent").alias("parent"))
        new = cut(jumped)
        moved = new.join(p.withColumnRenamed("parent", "old"), "node").where("old <> parent").limit(1).count()
        discard(p, hooked)
        p = new
        if not moved:
            discard(e)
            return p.select("node", F.col("parent").alias("component"))

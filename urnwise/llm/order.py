"""Places of rows inside their groups, and dense names of distinct rows, without a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches


def _own_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches with the task's number and each row's place among the task's rows of its first column's value."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, seen = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, there = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (there[1:] != there[:-1])])
        first = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        if last == (key[0], there[0]):
            place[: first[1] if len(first) > 1 else n] += seen
        last, seen = (key[-1], there[-1]), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place.astype(np.int64))], names=[*batch.schema.names, "_part", "_own"])


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the 0-based place of each row among those with equal value of its first column (whole numbers or null), by `order`, nulls first.

    Rows are dealt into ranges of that order (equal rows by their place in the input,
    so copies are no single range) and counted there; only a group that begins in an
    earlier range gets an offset, one for each range at most.
    """
    small_batches(df.sparkSession)
    key, names = df.columns[0], df.columns
    by = [key, *order, "_salt"]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("_salt")
    own = cut(ranged.mapInArrow(_own_places, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "_part int, _own long"])))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("_part")) - F.col("n")  # a row for each range of a group
    offsets = own.groupBy(key, "_part").agg(F.count("*").alias("n")).select(F.col(key).alias("_key"), "_part", before.alias("_before")).where("_before > 0")
    joined = own.join(F.broadcast(offsets), "_part", "left")  # a range has one at most: its first group
    return joined.select(*names, (F.col("_own") + F.when(F.col(key).eqNullSafe(F.col("_key")), F.coalesce("_before", F.lit(0))).otherwise(0)).alias(name))


def named(distinct: DataFrame, first: int = 0) -> tuple[DataFrame, int]:
    """The rows of distinct with dense names from `first` on, written to the shared folder, and the name after the last."""
    rows = cut(distinct.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("part")).count().collect()  # a row for each task that wrote
    offsets, after = [], first
    for part_of, n in sorted((r["part"], r["count"]) for r in sizes):
        offsets.append((part_of, after))
        after += n
    at = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part int, _before long"))
    return rows.withColumn("_part", part).join(at, "_part").withColumn("name", F.col("_before") + place).drop("_part", "_before", "_id"), after

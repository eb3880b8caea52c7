"""Packing into optimal length buckets.

A document's length is its tokens in a public byte-level vocabulary and one end mark. The
lengths of all documents, rounded up to the padding steps (8 up to 4096, 64 up to
65536, 1024 beyond), form one histogram, which is the only thing the driver gets.
Dynamic programming over it finds the bucket boundaries with the least padding.
Inside a bucket, batches take as many documents as the token budget holds at the
bucket's padded length.

Rows are numbered inside groups of about GROUP rows, a hash of the row apart, and the
groups' running totals are added, so no bucket is ever in one task. Rows that are equal
more than GROUP times are dealt over groups by their place in the input.

Defined results: null and empty texts have length 1; a document longer than the budget
is a batch of its own, whole; repeated rows each get a slot; an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_level, cut, pieces, small, small_batches, table

BUCKETS = 16
BUDGET = 65_536
GROUP = 50_000
STEPS = ((4096, 8), (65_536, 64), (None, 1024))


def lengths(docs: DataFrame, ranks: str, key: str, text: str) -> DataFrame:
    """Rows (id, n_tokens, h, r): tokens and end mark, a hash of the row, and a number of the row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(key, text).alias("h"), F.monotonically_increasing_id().alias("r"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level(ranks).encode_ordinary
        for batch in pieces(batches, "text"):
            n = [len(encode(t or "")) + 1 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), batch.column("h"), batch.column("r")], names=["id", "n_tokens", "h", "r"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, h long, r long")


def padded(n: Column) -> Column:
    """n rounded up to its padding step."""
    up = lambda step: (F.ceil(n / step) * step).cast("long")
    return F.when(n <= STEPS[0][0], up(STEPS[0][1])).when(n <= STEPS[1][0], up(STEPS[1][1])).otherwise(up(STEPS[2][1]))


def boundaries(uppers: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The bucket boundaries (at most `buckets`) that minimise total padded length; uppers ascend.

    cost(i, j) = uppers[j] * documents in cells i+1..j; the lengths themselves are a constant.
    """
    if not uppers:
        return []
    u, c = np.array(uppers, np.float64), np.concatenate([[0.0], np.cumsum(counts)])
    n = len(u)
    best = u * c[1:]
    back = [np.full(n, -1)]
    for _ in range(1, min(buckets, n)):
        new, arg = best.copy(), np.full(n, -2)  # -2: no further bucket
        for j in range(1, n):
            cost = best[:j] + u[j] * (c[j + 1] - c[1 : j + 1])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], arg[j] = cost[i], i
        best = new
        back.append(arg)
    out, j = [], n - 1
    for arg in reversed(back):
        if arg[j] == -2:
            continue
        out.append(uppers[j])
        j = int(arg[j])
        if j < 0:
            break
    return out[::-1]


def pack(docs: DataFrame, ranks: str, buckets: int = BUCKETS, budget: int = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, bucket, bucket_len, batch, slot), one for each row of docs; ranks: the vocabulary's file."""
    rows = cut(lengths(docs, ranks, key, text))
    cells = sorted((r["u"], r["n"]) for r in rows.groupBy(padded(F.col("n_tokens")).alias("u")).agg(F.count("*").alias("n")).collect())
    ends = boundaries([u for u, _ in cells], [n for _, n in cells], buckets) or [1]
    sizes = [sum(n for u, n in cells if low < u <= high) for low, high in zip([0, *ends], ends, strict=False)]
    bucket = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("n_tokens")))
    groups = F.element_at(F.array(*(F.lit(-(-s // GROUP) or 1) for s in sizes)), F.col("bucket") + 1)
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_len", F.element_at(F.array(*(F.lit(e).cast("long") for e in ends)), F.col("bucket") + 1))
    hot = cut(rows.groupBy("h").agg(F.count("*").alias("copies")).where(F.col("copies") > GROUP))
    rows = rows.join(small(hot), "h", "left").withColumn("salt", F.coalesce(F.pmod("r", F.ceil(F.col("copies") / GROUP)), F.lit(0)))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("h", "salt"), groups).cast("int"))
    before = rows.groupBy("bucket", "g").agg(F.count("*").alias("n")).select("bucket", "g", (F.sum("n").over(Window.partitionBy("bucket").orderBy("g")) - F.col("n")).alias("before"))
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("bucket", "g").orderBy("h", "salt", "id")) - 1).join(before, ["bucket", "g"])
    room = F.greatest(F.lit(1), F.expr(f"{budget} div bucket_len"))
    place = F.col("before") + F.col("i")
    return numbered.select(F.col("id").alias(key), "n_tokens", "bucket", "bucket_len", F.floor(place / room).cast("long").alias("batch"), (place % room).cast("int").alias("slot"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document."""
    return pack(table(spark, sf_dir, "documents"), vocabulary())

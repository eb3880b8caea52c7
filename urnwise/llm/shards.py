"""Sharding by extendible hashing, in DataFrame functions only.

A row's key is 60 bits of md5 over its id and text. The directory is indexed by the
key's first bits: sums of bytes at the depth that the total calls for (and SPARE more)
are rolled up, and a bucket is the shortest prefix whose bytes fit the limit; only
prefixes that are still too large are looked at again with MORE bits, for their rows
alone. A bucket whose rows all have one key can't split: it is one row above the limit
(a shard of its own), or copies of one row, which fill overflow pages by number.
Rows travel without their text.

Defined results: null id and null text count as empty strings; an empty table gives no
rows; shard names are the prefix bits (`all` for none), with `.page` for pages after
the first. Every shard but a single larger row fits the limit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, cut, table

BITS, SPARE, MORE = 60, 3, 8
#: Copies of one row that are numbered together.
GROUP = 50_000
#: Bytes of text in a shard.
LIMIT = 16 << 20


def row_key(key: str, text: str) -> Column:
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def prefix(h: str, depth: Column | int) -> Column:
    return F.expr(f"shiftright({h}, {BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftright", F.col(h), (F.lit(BITS) - depth).cast("int"))


def directory(rows: DataFrame, bits: int, limit: int) -> DataFrame:
    """Entries (e = first `bits` bits, depth, shard_bytes, n, one) of rows (h, n_bytes); depth null: still too large at `bits`."""
    entries = cut(rows.groupBy(prefix("h", bits).alias("e")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c"), F.min("h").alias("low"), F.max("h").alias("high")))
    every = entries.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn("p", F.call_function("shiftright", F.col("e"), (F.lit(bits) - F.col("depth")).cast("int")))
    sums = every.groupBy("depth", "p").agg(F.sum("b").alias("bytes"), F.sum("c").alias("n"), (F.min("low") == F.max("high")).alias("one"))
    fits = sums.where((F.col("bytes") <= limit) | F.col("one"))
    found = every.select("e", "depth", "p").join(fits, ["depth", "p"]).groupBy("e").agg(F.min(F.struct("depth", F.col("bytes").alias("shard_bytes"), "n", "one")).alias("x"))
    return entries.select("e").join(found, "e", "left").select("e", "x.*")


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, shard, depth, n_bytes, shard_bytes), one for each row of docs."""
    rows = cut(docs.select(F.col(key).alias("id"), row_key(key, text).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("r")))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).head()[0]
    bits = min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + SPARE)
    parts, rest = [], rows
    while True:
        entries = cut(directory(rest, bits, limit))
        small = (lambda d: F.broadcast(d)) if entries.count() <= BROADCAST_ROWS else (lambda d: d)
        keyed = rest.withColumn("e", prefix("h", bits))
        parts.append(keyed.join(small(entries.where("depth is not null")), "e"))
        large = entries.where("depth is null").select("e")
        if bits == BITS or not large.limit(1).count():
            break
        rest = cut(keyed.join(small(large), "e", "left_semi").drop("e"))
        bits = min(BITS, bits + MORE)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    copies = F.col("one") & (F.col("n") > 1) & (F.col("shard_bytes") > limit)  # rows of one key: equal rows
    fit = F.greatest(F.lit(1), F.expr(f"{limit} div greatest(n_bytes, 1)"))
    own = out.where(copies).withColumn("salt", F.pmod("r", F.ceil(F.col("n") / GROUP)))  # numbered in groups, whose sizes are added
    sizes = own.groupBy("h", "salt").agg(F.count("*").alias("size"))
    sizes = sizes.select("h", "salt", (F.sum("size").over(Window.partitionBy("h").orderBy("salt")) - F.col("size")).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("h", "salt").orderBy("n_bytes")) - 1
    plain = out.where(~copies).withColumn("page", F.lit(0).cast("long"))
    paged = own.join(sizes, ["h", "salt"]).withColumn("page", (number / fit).cast("long"))
    paged = paged.withColumn("shard_bytes", F.least(fit, F.col("n") - F.col("page") * fit) * F.col("n_bytes"))
    bits_of = F.when(F.col("depth") == 0, "all").otherwise(F.expr(f"lpad(bin(shiftright(h, cast({BITS} - depth as int))), depth, '0')"))
    name = F.concat(bits_of, F.when(F.col("page") > 0, F.concat(F.lit("."), F.col("page").cast("string"))).otherwise(""))
    return plain.unionByName(paged.select(*plain.columns)).select(F.col("id").alias(key), name.alias("shard"), "depth", "n_bytes", "shard_bytes")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return assign(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
with d as (select doc_id, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as h, coalesce(strlen(text), 0) as n_bytes from documents),
e as (select doc_id, h, n_bytes, depth, h >> ({BITS} - depth) as p from d, (select unnest(range(0, {BITS + 1})) as depth)),
s as (select depth, p, sum(n_bytes) as b, min(h) = max(h) as one from e group by depth, p),
f as (select e.doc_id, e.h, e.n_bytes, min(struct_pack(depth := e.depth, b := s.b)) as x from e join s on e.depth = s.depth and e.p = s.p where s.b <= {LIMIT} or s.one group by e.doc_id, e.h, e.n_bytes)
select doc_id, case when x.depth = 0 then 'all' else lpad(bin(h >> cast({BITS} - x.depth as integer)), cast(x.depth as integer), '0') end as shard,
  cast(x.depth as integer) as depth, cast(n_bytes as bigint) as n_bytes, cast(x.b as bigint) as shard_bytes from f
"""

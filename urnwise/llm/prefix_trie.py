"""The prefix trie of conversations by prefix-doubling naming.

Turns get dense names for their (role, text), known by a digest of both. Blocks of
2^k turns that begin at a multiple of 2^k are named from the names of their halves, in
as many join rounds as the longest conversation has binary digits. The prefix of d
turns is the prefix without d's lowest binary digit and one such block, so a second
series of rounds, from the highest digit down, names every prefix once. Equal prefixes
of equal length have one name, a node; each round's work is half of the round before
(blocks) or after (prefixes), and no conversation is ever one row or one group.

Nodes are grouped from rows (conversation, depth, node). A node's smallest member
stands for it, and stands for all nodes below it on its own path. So a subtree's sums
are sums over the node's members of what each stands for, less what the smallest one
stands for above the node.

Defined results: null role or text is empty; rows of equal turn stand in order of the
digest of role and text; repeated rows are turns of their own; rows without a conv_id
belong to no conversation; an empty table gives no rows (not even a root); extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urnwise.operators.sequence import running

from .common import cut, table
from .order import named, placed

#: Conversations that share a first turn: so many consecutive ids; and the most turns that they share.
FAMILY, SHARED = 100, 6
#: Members' ids are joined in pieces of ids from so many consecutive ones.
PIECE = 1 << 16


def digest(role: Column, text: Column) -> Column:
    """256 bits of a turn's role and text."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """Rows (c, pos, turn, len) of conversations (conv_id, turn, role, text): each turn's place, digest and code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").alias("c"), F.col("turn").alias("at"), digest(role, text).alias("turn"), F.length(text).cast("long").alias("len"))
    return placed(rows, ["at", "turn"], "pos").select("c", "pos", "turn", "len")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations (c, size)) where c has the first h turns of c - c % FAMILY in place of its own first h; h = crc32(c) % SHARED."""
    rows = cut(rows)
    sizes = cut(rows.groupBy("c").agg(F.count("*").alias("n")))
    h = (F.crc32(F.col("c").cast("string")) % SHARED).alias("h")
    every = sizes.select("c", "n", h, (F.col("c") - F.col("c") % FAMILY).alias("base")).join(sizes.select(F.col("c").alias("base"), F.col("n").alias("n_base")), "base", "left")
    every = cut(every.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    own = rows.withColumn("h", h).where("pos >= h").join(every.select("c", "taken"), "c").select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn", "len")
    heads = rows.where(F.col("pos") < SHARED - 1).select(F.col("c").alias("base"), "pos", "turn", "len")
    head = every.where("taken > 0").select("c", "base", "taken").join(heads, "base").where("pos < taken").select("c", "pos", "turn", "len")
    return cut(own.unionByName(head)), every.select("c", "size")


def blocks(rows: DataFrame, longest: int) -> list[DataFrame]:
    """For each k: (c, j, name, len) of the blocks of 2^k turns from turn j 2^k on; len: of the last turn."""
    names, _ = named(rows.select("turn").distinct())
    out = [cut(rows.join(names, "turn").select("c", F.col("pos").alias("j"), "name", "len"))]
    for _ in range(1, longest.bit_length()):
        odd = F.col("j") % 2 == 1
        halves = out[-1].groupBy("c", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b"), F.max(F.when(odd, F.col("len"))).alias("len")).where("b is not null")
        names, _ = named(halves.select("a", "b").distinct())
        out.append(cut(halves.join(names, ["a", "b"]).select("c", "j", "name", "len")))
    return out


def prefixes(levels: list[DataFrame]) -> tuple[DataFrame | None, list[DataFrame]]:
    """(c, d, node) of all prefixes of d > 0 turns, and the nodes' (name, conv_id, depth, n_convs, len) in parts."""
    paths: DataFrame | None = None
    nodes, after = [], 1
    for k in reversed(range(len(levels))):
        block = levels[k].where("j % 2 = 0").select("c", F.shiftleft("j", k).alias("d"), F.col("name").alias("b"), "len")
        rows = block.where("d = 0").withColumn("p", F.lit(0).cast("long"))
        if paths is not None:
            rows = rows.unionByName(block.where("d > 0").join(paths.withColumnRenamed("node", "p"), ["c", "d"]))
        rows = cut(rows.withColumn("d", F.col("d") + (1 << k)))
        found, after = named(rows.groupBy("p", "b").agg(F.min("c").alias("conv_id"), F.min("d").alias("depth"), F.count("*").alias("n_convs"), F.min("len").alias("len")), after)
        nodes.append(found.select("name", "conv_id", "depth", "n_convs", "len"))
        own = cut(rows.join(found.select("p", "b", F.col("name").alias("node")), ["p", "b"]).select("c", "d", "node"))
        paths = own if paths is None else paths.unionByName(own)
    return paths, nodes


def digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, c): the hash of each node's ids in order, comma-joined.

    Ids are joined in pieces of at most PIECE; a task streams a node's pieces through the hash.
    """
    pieces = ends.groupBy("node", F.expr(f"c div {PIECE}").alias("piece"), (F.col("c") < 0).alias("below")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    # quotients are rounded towards 0, so the piece of the ids below 0 stands before its positive namesake
    ordered = pieces.select("node", (F.col("piece") * 2 - F.col("below").cast("long")).alias("piece"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for now, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if sha is not None and now == node:
                    sha.update(b"," + ids.encode())
                    continue
                if sha is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = now, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])

    return ordered.repartition("node").sortWithinPartitions("node", "piece").mapInArrow(run, "node long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Rows (node, conv_id, depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of turns (c, pos, turn, len) and conversations (c, size)."""
    longest = convs.agg(F.max("size")).head()[0]
    root = convs.agg(F.lit(0).cast("long").alias("name"), F.min("c").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("len")).where("n_convs > 0")
    paths, parts = prefixes(blocks(rows, longest)) if longest else (None, [])
    start = convs.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("node"))
    paths = start if paths is None else start.unionByName(paths)
    nodes = cut(reduce(DataFrame.unionByName, parts, root))
    # -- parents: the node of the smallest member one turn before
    up = nodes.where("depth > 0").select("name", F.col("conv_id").alias("c"), (F.col("depth") - 1).alias("d")).join(paths.withColumnRenamed("node", "parent"), ["c", "d"]).select("name", "parent")
    nodes = cut(nodes.join(up, "name", "left"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumn("saves", (F.col("n_convs") - 1) * F.col("len"))
    nodes = cut(nodes.join(nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left"))
    # -- what a conversation stands for, summed over the members of each node, less what the smallest stands for above
    stands = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.sum("saves").alias("saves"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    below = paths.join(stands, "c").groupBy(F.col("node").alias("name")).agg(F.sum("saves").alias("all"), F.sum("leaves").alias("n_leaves"))
    above = running(nodes.select("name", "conv_id", "saves", F.col("depth").alias("idx")), "conv_id", {"upto": F.col("saves")}).select("name", (F.col("upto") - F.col("saves")).alias("above"))
    ends = paths.join(convs.select("c", F.col("size").alias("d")), ["c", "d"]).select("node", "c")
    out = nodes.join(below, "name").join(above, "name").join(digests(ends).withColumnRenamed("node", "name"), "name", "left")
    return out.select(
        F.col("name").alias("node"), "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("all") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    rows = cut(turns(conversations))
    return trie(rows, cut(rows.groupBy("c").agg(F.count("*").alias("size"))))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return trie(*rebuilt(turns(table(spark, sf_dir, "conversations")))).drop("node", "parent")


#: crc32 of a decimal number, from the polynomial's bits.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"
OP11_SQL = f"""
with o as (select conv_id as c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first, unhex(sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')))) as own
  from conversations where conv_id is not null group by conv_id),
h as (select *, {_CRC} % {SHARED} as h from o),
r as (select h.c, list_concat(coalesce(b.own[1:h.h], []), coalesce(h.own[h.h + 1:], [])) as turns from h left join o b on b.c = h.c - h.c % {FAMILY}),
p as (select c, len(turns) as size, d, turns[1:d] as prefix from (select c, turns, unnest(range(0, len(turns) + 1)) as d from r)),
n as (select d, prefix, min(c) as conv_id, count(*) as n_convs, coalesce(length(prefix[d].t), 0) as len, coalesce(string_agg(c::varchar, ',' order by c) filter (where size = d), '') as ends from p group by d, prefix),
k as (select n.*, u.conv_id as parent_conv_id from n left join n u on u.d = n.d - 1 and u.prefix = n.prefix[1:n.d - 1] and n.d > 0),
ch as (select k.d - 1 as d, prefix[1:k.d - 1] as prefix, count(*) as n_children from k where d > 0 group by all),
f as (select k.*, coalesce(n_children, 0) as n_children from k left join ch using (d, prefix)),
s as (select p.d, p.prefix, count(*) filter (where f.n_children = 0) as n_leaves, sum((f.n_convs - 1) * f.len) as saved from f join p on p.c = f.conv_id and p.d <= f.d group by p.d, p.prefix)
select conv_id, d::bigint as depth, parent_conv_id, n_convs, n_children, n_leaves, saved::bigint as saved_tokens, sha256(ends) as ends_sha256 from f join s using (d, prefix)
"""

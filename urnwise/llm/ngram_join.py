"""N-gram Jaccard join over a MinHash LSH forest.

A text's set is its windows of N words (lower case, parted by ASCII white space; a text
of fewer words is one window). Texts with equal sets are one class, aggregated before
any join. Each class has TREES label strings of DEPTH MinHash values; a tree is the
prefix trie of one string, compressed: only nodes that branch bring new pairs together.

Matched prefixes are shortened value by value, from the whole string, until even a pair
at the threshold meets with the target recall: a pair of similarity s shares a prefix of
d values in some tree with probability 1 - (1 - s^d)^TREES. Links already found never
end this earlier, for classes or nodes: between two tight groups all pairs share their
fate, so what a class has found says nothing about what it has not. What lies below the
shortened node needs no walk of its own, as all its classes meet in it; nodes with a
single class are left out. In a task the label strings of each tree are sorted into its
nodes, and a pair belongs to the first tree in which it meets, so no pair counts twice.

A node's classes are dealt into chunks of at most CHUNK classes and about WINDOWS
windows, and chunks meet in pairs, each pair of chunks one task; so a node under which a
third of all texts lie is many tasks. Tasks first compare signatures (a pair below the
threshold's binomial tail of TAIL is out, as is one whose sizes alone forbid it) and keep
a row of bits for each class with a pair left; only for those classes are the sets made
and shipped, once to each pair of chunks, and every such pair is compared exactly. A task
returns link counts and one connecting edge for each class: pairs inside a large group
of near copies are never rows.

Defined results: null, empty and blank texts have no windows and link with nothing, as
do rows with a null key (whose class is null). Repeated rows and repeated keys keep
their rows; a key with several texts belongs to several classes, a row each. An empty
table gives no rows; extra columns are ignored. Sets are compared by 64-bit hashes of
their windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, components, cut, pieces, small, small_batches, table
from .near_vectors import Forest
from .words import hashes, mix, raw, windows, word_spans

N, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.9995
CHUNK, WINDOWS = 256, 1 << 20
TAIL = 1e-9
_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**62, (2, TREES * DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def met(similarity, depth: int, trees: int = TREES):
    """The probability that a pair of that similarity shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortened(threshold: float = THRESHOLD, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The prefix length of the nodes: the first, from `depth` down, at which a pair at the threshold is met with the target recall."""
    while depth > 1 and met(threshold, depth) < recall:
        depth -= 1
    return depth


def least_matches(n: int, threshold: float) -> int:
    """Of n MinHash values, so many equal ones that a pair at the threshold has fewer with probability TAIL at most."""
    total, k = 0.0, 0
    while True:
        total += comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        if total > TAIL:
            return k
        k += 1


def window_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """The sorted distinct window hashes of each text."""
    data, offsets = raw(pc.utf8_lower(pc.fill_null(texts, "")))
    begin, end, rows = word_spans(data, offsets)
    h = hashes(data, begin, end)
    w, at = windows(h, rows, n)
    out = []
    for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
        if a == b and rows[i + 1] > rows[i]:  # fewer than n words: all of them
            few = h[rows[i] : rows[i + 1]]
            out.append(windows(few, np.array([0, len(few)]), len(few))[0])
        else:
            s = np.sort(w[a:b])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def signatures(sets: list[np.ndarray], values: int) -> np.ndarray:
    """MinHash values (uint32) of sets that are not empty."""
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum(list(map(len, sets)))[:-1]])
    out = np.empty((len(sets), values), np.uint32)
    for j in range(values):
        out[:, j] = np.minimum.reduceat(((flat * _SEEDS[0, j] + _SEEDS[1, j]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a set."""
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return tuple(np.array([a, b], np.uint64).view(np.int64).tolist())


def signed(docs: DataFrame) -> DataFrame:
    """Rows (id, k1, k2, n, sig) of docs (id, text)."""
    values = TREES * DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = window_sets(batch.column("text"))
            some = [s for s in sets if len(s)]
            sigs = iter(signatures(some, values)) if some else iter(())
            keys = [set_keys(s) if len(s) else (0, 0) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["id", "k1", "k2", "n", "sig"],
            )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, k1 long, k2 long, n long, sig binary")


def _agreeing(sig: np.ndarray, a: np.ndarray, b: np.ndarray, ok: np.ndarray, least: int) -> np.ndarray:
    """ok, where so many signature values agree."""
    if ok.sum() * 4 > ok.size:
        same = np.zeros(ok.shape, np.int16)
        for j in range(sig.shape[1]):
            same += sig[a, j][:, None] == sig[b, j][None, :]
        return ok & (same >= least)
    out = np.zeros_like(ok)
    pairs = np.argwhere(ok)
    for low in range(0, len(pairs), 1 << 14):
        i, j = pairs[low : low + (1 << 14)].T
        out[i, j] = (sig[a[i]] == sig[b[j]]).sum(axis=1) >= least
    return out


def _pairs(group: pa.Table, depth: int, threshold: float):
    """Candidates of a task: (rows of the group, class by class; its left rows, its right rows, a matrix of bits)."""
    c = group.column("c").to_numpy()
    own = group.column("own")[0].as_py()
    tree = group.column("tree")[0].as_py()
    _, keep = np.unique(c, return_index=True)  # a class is one member, however many rows bring it
    left = group.column("left").to_numpy(zero_copy_only=False)[keep]
    a = np.arange(len(keep)) if own else np.flatnonzero(left)
    b = a if own else np.flatnonzero(~left)
    if not len(a) or not len(b):
        return None
    sig = np.frombuffer(b"".join(group.column("sig").take(pa.array(keep)).to_pylist()), np.uint32).reshape(len(keep), TREES * DEPTH)
    n = group.column("n").to_numpy()[keep]
    ok = np.minimum(n[a][:, None], n[b][None, :]) >= threshold * np.maximum(n[a][:, None], n[b][None, :])
    if own:
        ok &= ~np.tri(len(a), dtype=bool)
    for t in range(tree):  # met in an earlier tree
        labels = np.ascontiguousarray(sig[:, t * DEPTH : t * DEPTH + depth]).view(f"V{4 * depth}").ravel()
        node = np.unique(labels, return_inverse=True)[1]
        ok &= node[a][:, None] != node[b][None, :]
    return keep, a, b, _agreeing(sig, a, b, ok, least_matches(TREES * DEPTH, threshold))


def _overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets."""
    if len(pairs) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs.tolist()], np.int64)
    flat = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    own, column = own[shared], np.unique(column[shared], return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 8192
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        m = np.zeros((len(sets), width), np.float32)
        m[own[a:b], column[a:b] - low] = 1
        total += m @ m.T  # whole numbers, exact below 2^24
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, class_id, n_links), one for each row of docs: the smallest key reachable by links, and the rows linked directly."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    known = cut(signed(rows))
    classes = cut(known.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("sig").alias("sig")).withColumnRenamed("k1", "c"))
    every = _links(rows, classes, shortened(threshold), threshold)
    comps = components(every.select(F.col("c").alias("u"), F.col("root").alias("v")))
    counted = every.groupBy("c").agg(F.sum("links").alias("links"))
    joined = classes.select("c", "k2", "n", "rep", "w").join(counted, "c", "left").join(comps.withColumnRenamed("node", "c"), "c", "left")
    linked = joined.where("component is not null")
    least = linked.groupBy("component").agg(F.min("rep").alias("class_id"))
    result = linked.join(least, "component").select("c", "k2", "n", "class_id", (F.col("links") + F.col("w") - 1).alias("n_links"))
    result = result.unionByName(joined.where("component is null").select("c", "k2", "n", F.col("rep").alias("class_id"), (F.col("w") - 1).alias("n_links")))
    own = known.select("id", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("k1")).alias("c"), "k2", "n")
    out = own.join(result, ["c", "k2", "n"], "left")
    return out.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _links(rows: DataFrame, classes: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Verified links: rows (c, links, root) of classes, some for each pair of chunks."""
    kind = rows.schema["id"].dataType.simpleString()
    # -- nodes of the tries, and the classes under each
    width = 4 * DEPTH
    nodes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring(F.col("sig"), t * width + 1, F.lit(4 * depth))))
    under = classes.select("c", "n", F.posexplode(nodes).alias("tree", "node"))
    chunks = F.greatest(F.ceil(F.col("m") / CHUNK), F.least("m", F.ceil(F.col("s") / WINDOWS))).cast("int")
    full = under.groupBy("node").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1").select("node", chunks.alias("k"))
    # -- every chunk of a node meets every other
    placed = under.join(full, "node").withColumn("chunk", F.pmod(F.xxhash64("c", F.lit("chunk")), "k").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    placed = placed.select("c", "tree", (F.col("chunk") <= F.col("o")).alias("left"), (F.col("chunk") == F.col("o")).alias("own"), F.concat_ws("/", "node", F.least("chunk", "o"), F.greatest("chunk", "o")).alias("block"))
    placed = placed.join(classes.select("c", "n", "w", "rep", "sig"), "c")

    def candidates(group: pa.Table):
        made = _pairs(group, depth, threshold) if group.num_rows > 1 else None
        if made is None:
            return None
        keep, a, b, ok = made
        if not ok.any():
            return None
        left, right = a[ok.any(axis=1)], b[ok.any(axis=0)]
        bits = np.packbits(ok[ok.any(axis=1)][:, ok.any(axis=0)], axis=1)
        both = np.concatenate([left, right])
        out = group.take(pa.array(keep[both]))
        column = [x.tobytes() for x in bits] + [None] * len(right)
        return pa.RecordBatch.from_arrays([*(out.column(x).combine_chunks() for x in ("c", "n", "w", "rep", "block")), pa.array(np.concatenate([np.arange(len(left)), np.arange(len(right))])), pa.array(column, pa.binary())], names=["c", "n", "w", "rep", "block", "place", "bits"])

    near = cut(by_key(placed, "block", candidates, f"c long, n long, w long, rep {kind}, block string, place long, bits binary"))
    # -- sets of those classes only
    wanted = small(cut(near.select(F.col("rep").alias("id")).distinct()))
    texts = rows.join(wanted, "id", "left_semi").select("text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = [s for s in window_sets(batch.column("text")) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_keys(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "set"])

    sets_of = texts.mapInArrow(to_sets, "c long, set binary")
    full_rows = near.join(sets_of, "c")

    def verify(group: pa.Table):
        place, is_left = group.column("place").to_numpy(), group.column("bits").is_valid().to_numpy()
        # rows of either side in order of place; several texts of one key, or copies, bring a class more than once
        at = {True: {}, False: {}}
        for row, (p, side) in enumerate(zip(place.tolist(), is_left.tolist(), strict=True)):
            at[side].setdefault(p, row)
        left, right = (np.array([own[p] for p in sorted(own)]) for own in (at[True], at[False]))
        bits = np.frombuffer(b"".join(group.column("bits").take(pa.array(left)).to_pylist()), np.uint8).reshape(len(left), -1)
        pairs = np.argwhere(np.unpackbits(bits, axis=1)[:, : len(right)])
        both = np.concatenate([left, right])
        c, own, back = np.unique(group.column("c").to_numpy()[both], return_index=True, return_inverse=True)
        pairs = np.stack([back[pairs[:, 0]], back[len(left) + pairs[:, 1]]], axis=1)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("set").take(pa.array(both[own])).to_pylist()]
        w = group.column("w").to_numpy()[both[own]]
        size = np.array(list(map(len, sets)))
        shared = _overlaps(sets, pairs)
        total = size[pairs[:, 0]] + size[pairs[:, 1]] - shared
        ok = shared >= threshold * total - 1e-9
        pairs = pairs[ok]
        if not len(pairs):
            return None
        links = np.bincount(pairs[:, 0], w[pairs[:, 1]], len(c)) + np.bincount(pairs[:, 1], w[pairs[:, 0]], len(c))
        forest = Forest(len(c))
        forest.join_pairs(pairs[:, 0], pairs[:, 1])
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(c[some]), pa.array(links[some].astype(np.int64)), pa.array(c[[forest.root(int(x)) for x in some]])], names=["c", "links", "root"])

    return cut(by_key(full_rows, "block", verify, "c long, links long, root long"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each class the smallest key; of repeated keys one row; rows with a null key all."""
    classes = cut(ngram_join(docs, threshold, key, text))
    gone = small(cut(classes.where(F.col(key) != F.col("class_id")).select(key).distinct()))
    kept = docs.join(gone, key, "left_anti").select(*docs.columns)
    if classes.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count():
        kept = kept.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.where(F.col(key).isNull()))
    return kept


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return ngram_join(table(spark, sf_dir, "documents"))

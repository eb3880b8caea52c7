"""Line dedup over a log-template tree.

Fixed-depth parsing: a line goes by its number of words, then by its first LEAD words, to
a leaf; words with a digit are the variable `<*>` from the start. Inside a leaf, lines
of which at least SIMILAR of the words agree position by position share a template
(the most frequent line first, then by hash), whose other positions are variable. A
template in at least MIN_DOCS documents is recurring: its first line in the smallest
document stays, all others go. Where its lines are no such template, a passage (a line of over
PASSAGE words) recurs by itself from `passage_docs` documents on; MIN_DOCS guards the merging of
different lines and short lines that agree by chance.

Whole texts are reduced to one leaf hash and one line hash for each line; distinct
(line, document) pairs are counted before anything else is joined. A leaf without
MIN_DOCS documents can't hold a recurring template, and one with a single distinct line
is its own template; only the words of lines in other leaves are compared. A leaf with
more than CROWD distinct lines is parted first, with the same result: its lines get keys
such that any two that agree enough share one (the words at some of the places behind the
leading ones, as many choices of places as may differ), and only lines joined by shared keys, however
indirectly, can bear on each other's template. So lines that share no key are their own
template uncompared, among them all lines of so few words that none may differ, and the
joined ones are compared by themselves. Parts that are still larger than CROWD are compared
in rounds: their first lines in order give their templates, the others are dealt into
chunks that each meet these, by blocks of words, and those that join none are left for the next round, so
no task holds an unbounded part. Recurring lines are broadcast as hashes if their
counted number allows, else joined.

Defined results: blank lines are no lines, never dropped and not counted; null texts
stay null; documents with a null key don't count and lose no lines; rows of one key
are one document, and each of its rows keeps that document's stay. Lines are parted by
line feeds and compared by 64-bit hashes of their words. Extra columns are passed
through by `filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, by_key, components, cut, fresh, pieces, small, small_batches, table
from .words import hashes, mix, raw, spans, weights, word_spans

LEAD = 3
MIN_DOCS, SIMILAR = 3, 0.8
#: Distinct lines of a leaf that a task holds in the first round; four times as many in each further one, up to MOST.
CROWD, MOST = 256, 4096
PASSAGE, PASSAGE_DOCS = 50, 2
#: A line's keys in a crowded leaf, at most (but one more than its words that may differ, where that is more).
KEYS = 66
#: Pairs of lines that are compared at once, in words.
PAIR_WORDS = 4 << 20
VARIABLE = np.uint64(0x3C2A)
DIGIT = np.zeros(256, bool)
DIGIT[list(b"0123456789")] = True


def parse(texts: pa.Array) -> dict[str, np.ndarray]:
    """Lines with words: row, begin and end byte, leaf and line hash, offsets of their word hashes in `words`."""
    data, offsets = raw(texts)
    begin, end, rows = word_spans(data, offsets)
    h = hashes(data, begin, end)
    if len(begin):
        digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
        h[digits[end] > digits[begin]] = VARIABLE
    line_begin, line_end = spans(data != 0x0A, offsets)
    some, first = np.unique(np.searchsorted(line_begin, begin, "right") - 1, return_index=True)
    line_begin, line_end = line_begin[some], line_end[some]
    at = np.concatenate([first, [len(h)]])
    count = np.diff(at)
    place = np.arange(len(h)) - np.repeat(first, count)
    term = h * weights(place + 7)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    upto = lambda k: mix(total[first + np.minimum(count, k)] - total[first] + mix(count.astype(np.uint64) * np.uint64(31) + np.uint64(min(k, 1 << 20))))
    leaf = upto(LEAD) if len(first) else np.zeros(0, np.uint64)
    line = upto(1 << 30) if len(first) else np.zeros(0, np.uint64)
    return {"row": np.searchsorted(offsets, line_begin, "right") - 1, "begin": line_begin, "end": line_end, "leaf": leaf, "line": line, "at": at, "words": h}


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def parsed(docs: DataFrame) -> DataFrame:
    """Distinct (leaf, line, id, passage) of docs (id, text) within each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            p = parse(batch.column("text"))
            yield pa.RecordBatch.from_arrays([_longs(p["leaf"]), _longs(p["line"]), batch.column("id").take(pa.array(p["row"])), pa.array(np.diff(p["at"]) > PASSAGE)], names=["leaf", "line", "id", "passage"])

    return docs.mapInArrow(run, f"leaf long, line long, id {docs.schema['id'].dataType.simpleString()}, passage boolean").where("id is not null").distinct()


def words_of(docs: DataFrame, leaves: np.ndarray | None) -> DataFrame:
    """(leaf, line, words) of the lines in the given leaves (None: all), words as packed 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            p = parse(batch.column("text"))
            pick = np.flatnonzero(np.isin(p["leaf"], leaves)) if leaves is not None else np.arange(len(p["leaf"]))
            _, once = np.unique(p["line"][pick], return_index=True)
            pick = pick[once]
            short = (p["words"] >> np.uint64(32)).astype("<u4")
            words = [short[p["at"][i] : p["at"][i + 1]].tobytes() for i in pick.tolist()]
            yield pa.RecordBatch.from_arrays([_longs(p["leaf"][pick]), _longs(p["line"][pick]), pa.array(words, pa.binary())], names=["leaf", "line", "words"])

    return docs.mapInArrow(run, "leaf long, line long, words binary")


def templates(lines: np.ndarray, weight: np.ndarray, words: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """The template (its first line's hash) of each line of a leaf; words: one row of hashes for each line."""
    order = np.lexsort((lines, -weight))
    out = np.empty(len(lines), np.int64)
    while len(order):
        seed = words[order[0]]
        near = (words[order] == seed).mean(axis=1) >= similar
        near[0] = True
        out[order[near]] = lines[order[0]]
        order = order[~near]
    return out


def nearest(seeds: np.ndarray, words: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """The first seed that each line joins, or -1; seeds and words: one row of hashes for each line."""
    n = words.shape[1]
    need = _least(n, similar)
    bounds = np.linspace(0, n, n - need + 2).astype(int)
    best = np.full(len(words), len(seeds))
    for a, b in zip(bounds, bounds[1:], strict=False):
        block = lambda w: mix((w[:, a:b].astype(np.uint64) * weights(np.arange(b - a))).sum(axis=1, dtype=np.uint64))  # noqa: B023, E731
        own, line = block(seeds), block(words)
        order = np.argsort(own, kind="stable")
        low, high = np.searchsorted(own[order], line, "left"), np.searchsorted(own[order], line, "right")
        total = np.concatenate([[0], np.cumsum(high - low)])
        step = max(1, PAIR_WORDS // n)
        for start in range(0, int(total[-1]), step):
            pair = np.arange(start, min(start + step, int(total[-1])))
            i = np.searchsorted(total, pair, "right") - 1
            j = order[low[i] + pair - total[i]]
            some = j < best[i]
            i, j = i[some], j[some]
            near = (words[i] == seeds[j]).mean(axis=1) >= similar
            np.minimum.at(best, i[near], j[near])
    return np.where(best < len(seeds), best, -1)


def _least(n: int, similar: float) -> int:
    """How many of n words agree in two lines that are similar."""
    return next(k for k in range(1, n + 1) if k / n >= similar)


def keys(words: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """A row of keys for each line of a leaf (rows of word hashes): different lines that are similar share one."""
    n = words.shape[1]
    differ, rest = n - _least(n, similar), max(0, n - LEAD)
    if not differ:
        return np.zeros((len(words), 0), np.uint64)
    # places are parted into groups, of which two similar lines agree on all but `differ`: the finer, the rarer the keys
    parts = next((p for p in (rest, differ + 2, differ + 1) if p > differ and p <= rest and comb(p, differ) <= KEYS), min(differ + 1, rest))
    bounds = n - rest + np.linspace(0, rest, parts + 1).astype(int)
    term = words.astype(np.uint64) * weights(np.arange(n))
    sums = np.stack([term[:, a:b].sum(axis=1, dtype=np.uint64) for a, b in zip(bounds, bounds[1:], strict=False)], axis=1) if parts else np.zeros((len(words), 0), np.uint64)
    out = [mix(sums[:, list(own)].sum(axis=1, dtype=np.uint64) + np.uint64(i)) for i, own in enumerate(combinations(range(parts), max(0, parts - differ)))]
    return np.stack(out, axis=1)


def _matrix(words: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(words.to_pylist()), "<u4").reshape(len(words), -1)


def compared(weighed: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(line, template) of lines (leaf, line, n, words) whose leaves may be held by a task."""

    def task(group: pa.Table):
        line, n = group.column("line").to_numpy(), group.column("n").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(line), pa.array(templates(line, n, _matrix(group.column("words")), similar))], names=["line", "template"])

    return by_key(weighed, "leaf", task, "line long, template long")


def parted(weighed: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Lines (leaf, line, n, words) of crowded leaves with the part they belong to as leaf; those that are alone are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words"):
            sizes = np.array([len(x) for x in batch.column("words").to_pylist()]) // 4
            for n in np.unique(sizes):
                own = batch.filter(pa.array(sizes == n))
                k = keys(np.frombuffer(b"".join(own.column("words").to_pylist()), "<u4").reshape(-1, n), similar)
                if k.shape[1]:
                    leaf = own.column("leaf").to_numpy().view(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own.column("line").to_numpy(), k.shape[1])), _longs(mix(k + mix(leaf)[:, None]).ravel())], names=["line", "key"])

    keyed = cut(weighed.mapInArrow(run, "line long, key long"))
    firsts = keyed.groupBy("key").agg(F.min("line").alias("first"), F.max("line").alias("last")).where("first <> last").select("key", "first")
    edges = keyed.join(firsts, "key").where("line <> first").select(F.col("line").alias("u"), F.col("first").alias("v"))
    return weighed.join(components(edges), F.col("line") == F.col("node")).select(F.col("component").alias("leaf"), "line", "n", "words")


def crowded(weighed: DataFrame, similar: float = SIMILAR) -> list[DataFrame]:
    """What `compared` gives for leaves of any size, in parts."""

    def task(group: pa.Table):
        n, line = group.column("n").to_numpy(), group.column("line").to_numpy()
        words, seed = _matrix(group.column("words")), group.column("seed").to_numpy(zero_copy_only=False)
        seeds, rest = np.flatnonzero(seed), np.flatnonzero(~seed)
        seeds = seeds[np.lexsort((line[seeds], -n[seeds]))]
        at = nearest(words[seeds], words[rest], similar)
        found = pa.array(np.append(line[seeds], 0)[at], mask=at < 0)
        return pa.RecordBatch.from_arrays([pa.array(line[rest]), found], names=["line", "template"])

    parts, rest, crowd = [], weighed, CROWD
    while True:
        size = cut(rest.groupBy("leaf").agg(F.ceil(F.count("*") / crowd).alias("chunks")))
        rest = cut(rest.join(small(size), "leaf").withColumn("slot", F.struct(-F.col("n"), F.floor((F.col("line") / 2.0**64 + 0.5) * 4 * F.col("chunks")))))
        slots = rest.groupBy("leaf", "slot").agg(F.count("*").alias("own"))
        upto = F.sum("own").over(Window.partitionBy("leaf").orderBy("slot"))
        first = slots.withColumn("upto", upto).where((F.col("upto") <= crowd) | (F.col("upto") == F.col("own"))).groupBy("leaf").agg(F.max("slot").alias("last"))
        rest = cut(rest.join(small(cut(first)), "leaf").withColumn("head", F.col("slot") <= F.col("last")).drop("slot", "last"))
        head = rest.where("head")
        parts.append(cut(compared(head.select("leaf", "line", "n", "words"), similar)))
        others = rest.where("not head")
        if not others.limit(1).count():
            return parts
        seeds = head.join(parts[-1].where("line = template"), "line", "left_semi").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        dealt = seeds.withColumn("seed", F.lit(True)).unionByName(others.withColumn("chunk", F.pmod("line", "chunks")).withColumn("seed", F.lit(False)))
        dealt = dealt.select(F.xxhash64("leaf", "chunk").alias("chunk"), "line", "n", "words", "seed")
        found = cut(by_key(dealt, "chunk", task, "line long, template long"))
        parts.append(found.where("template is not null"))
        left = found.where("template is null").select("line")
        if not left.limit(1).count():
            return parts
        rest = others.join(left, "line", "left_semi").select("leaf", "line", "n", "words")
        crowd = min(MOST, 4 * crowd)


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR, passage_docs: int | None = None) -> DataFrame:
    """Rows (line, template, first_id) of recurring templates' lines, for docs (id, text); passage_docs: min_docs if None."""
    pairs = cut(parsed(docs))
    lines = pairs.groupBy("leaf", "line").agg(F.count("*").alias("n"))
    leaves = cut(lines.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("n").alias("n")))  # n >= documents of the leaf
    compare = leaves.where((F.col("lines") > 1) & (F.col("n") >= min_docs)).select("leaf")
    if compare.count() <= BROADCAST_ROWS:
        known = np.sort(compare.toArrow().column("leaf").to_numpy().view(np.uint64))
        words = words_of(docs, known)
        weight = pairs.join(F.broadcast(compare), "leaf")
    else:
        words = words_of(docs, None).join(compare, "leaf", "left_semi")
        weight = pairs.join(compare, "leaf")
    words = words.groupBy("leaf", "line").agg(F.first("words").alias("words"))
    weighed = words.join(weight.groupBy("leaf", "line").agg(F.count("*").alias("n")), ["leaf", "line"])

    full = cut(leaves.where((F.col("lines") > CROWD) & (F.col("n") >= min_docs)).select("leaf"))
    if full.limit(1).count():
        weighed = cut(weighed)
        part = cut(parted(weighed.join(small(full), "leaf", "left_semi"), similar))
        large = cut(part.groupBy("leaf").count().where(F.col("count") > CROWD).select("leaf"))
        parts = [compared(weighed.join(small(full), "leaf", "left_anti"), similar), compared(part.join(small(large), "leaf", "left_anti"), similar)]
        if large.limit(1).count():
            parts += crowded(part.join(small(large), "leaf", "left_semi"), similar)
        grouped = cut(reduce(DataFrame.unionByName, parts).where("line <> template"))
    else:
        grouped = cut(compared(weighed, similar).where("line <> template"))
    named = pairs.join(small(grouped), "line", "left").select("line", F.coalesce("template", "line").alias("template"), "id")
    docs_of = named.select("template", "id").distinct().groupBy("template").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n") >= min_docs)
    own = docs_of.select("template", "first_id")
    out = own.select(F.col("template").alias("line"), "template", "first_id").unionByName(grouped.join(own, "template").select("line", "template", "first_id"))
    if passage_docs is not None and passage_docs < min_docs:
        out = cut(out)
        same = pairs.where("passage").groupBy("line").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n") >= passage_docs)
        out = out.unionByName(same.join(out, "line", "left_anti").select("line", F.col("line").alias("template"), "first_id"))
    return cut(out)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR, key: str = "doc_id", text: str = "text", passage_docs: int | None = None) -> DataFrame:
    """docs with recurring lines taken out of `text`, and the columns `_lines`, `_dropped` (with further `_` if docs has such)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    drop = recurring(rows, min_docs, similar, passage_docs)
    names = docs.columns
    at, key_at = names.index(text), names.index(key)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    id_kind = rows.schema["id"].dataType
    whole = id_kind.typeName() in ("long", "integer")
    if whole and drop.count() <= BROADCAST_ROWS:
        got = drop.toArrow()
        line = got.column("line").to_numpy().view(np.uint64)
        order = np.argsort(line)
        lines, template, first = line[order], got.column("template").to_numpy()[order], got.column("first_id").to_numpy()[order]
        look = lambda batch, i: (lines, template, first)
    else:  # too many to broadcast: each document gets its own
        of = parsed(rows).join(drop, "line").groupBy("id").agg(F.collect_list(F.struct("line", "template", (F.col("first_id") == F.col("id")).alias("mine"))).alias("_own"))
        plain = plain.join(of.withColumnRenamed("id", f"c{key_at}"), f"c{key_at}", "left").select(*plain.columns, "_own")
        look = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, f"c{at}"):
            column, keys = batch.column(at), batch.column(key_at).to_pylist()
            p = parse(column)
            data, offsets = raw(column)
            drop_line = np.zeros(len(p["line"]), bool)
            row = p["row"]
            if look is not None:
                if len(lines):
                    place = np.minimum(np.searchsorted(lines, p["line"]), len(lines) - 1)
                    hit = np.flatnonzero(lines[place] == p["line"])
                    own = np.array([k is not None for k in keys])[row[hit]]
                    hit = hit[own]
                    drop_line[hit] = True
                    mine = hit[np.array([keys[r] for r in row[hit]], np.int64) == first[place[hit]]] if len(hit) else hit
                    _, once = np.unique(np.stack([row[mine], template[place[mine]]]), axis=1, return_index=True)
                    drop_line[mine[once]] = False
            else:
                owns = batch.column("_own").to_pylist()
                low = np.searchsorted(row, np.arange(len(keys) + 1))
                for i, own in enumerate(owns):
                    of_line = {x["line"]: x for x in own or ()}
                    seen = set()
                    for j in range(low[i], low[i + 1]):
                        x = of_line.get(int(p["line"][j : j + 1].view(np.int64)[0]))
                        if x is not None:
                            drop_line[j] = not x["mine"] or x["template"] in seen
                            seen.add(x["template"])
            keep = np.ones(len(data), bool)
            for j in np.flatnonzero(drop_line).tolist():
                a, b, end = p["begin"][j], p["end"][j], offsets[row[j] + 1]
                if b < end:
                    b += 1  # its line feed
                elif a > offsets[row[j]]:
                    a -= 1  # the last line takes the one before
                keep[a:b] = False
            texts = [None if t is None else bytes(data[a:b][keep[a:b]]).decode() for t, a, b in zip(column.is_valid().to_pylist(), offsets, offsets[1:], strict=False)] if drop_line.any() else column.to_pylist()
            texts = [t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist(), strict=True)]
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, column.type)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row[drop_line], minlength=n))], names=[*(f"c{i}" for i in range(len(names))), "_lines", "_dropped"])

    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)), "_lines long, _dropped long"])
    return plain.mapInArrow(run, schema).toDF(*names, fresh("_lines", names), fresh("_dropped", names))


def filter_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with recurring lines taken out; a document whose lines all went goes too."""
    lines, dropped = (F.col(fresh(c, docs.columns)) for c in ("_lines", "_dropped"))
    rows = dedup_lines(docs, key=key, text=text, passage_docs=PASSAGE_DOCS).where((dropped == 0) | (dropped < lines))
    return rows.drop(*(fresh(c, docs.columns) for c in ("_lines", "_dropped")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its remaining text, its lines and how many went."""
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), passage_docs=PASSAGE_DOCS)
    return rows.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), "text")

"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (PASSAGE bytes each, the last one shorter). A passage
is encoded by what its bytes and words look like: shares of character classes and of
their successions, word lengths, repeated words in the passage and in the document;
then by a small trained layer. Gated attention weights, learned from document labels
only, add the passages up; the weighted representation gives the score.

The model is trained on the driver from at most MAX_TRAIN labelled documents (the
smallest hashes of doc_id, each class at most half unless it is short) with at most
MAX_PASSAGES passages in all (later documents of that order, and single ones of over a
tenth of that, are left out), all learning steps in fixed order. Scoring is a map over whole texts; no shuffle.

Defined results: null and empty texts have one empty passage and so a score like any
other; labels that are not 0 or 1, null keys and labels without document are not used;
with labels of one class only, every score is that class's smoothed share; without
labels, 0.5. Repeated rows stay. Extra columns are passed through by `filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, fresh, pieces, small_batches, table
from .words import hashes, raw, windows, word_spans

PASSAGE = 512
MAX_TRAIN = 4000
MAX_PASSAGES = 60_000
THRESHOLD = 0.7
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY = 24, 12, 60, 0.01, 1e-3

#: Character classes: a letter per class, fixed.
CLASSES = 14
CLASS = np.full(256, 12, np.uint8)
CLASS[128:] = 11  # beyond ASCII
CLASS[:32] = 13
for _i, _chars in enumerate((b" \t", b"\n\r", b".", b",;:", b"!", b"?", b"|", b"#*$%&<>", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")):
    CLASS[list(_chars)] = _i
FEATURES = CLASSES + CLASSES * CLASSES + 6


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(passage features, offsets of each text's passages)."""
    data, offsets = raw(texts)
    size = np.diff(offsets)
    many = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate([[0], np.cumsum(many)])
    total = int(first[-1])
    row = np.repeat(np.arange(len(size)), size)
    at = first[row] + (np.arange(len(data)) - offsets[row]) // PASSAGE
    kind = CLASS[data].astype(np.int64)
    shares = np.bincount(at * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES)
    inner = at[1:] == at[:-1]
    pairs = np.bincount((at[:-1] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:])[inner], minlength=total * CLASSES * CLASSES).reshape(total, CLASSES * CLASSES)
    length = np.maximum(shares.sum(1), 1)
    begin, end, words = word_spans(data, offsets)
    h = hashes(data, begin, end)
    own = at[begin] if len(begin) else np.zeros(0, np.int64)
    n_words = np.bincount(own, minlength=total)
    order = np.lexsort((h, own))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
    n_distinct = np.bincount(own[order][new], minlength=total)
    three, w_at = windows(h, words, 3)
    doc = np.repeat(np.arange(len(size)), np.diff(w_at))
    order = np.lexsort((three, doc))
    new = np.ones(len(three), bool)
    new[1:] = (three[order][1:] != three[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    fresh = np.bincount(doc[order][new], minlength=len(size)) / np.maximum(np.diff(w_at), 1)
    x = np.empty((total, FEATURES), np.float32)
    x[:, :CLASSES] = shares / length[:, None]
    x[:, CLASSES:-6] = pairs / length[:, None]
    x[:, -6] = np.log1p(length)
    x[:, -5] = np.log1p(length / np.maximum(n_words, 1))
    x[:, -4] = n_distinct / np.maximum(n_words, 1)
    x[:, -3] = np.repeat(fresh, many)
    x[:, -2] = np.repeat(np.log1p(many), many)
    x[:, -1] = n_words == 0
    return x, first


class Attention:
    """h = tanh(x W); weight = softmax(w (tanh(h V) * sigmoid(h U))); score = sigmoid(sum(weight h) c + b)."""

    def __init__(self, mean, scale, params):
        self.mean, self.scale, self.p = mean, scale, params

    @staticmethod
    def forward(p, x, first):
        starts, many = first[:-1], np.diff(first)
        h = np.tanh(x @ p["W"] + p["w0"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), many))
        weight = e / np.repeat(np.add.reduceat(e, starts), many)
        z = np.add.reduceat(weight[:, None] * h, starts)
        return h, t, s, weight, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))

    @classmethod
    def fit(cls, x, first, y, seed: int = 7):
        """Adam on the balanced log loss, in mini-batches of whole bags."""
        rng = np.random.Generator(np.random.PCG64(seed))
        mean, scale = x.mean(0), x.std(0) + 0.02
        x = np.clip((x - mean) / scale, -6, 6).astype(np.float32)
        init = lambda *n: (rng.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
        p = {"W": init(x.shape[1], HIDDEN), "w0": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "a": init(ATTENTION), "c": init(HIDDEN), "c0": np.zeros(1, np.float32)}
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        step, n = 0, len(y)
        for epoch in range(EPOCHS):
            order = rng.permutation(n)
            for i in range(0, n, 128):
                own = order[i : i + 128]
                many = first[own + 1] - first[own]
                at = np.concatenate([[0], np.cumsum(many)])
                xs = x[np.repeat(first[own] - at[:-1], many) + np.arange(at[-1])]
                h, t, s, w, z, out = cls.forward(p, xs, at)
                d = ((out - y[own]) * balance[own] / len(own)).astype(np.float32)
                dz = d[:, None] * p["c"]
                g = {"c": z.T @ d, "c0": d.sum(keepdims=True)}
                dzr = np.repeat(dz, many, 0)
                dw = (dzr * h).sum(1)
                de = w * (dw - np.repeat(np.add.reduceat(w * dw, at[:-1]), many))
                g["a"] = (t * s).T @ de
                dts = de[:, None] * p["a"]
                dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
                g["V"], g["U"] = h.T @ dt, h.T @ ds
                dh = (w[:, None] * dzr + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
                g["W"], g["w0"] = xs.T @ dh, dh.sum(0)
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k in p:
                    grad = g[k] + (DECAY * p[k] if p[k].ndim > 1 else 0)
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return cls(mean.astype(np.float32), scale.astype(np.float32), p)

    def score(self, x, first):
        return self.forward(self.p, np.clip((x - self.mean) / self.scale, -6, 6), first)[-1].astype(np.float64)


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, x, first):
        return np.full(len(first) - 1, self.value)


def held_out(key: str = "doc_id") -> Column:
    """Column: rows whose labels are never learned from (a null key isn't one; its label isn't used either)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> Attention | Constant:
    """A model from labels (key, label) of documents in docs that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).where(~held_out(key)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    pick = known.withColumn("o", F.xxhash64(F.col("key").cast("string"), F.lit("fit")))
    low = pick.where("y = 0").orderBy("o", "key").limit(max_train // 2)
    high = pick.where("y = 1").orderBy("o", "key").limit(max_train // 2)
    chosen = low.union(high)  # at most max_train rows of three numbers

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    rows = rows.groupBy("key", "o", "y").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))  # of repeated keys one text
    rows = cut(rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).cast("long")))
    own, total = [], 0
    for r in sorted(rows.select("o", "key", "n").where(F.col("n") <= MAX_PASSAGES // 10).collect()):  # three numbers of max_train rows
        if total + r["n"] <= MAX_PASSAGES:
            own.append(r["key"])
            total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x, first = encode(batch.column("text"))
            x = x.astype("<f4")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "o", "y")), pa.array([x[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())], names=["key", "o", "y", "x"])

    bags = rows.where(F.col("key").isin(own)).select("key", "o", "y", "text").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, o long, y int, x binary").toArrow()  # MAX_PASSAGES at most
    got = sorted(zip(*(bags.column(c).to_pylist() for c in ("o", "key", "y", "x")), strict=True))
    discard(rows)
    xs, ys = [np.frombuffer(x, "<f4").reshape(-1, FEATURES) for *_, x in got], [y for _, _, y, _ in got]
    if not ys or min(ys) == max(ys):
        return Constant((sum(ys) + 1) / (len(ys) + 2))
    return Attention.fit(np.concatenate(xs), np.concatenate([[0], np.cumsum(list(map(len, xs)))]), np.array(ys, np.float64))


def score(docs: DataFrame, model: Attention | Constant, text: str = "text") -> DataFrame:
    """docs with the column `_score` (`_score_` and so on if it has one); whole texts, all columns kept."""
    small_batches(docs.sparkSession)
    at, names = docs.columns.index(text), docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, f"c{at}"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(*encode(batch.column(at))), pa.float64())], names=[*batch.schema.names, "_score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "_score double"])
    return plain.mapInArrow(run, schema).toDF(*names, fresh("_score", names))


def filter_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold."""
    name = fresh("_score", docs.columns)
    return score(docs, train(docs, labels, key, text), text).where(F.col(name) >= threshold).drop(name)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(*encode(batch.column("text"))), pa.float64())], names=["doc_id", "score"])

    rows = docs.mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

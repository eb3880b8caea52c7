"""Quality rules on tokeniser fertility, behind plain base rules.

Two public vocabularies read each distinct word once for each worker: a byte-level
one gives characters per token, a piece vocabulary with byte fallback gives the share
of fallback bytes and, over a text's pieces, the entropy of its tokens divided by the
largest entropy that as many tokens of that vocabulary can have. The band of a
language (else of the main script, else of all) lies around the median of all its
documents, some six standard deviations wide; a text outside is rejected.

Defined results: a null text has no words and fails the base rules, as any text of
under 50 words does; a null or unknown language uses the script's band. Metrics of a
text without tokens are null. Repeated rows stay; extra columns are ignored by
`judge` and passed through by `filter_documents`. Texts are read once; only the
bands' quantile sketches are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_level, cut, pieces, small_batches, table
from .words import SPACE, hashes, raw, spans, windows, word_spans

CACHE_WORDS = 300_000
#: A band reaches this many times the distance from the median to the upper quartile to either
#: side of the median (some six standard deviations of a normal spread), at least FLOOR times the median.
WIDTH, FLOOR = 9.0, 0.15
#: Documents that a language needs for a band of its own; else the band of the script holds.
LEAST_DOCS = 100
#: Languages that may have a band of their own, the most frequent first.
MOST_LANGS = 1000
METRICS = ("chars_per_token", "fallback_share", "token_entropy")
#: Fallback bytes up to this share are ordinary in any language.
FREE_FALLBACK = 0.10
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True


class Vocabularies:
    """Per distinct word: tokens of the byte-level vocabulary, ids of the piece vocabulary, fallback pieces."""

    def __init__(self, ranks: str, model: str):
        import sentencepiece

        self.bytes = byte_level(ranks)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = self.pieces.get_piece_size()
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.size)])
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.used = self.words = 0
        self.ids = np.zeros(1 << 16, np.int32)  # pieces of all known words, one after the other
        self.of_word = np.zeros((1 << 14, 4), np.int64)  # byte-level tokens, fallback pieces, begin and number of pieces

    @staticmethod
    def room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros((max(n, 2 * len(a)) - len(a), *a.shape[1:]), a.dtype)])

    def learn(self, keys: list[int], words: list[str]) -> None:
        ids = self.pieces.encode(words, num_threads=1)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        fall = np.concatenate([[0], np.cumsum(self.fallback[flat])])
        begin = np.cumsum(size) - size
        encode = self.bytes.encode_ordinary
        own = np.stack([np.fromiter((len(encode(" " + w)) for w in words), np.int64, len(words)), fall[begin + size] - fall[begin], begin + self.used, size], axis=1)
        self.ids, self.of_word = self.room(self.ids, self.used + len(flat)), self.room(self.of_word, self.words + len(words))
        self.ids[self.used : self.used + len(flat)] = flat
        self.of_word[self.words : self.words + len(words)] = own
        self.known.update(zip(keys, range(self.words, self.words + len(words)), strict=True))
        self.used += len(flat)
        self.words += len(words)

    def look_up(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A row of `of_word` for each word."""
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.reset()
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            at = first[new]
            self.learn([keys[i] for i in new], [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
        return self.of_word[np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))][back]


@lru_cache(maxsize=2)
def load(ranks: str, model: str) -> Vocabularies:
    return Vocabularies(ranks, model)


def _sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _row_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _seen_before(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier one of its row, equal to any other one of its row)."""
    order = np.lexsort((h, row))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    earlier, any_ = np.zeros(len(h), bool), same.copy()
    any_[:-1] |= same[1:]
    earlier[order] = same
    out = np.zeros(len(h), bool)
    out[order] = any_
    return earlier, out


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The plain counts of each text, and its words for the vocabularies."""
    data, offsets = raw(texts)
    n = len(offsets) - 1
    begin, end, rows = word_spans(data, offsets)
    h = hashes(data, begin, end)
    point = (data & 0xC0) != 0x80
    windows3, at = windows(h, rows, 3)
    row3 = _row_of(at)
    _, again = _seen_before(row3, windows3)
    covered = np.zeros(len(h) + 3, bool)
    start = np.arange(len(windows3)) + np.repeat(rows[:-1] - at[:-1], np.diff(at)) if len(windows3) else np.zeros(0, np.int64)
    for j in range(3):
        covered[start[again] + j] = True
    line_begin, line_end = spans(data != 0x0A, offsets)
    word_line = np.searchsorted(line_begin, begin, "right") - 1
    with_word = np.unique(word_line)
    line_begin, line_end = line_begin[with_word], line_end[with_word]
    line_row = np.searchsorted(offsets, line_begin, "right") - 1
    earlier, _ = _seen_before(line_row, hashes(data, line_begin, line_end))
    letters = LETTERS[data]
    return {
        "data": data, "begin": begin, "end": end, "rows": rows, "h": h,
        "n_words": np.diff(rows), "word_chars": _sum(point & ~SPACE[data], offsets), "n_symbols": _sum(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_row[earlier], minlength=n), "n_repeat_words": _sum(covered[: len(h)], rows),
        "latin": _sum(letters | ((data >= 0xC3) & (data <= 0xC9)), offsets) * 2 >= _sum(point & ~SPACE[data], offsets),
    }


def measure_batch(texts: pa.Array, ranks: str, model: str) -> dict[str, np.ndarray]:
    """Counts and fertility of each text."""
    c = base_counts(texts)
    v = load(ranks, model)
    tokens, fall, start, count = v.look_up(c["data"], c["begin"], c["end"], c["h"]).T
    n_tokens, n_pieces, n_fall = _sum(tokens, c["rows"]), _sum(count, c["rows"]), _sum(fall, c["rows"])
    total = int(count.sum())
    ids = v.ids[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)].astype(np.int64) if total else np.zeros(0, np.int64)
    row = _row_of(np.concatenate([[0], np.cumsum(n_pieces)]))
    pair, times = np.unique(row * v.size + ids, return_counts=True)
    own = pair // v.size
    p = times / np.maximum(n_pieces[own], 1)
    entropy = np.bincount(own, -p * np.log2(p), minlength=len(n_pieces))
    some = n_pieces > 0
    most = np.log2(np.clip(n_pieces, 2, v.size))
    out = {k: c[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    out |= {"chars_per_token": np.where(some, c["word_chars"] / np.maximum(n_tokens, 1), np.nan), "fallback_share": np.where(some, n_fall / np.maximum(n_pieces, 1), np.nan), "token_entropy": np.where(some, entropy / most, np.nan)}
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["latin"] = c["latin"]
    return out


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, fallback_share double, token_entropy double, base_failed boolean, latin boolean"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def measured(rows: DataFrame, ranks: str, model: str, text: str) -> DataFrame:
    """rows (of plain column names) with the counts and metrics of their texts in one struct column `_fertility`."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            out = measure_batch(batch.column(text), ranks, model)
            own = pa.StructArray.from_arrays([pa.array(out[c], from_pandas=True) for c in NAMES], names=NAMES)
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "_fertility"])

    fields = ", ".join(f"{c.split()[0]}: {c.split()[1].replace('long', 'bigint')}" for c in COLUMNS.split(", "))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"_fertility struct<{fields}>"])
    return rows.mapInArrow(run, schema)


def bands(rows: DataFrame, lang: str) -> dict[str, list[tuple[float, float]]]:
    """Per language and script, the (lowest, highest) allowed value of each metric, from all documents that pass the base rules.

    Aggregated before the shuffle; the driver gets at most MOST_LANGS + 3 rows.
    """
    f = F.col("_fertility")
    keys = F.array(F.concat(F.lit("lang:"), F.col(lang).cast("string")), F.when(f["latin"], "script:latin").otherwise("script:other"), F.lit("all"))
    own = rows.where(~f["base_failed"]).select(F.explode(keys).alias("k"), *(f[m].alias(m) for m in METRICS)).where("k is not null")
    stats = own.groupBy("k").agg(F.count("*").alias("n"), *(F.percentile_approx(m, [0.5, 0.75], 2000).alias(m) for m in METRICS))
    top = stats.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "k").limit(MOST_LANGS + 3).collect()
    out = {}
    for r in top:
        out[r["k"]] = []
        for m in METRICS:
            mid, upper = r[m]
            width = max(WIDTH * (upper - mid), FLOOR * mid)
            out[r["k"]].append((-1.0, max(FREE_FALLBACK, mid + width)) if m == "fallback_share" else (mid - width, mid + width))
    return out


def verdict(rows: DataFrame, lang: str, of: dict[str, list[tuple[float, float]]]):
    """Column: true if the row passes base rules and its band (language, else script, else all, else no band)."""
    f = F.col("_fertility")
    inside = lambda k: F.lit(True) if k not in of else F.coalesce(F.expr(" and ".join(f"_fertility.{m} between {low!r}D and {high!r}D" for m, (low, high) in zip(METRICS, of[k], strict=True))), F.lit(True))
    ok = F.when(f["latin"], inside("script:latin" if "script:latin" in of else "all")).otherwise(inside("script:other" if "script:other" in of else "all"))
    for k in sorted(x for x in of if x.startswith("lang:")):
        ok = F.when(F.col(lang).cast("string") == F.lit(k[5:]), inside(k)).otherwise(ok)
    return ~f["base_failed"] & ok


def judge(docs: DataFrame, ranks: str, model: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (key, counts, metrics, base_failed, kept), one for each row of docs."""
    plain = docs.select(F.col(key).alias("c0"), F.col(lang).alias("c1"), F.col(text).alias("c2"))
    rows = cut(measured(plain, ranks, model, "c2").drop("c2"))
    return rows.select(F.col("c0").alias(key), *(F.col("_fertility")[c].alias(c) for c in NAMES if c != "latin"), verdict(rows, "c1", bands(rows, "c1")).alias("kept"))


def filter_documents(docs: DataFrame, ranks: str, model: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that pass, with all their columns; texts are read by Python once."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # so that no name can clash
    own = lambda c: f"c{docs.columns.index(c)}"
    rows = cut(measured(plain, ranks, model, own(text)))
    return rows.where(verdict(rows, own(lang), bands(rows, own(lang)))).select(*plain.columns).toDF(*docs.columns)


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fertility and verdict of every document."""
    return judge(table(spark, sf_dir, "documents"), *paths())

"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The unigram model: the pieces of a public vocabulary, each with the score
-log(rank + 1) - log(H), H the harmonic sum, which is Zipf's law over the
vocabulary's own order; the vocabulary is never trained here. A character that no
piece covers costs the score of its UTF-8 bytes. A pre-token is a word (parted by
ASCII white space) behind the vocabulary's word mark; its token count is that of the
best-scored segmentation, on equal scores the one with fewer tokens.

The distinct pre-tokens of a batch go into a trie by sorting: a word shares with its
predecessor the nodes of their common prefix, so the forward score of each shared
prefix is computed once; the count at a word's last node is stored. Counts are kept
by word hash in the worker. No shuffle.

Defined results: null and empty texts have no words and no tokens; words of any
length are whole; repeated rows stay repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, small_batches, table
from .words import hashes, raw, word_spans

#: Words whose counts a worker keeps; beyond that it starts anew.
CACHE_WORDS = 1_000_000
MARK = "▁"


class Unigram:
    """Piece scores and the shared forward pass."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        self.longest = max(map(len, scores), default=1)
        self.known: dict[int, int] = {}

    @classmethod
    def from_model(cls, path: str) -> Unigram:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        total = math.log(sum(1 / (i + 1) for i in range(len(usual))))
        return cls({sp.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(usual)}, -math.log(len(usual) + 1) - total)

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each word; words must be sorted so that shared prefixes meet."""
        get, longest, byte_score = self.scores.get, self.longest, self.byte_score
        best, used, before, out = [0.0], [0], "", []  # forward score and tokens at each node of the current path
        for word in words:
            share, most = 0, min(len(word), len(before))
            while share < most and word[share] == before[share]:
                share += 1
            del best[share + 1 :], used[share + 1 :]
            for end in range(share + 1, len(word) + 1):
                n = len(word[end - 1].encode())
                top, least = best[end - 1] + n * byte_score, used[end - 1] + n
                for start in range(max(0, end - longest), end):
                    s = get(word[start:end])
                    if s is not None:
                        s += best[start]
                        if s > top or s == top and used[start] + 1 < least:
                            top, least = s, used[start] + 1
                best.append(top)
                used.append(least)
            out.append(used[-1])
            before = word
        return out

    def of_words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word of a batch; only distinct words that the worker hasn't met are scored."""
        h, first, back = np.unique(hashes(data, begin, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = [i for i, x in enumerate(h.tolist()) if x not in self.known]
        if new:
            at = first[new]
            texts = [MARK + bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
            order = sorted(range(len(new)), key=texts.__getitem__)
            keys = h[new].tolist()
            for i, n in zip(order, self.counts([texts[i] for i in order]), strict=True):
                self.known[keys[i]] = n
        return np.array([self.known[x] for x in h.tolist()], np.int64)[back] if len(h) else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    return Unigram.from_model(path)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, n_tokens), one for each row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in pieces(batches, "text"):
            data, offsets = raw(batch.column("text"))
            begin, end, rows = word_spans(data, offsets)
            total = np.concatenate([[0], np.cumsum(model.of_words(data, begin, end))])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(rows).astype(np.int64)), pa.array(total[rows[1:]] - total[rows[:-1]])], names=["key", "n_words", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_words long, n_tokens long").withColumnRenamed("key", key)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

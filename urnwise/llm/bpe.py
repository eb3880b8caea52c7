"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

All distinct pre-tokens of a batch that the worker hasn't met lie in one flat
symbol array. Each round looks every adjacent pair up by binary search in the
sorted array of mergeable pair keys, takes each word's lowest rank, and merges
its occurrences from the left, all words at once. Words without a mergeable
pair leave the array. No shuffle: encoding is a map over documents.

Defined results: a null text counts as empty (no ids, empty text). The string of
a special token inside a text becomes its id, as the tokenizers library does by
default. Other columns of the input are not touched or needed; repeated rows
stay repeated rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, small_batches, table

#: Pre-tokens whose ids a worker keeps; beyond that it starts anew.
CACHE_WORDS = 400_000
#: The byte-level pre-token pattern of the vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A tokenizer file's vocabulary and merges as arrays; encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.tokens = [b""] * (1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]))
        for text, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in text)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each (not empty) word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), NONE, np.int32)
        rank[:-1] = np.where(word[:-1] == word[1:], self.pair_ranks(symbols[:-1], symbols[1:]), NONE)
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.concatenate([first, [len(word)]]))
            least = np.repeat(np.minimum.reduceat(rank, first), count)
            live = least != NONE
            if not live.all():
                done.append((word[~live], symbols[~live]))
                symbols, word, rank, least = symbols[live], word[live], rank[live], least[live]
                if not len(symbols):
                    break
            hit = rank == least
            at = np.flatnonzero(hit)
            if len(at) > 1 and (at[1:] == at[:-1] + 1).any():  # equal symbols in a row: every second pair, from the left
                head = np.concatenate([[True], at[1:] != at[:-1] + 1])
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            for near in (new, new[new > 0] - 1):  # only pairs that touch a merged symbol change
                inner = near[near + 1 < len(word)]
                rank[near[near + 1 >= len(word)]] = NONE
                rank[inner] = np.where(word[inner] == word[inner + 1], self.pair_ranks(symbols[inner], symbols[inner + 1]), NONE)
        word = np.concatenate([w for w, _ in done])
        symbols = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return np.split(symbols[order], np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def learn(self, words: set[str]) -> None:
        """Put the packed ids of words into the worker's store."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(words)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.known.update(zip(part, (x.astype("<u4").tobytes() for x in self.merge([w.encode() for w in part])), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        cut = [self.split.split(t) if self.split and any(s in t for s in self.special) else [t] for t in texts]
        found = [[self.find(part) if i % 2 == 0 else part for i, part in enumerate(parts)] for parts in cut]
        words: set[str] = set()
        for parts in found:
            for part in parts[::2]:
                words.update(part)
        self.learn(words)
        get = self.known.__getitem__
        return [b"".join(b"".join(map(get, part)) if i % 2 == 0 else self.special[part].to_bytes(4, "little") for i, part in enumerate(parts)) for parts in found]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """One copy in each Python worker, kept between tasks."""
    return ByteBPE(path)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, ids, decoded): ids binary (little-endian unsigned 32-bit), decoded from those ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in pieces(batches, "text"):
            ids = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                names=["key", "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("key", key)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, ids array<int>)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in pieces(batches, "text"):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["key", "n_tokens", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, ids array<int>").withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, text) from an array<int> column of ids; null ids give an empty text."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    rows = rows.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    import public_tokenizers

    rows = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

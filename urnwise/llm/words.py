"""Words, lines and their 64-bit hashes for many texts at once, straight from Arrow's buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _weights(place: np.ndarray) -> np.ndarray:
    return mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_FIRST = _weights(np.arange(1 << 16))


def weights(place: np.ndarray) -> np.ndarray:
    """An odd 64-bit weight for each place, mixed from the place itself, so that no stretch of places has another's weights."""
    return _FIRST[place] if not len(place) or int(place.max()) < len(_FIRST) else _weights(place)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, row offsets into them); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of True that doesn't cross a row's end."""
    n = len(inside)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begin[cuts] = inside[cuts]
    end = np.zeros(n + 1, bool)
    end[1:] = inside
    end[1:n] &= ~inside[1:]
    end[cuts] = inside[cuts - 1]
    return np.flatnonzero(begin), np.flatnonzero(end)


#: Bytes that are hashed in one step; more strings, and longer ones, take several.
STEP = 4 << 20


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[begin:end], which don't overlap and are not empty."""
    out = np.zeros(len(begin), np.uint64)
    size = end - begin
    total = np.cumsum(size)
    low = 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + STEP, "right")))
        own = size[low:high]
        if high == low + 1:
            for at in range(0, int(own[0]), STEP):
                part = data[begin[low] + at : min(begin[low] + at + STEP, end[low])]
                out[low : low + 1] += ((part.astype(np.uint64) + np.uint64(1)) * weights(at + np.arange(len(part)))).sum(dtype=np.uint64)
        else:
            first = np.cumsum(own) - own
            place = np.arange(int(own.sum()), dtype=np.int64) - np.repeat(first, own)
            value = data[np.repeat(begin[low:high], own) + place].astype(np.uint64) + np.uint64(1)
            value *= weights(place)
            out[low:high] = np.add.reduceat(value, first)
        low = high
    return mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the offset of each row's first word."""
    begin, end = spans(~SPACE[data], offsets)
    return begin, end, np.searchsorted(begin, offsets)


def windows(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n hashes that stay inside a row, and their row offsets."""
    count = np.diff(offsets)
    many = np.maximum(count - n + 1, 0)
    out = np.concatenate([[0], np.cumsum(many)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    start = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], many)
    total, own = np.zeros(int(out[-1]), np.uint64), weights(np.arange(101, 101 + n))
    for j in range(n):
        total += h[start + j] * own[j]
    return mix(total), out

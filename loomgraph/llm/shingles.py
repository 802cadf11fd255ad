"""Vectorised hashing of words and word shingles over UTF-8 bytes.

A word is a maximal run of bytes other than space and U+0009..U+000D.  A text
of at least ``width`` words has one shingle per run of ``width`` words; a
shorter non-empty text has the single shingle of all its words; an empty or
blank text has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = 0xD1342543DE82EF95
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[i] = np.multiply.accumulate(grown)
    return _powers[0], _powers[1]


def utf8_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or one row where a row alone is longer."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it."""
    inner = np.zeros(len(raw) + 2, bool)
    inner[1:-1] = ~_IS_SPACE[raw]
    first = inner[1:] & ~inner[:-1]
    last = inner[:-1] & ~inner[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    joined = edge[inner[edge] & inner[edge + 1]]
    first[joined] = True
    last[joined] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, counts = word_spans(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    powers, inverses = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverses[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(_STEP)), counts


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes, text after text, and the offsets of each text's own."""
    words, at = word_hashes(raw, offsets)
    count = np.diff(at)
    each = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    text = np.repeat(np.arange(len(each)), each)
    i = np.arange(out[-1]) - out[text] + at[text]
    end = at[text + 1]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(i), np.uint64)
    for k in range(width):
        part = padded[i + k] * np.uint64(pow(_STEP, k + 1, 1 << 64))
        total += part if k == 0 else np.where(i + k < end, part, np.uint64(0))
    return mixed(total), out

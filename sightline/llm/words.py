"""Words of whole texts as numpy arrays: bounds and 64-bit hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. In UTF-8 these bytes never
occur inside a longer character, so byte runs are the words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER_BYTES = _BYTES.copy()
_LOWER_BYTES[65:91] = _BYTES[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES, 1 << (n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers.clear()
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


class Words(NamedTuple):
    """row: index of the text; start, end: bytes within data; hash: of the word's bytes."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def of_row(self) -> np.ndarray:
        """Bounds of each text's words: words of text i are bounds[i] up to bounds[i + 1]."""
        return np.searchsorted(self.row, np.arange(len(self.offsets)))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the len + 1 offsets into them; null reads as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(bounds):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def of_texts(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text in order. lower: A-Z hash as a-z."""
    data, offsets = text_bytes(texts)
    inside = ~_WHITE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(row, start, end, hash_of(data, start, end, lower), data, offsets)


def hash_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the given stretches of bytes (ascending, not overlapping)."""
    return _hashes(data, start, end, _LOWER_BYTES if lower else _BYTES)


def stripped(w: Words) -> Words:
    """The words without punctuation at their ends, hashed as a-z; a word of punctuation only stays."""
    inner = LETTER | DIGIT
    start, end = w.start.copy(), w.end.copy()
    for bound, step, at in ((start, 1, 0), (end, -1, -1)):
        open_ = np.arange(len(start))
        while len(open_):
            open_ = open_[(start[open_] < end[open_])]
            open_ = open_[~inner[w.data[bound[open_] + at]]]
            bound[open_] += step
    bare = start >= end
    start, end = np.where(bare, w.start, start), np.where(bare, w.end, end)
    return w._replace(start=start, end=end, hash=hash_of(w.data, start, end, lower=True))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word from prefix sums, a bounded stretch of bytes at a time."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        low = start[at]
        to = max(at + 1, int(np.searchsorted(end, low + SLICE_BYTES, side="right")))
        high = end[to - 1]
        powers, inverses = _power_tables(int(high - low))
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(table[data[low:high]] * powers[: high - low], out=sums[1:])
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64) * _BASE)
        at = to
    return out


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, by first word; texts' ends are for the caller."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(hashes) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        out = out * _BASE + hashes[i : i + size]
    return mix(out)


def stretches(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Hash of the words from start up to end and of a further number, by stretch."""
    powers, inverses = _power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers[: len(hashes)], out=sums[1:])
    more = (end - start).astype(np.uint64) * np.uint64(1 << 20) + extra.astype(np.uint64)
    return mix(mix((sums[end] - sums[start]) * inverses[start]) + more * _BASE)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, cut so that each slice holds about size bytes of the text column."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths.astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else []
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)

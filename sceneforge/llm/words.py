"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is a run of bytes other than space and the five control characters from
tab to carriage return. Words and runs of words are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
"""Texts are worked on in blocks of about this size; a longer text is a block of its own."""

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_VALUES[_SEPARATOR] = 0
_powers = np.ones((2, 1), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(size: int) -> np.ndarray:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if _powers.shape[1] < size:
        steps = np.empty((2, size), dtype=np.uint64)
        steps[:, 0] = 1
        steps[0, 1:] = np.uint64(_BASE)
        steps[1, 1:] = np.uint64(pow(_BASE, -1, 1 << 64))
        _powers = np.multiply.accumulate(steps, axis=1)
    return _powers


@dataclass
class Block:
    """Consecutive texts: their bytes, and for each text and word where it begins and ends."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    """Index of the first word of each text, and the number of words last."""

    def texts(self) -> int:
        return len(self.bounds) - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts()), np.diff(self.bounds))

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``length`` words inside one text, and the index of their first word."""
        count = len(self.hashes) - length + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(count, dtype=np.uint64)
        for k in range(length):
            total = (total + self.hashes[k:k + count]) * np.uint64(_BASE)
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))[:count] - length
        index = np.flatnonzero(np.arange(count) <= last)
        return mix(total[index]), index


def _block(first: int, data: np.ndarray, offsets: np.ndarray, fold: bool) -> Block:
    # comparisons of bytes take a fraction of a lookup's time
    if fold:
        data = data + ((data - np.uint8(ord("A")) < 26).view(np.uint8) << 5)
    inside = (data - np.uint8(9) > 4) & (data != 32)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    if len(starts):
        powers = _power_table(len(data))
        sums = np.add.reduceat(_BYTE_VALUES[data] * powers[0, :len(data)], starts)
        hashes = mix(sums * powers[1, starts] + (ends - starts).astype(np.uint64))
    else:
        hashes = np.zeros(0, dtype=np.uint64)
    return Block(first, data, starts, ends, hashes, np.searchsorted(starts, offsets))


def blocks(texts: pa.Array, fold: bool = False) -> Iterator[Block]:
    """Cut a column of texts into blocks; null is an empty text. ``fold`` lower-cases A-Z."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield _block(first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], fold)
        first = last


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

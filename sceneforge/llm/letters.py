"""Letter n-grams of many texts at once, as numpy arrays, and Kneser-Ney tables over them.

Text becomes one stream of 5-bit symbols: 0 ends a word, 1-26 are letters of
any case, 27 a digit, 28-31 bytes beyond ASCII. An n-gram of ``ORDER`` symbols
is a number below ``SIZE``, so every table here has a fixed size however large
the corpus is. A context never reaches beyond the start of its word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS, ORDER = 5, 4
SYMBOLS, SIZE = 1 << BITS, 1 << (BITS * ORDER)


def _symbol_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.int32)
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = k + 1
    table[ord("0"):ord("9") + 1] = 27
    table[128:] = 28 + (np.arange(128, 256) & 3)
    return table


_TABLE = _symbol_table()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of all texts in a row, where each text's begin, and where each word's begin.

    A word of n symbols has n + 1 n-grams: one ends at each symbol and one at the word's end.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    symbols = _TABLE[joined]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    inside = symbols > 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one end mark after each word
    place = np.concatenate(([0], np.cumsum(keep)))
    starts = np.concatenate(([0], place[ends]))
    symbols = symbols[keep]
    codes = symbols.copy()
    alive = np.ones(len(symbols), dtype=bool)
    for back in range(1, ORDER):
        before = np.zeros_like(symbols)
        before[back:] = symbols[:-back]
        alive &= before > 0
        codes |= np.where(alive, before, 0) << (BITS * back)
    ended = np.flatnonzero(symbols == 0)
    words = np.concatenate(([0], ended[:-1] + 1)) if len(ended) else ended
    return codes, starts, words


def _interpolated(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Absolute discounting of ``counts`` by context (rows of SYMBOLS), interpolated with ``lower``."""
    ones, twos = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    table = counts.reshape(-1, SYMBOLS)
    total = table.sum(axis=1, keepdims=True)
    kinds = np.count_nonzero(table, axis=1)[:, None]
    safe = np.maximum(total, 1)
    mixed = np.maximum(table - discount, 0) / safe + discount * kinds / safe * lower
    return np.where(total > 0, mixed, lower)


def shared_backoff(counts: np.ndarray) -> np.ndarray:
    """Kneser-Ney probabilities of the next symbol after ORDER - 1 symbols but the first.

    ``counts`` are the pooled n-gram counts of all classes. Lower orders count in
    how many contexts an n-gram occurs, not how often.
    """
    levels = []
    table = counts > 0
    for order in range(ORDER - 1, 0, -1):
        table = table.reshape(SYMBOLS, -1).sum(axis=0)  # distinct symbols before it
        levels.append(table)
        table = table > 0
    lower = np.full((1, SYMBOLS), 1.0 / SYMBOLS)
    for level in reversed(levels):
        rows = level.reshape(-1, SYMBOLS)
        repeated = np.tile(lower, (len(rows) // len(lower), 1))  # the same symbols but the first
        lower = _interpolated(rows, repeated)
    return lower


def log_ratio(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each n-gram, log P(last symbol | the others) in the first class minus that in the second."""
    lower = shared_backoff(first + second)
    lower = np.tile(lower, (SYMBOLS, 1))
    ratio = np.log(_interpolated(first, lower)) - np.log(_interpolated(second, lower))
    return ratio.reshape(-1).astype(np.float32)


BLOCK_BYTES = 2 << 20


def blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about BLOCK_BYTES, each with the index of its first."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > BLOCK_BYTES:
            yield first, texts[first:k]
            first, held = k, 0
        held += len(text)
    if first < len(texts):
        yield first, texts[first:]

"""Small vectorised helpers on bytes, words and hashes, used inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles.

    A-Z count as a-z; a word is a run of bytes other than space and tab to carriage return. A text of fewer than k
    words, but not none, has its whole word sequence as one shingle. Null has none.
    """
    words = text.lower().split() if text else []
    h = word_hashes(words)
    if not len(h):
        return h
    n = min(k, len(h))
    size = len(h) - n + 1
    s = np.full(size, n, np.uint64)
    for i in range(n):
        s = mix(s * MULT + h[i : i + size])
    return np.unique(s)


def chunks(sizes, most: int):
    """Index ranges of consecutive items of at most ``most`` together, or of one item that is larger."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield start, i
            start = i
            total = 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)

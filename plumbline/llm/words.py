"""Hashes of words, shingles and byte grams of whole batches of texts, computed with numpy.

Words are the runs of ``[^\\x20\\x09-\\x0D]``. Texts are joined with a white-space byte, so no word
crosses from one text to the next; hashes depend on the bytes of the word alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes of text hashed at a time; a longer text is a batch of its own.
CHUNK_BYTES = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A number for each byte.
BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


class Powers:
    """Powers of the base and of its inverse, kept for the longest batch seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        return self.up[:n], self.down[:n]


def rolling(values: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values; empty where there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    up, down = powers.of(len(values))
    sums = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * up, dtype=U, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def batches(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts with about ``most`` bytes each."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words begin and end."""
    blob = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    inside = ~_SPACE[blob]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]  # the last byte is white space, so every word ends
    up, down = powers.of(len(blob))
    sums = np.zeros(len(blob) + 1, dtype=U)
    np.cumsum(BYTE[blob] * up, dtype=U, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    bounds = np.concatenate(([0], np.searchsorted(starts, ends_of_texts)))
    return hashes, bounds


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of one text begin and end."""
    blob = np.frombuffer(text + b"\n", dtype=np.uint8)
    inside = np.concatenate(([False], ~_SPACE[blob]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def shingles(words: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; with fewer words, of the whole sequence."""
    if not len(words):
        return np.zeros(0, dtype=U)
    if len(words) < width:
        return mix(rolling(words, len(words), powers) + U(len(words)))
    return np.unique(rolling(words, width, powers))


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The minimum or maximum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def winnowed(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of ``width`` grams the smallest, and the places of all grams that are smallest somewhere.

    Equal runs have equal smallest grams at equal places within them, wherever they occur.
    """
    least = sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, dtype=U)
    most = sliding(np.concatenate((edge, least, edge)), width, np.maximum)
    return least, np.flatnonzero(grams == most)

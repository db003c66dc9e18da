"""Words and word shingles of texts as 64-bit hashes, for tasks in Python."""

from __future__ import annotations

import functools

import numpy as np

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


@functools.cache
def _word_points() -> np.ndarray:
    """Which code points are parts of words: letters, digits and the underscore."""
    return np.array([chr(p).isalnum() or p == 0x5F for p in range(0x110000)])


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, enough for texts of 2 ** bits characters."""
    out = np.full((2, 1 << bits), [[_FACTOR], [_INVERSE]], "u8")
    out[:, 0] = 1
    return tuple(np.cumprod(out, axis=1, dtype="u8"))


#: Longer texts than 2 ** LONG characters are hashed in parts, each from its first word on.
LONG = 17


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased runs of letters, digits and underscores, in order.

    A word's hash is a polynomial in its code points, the difference of two
    running sums divided by a power; no table of words is kept.
    """
    if not text:
        return np.zeros(0, "u8")
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    inside = np.concatenate([[False], _word_points()[points], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if points.size <= 1 << LONG:
        return _hashed(points, start, end)
    out, first = [], 0
    while first < start.size:
        last = max(first + 1, int(np.searchsorted(end, start[first] + (1 << LONG), side="right")))
        at, until = int(start[first]), int(end[last - 1])
        out.append(_hashed(points[at:until], start[first:last] - at, end[first:last] - at))
        first = last
    return np.concatenate(out) if out else np.zeros(0, "u8")


def _hashed(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _powers(max(10, int(points.size).bit_length()))
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum((points.astype("u8") + np.uint64(1)) * power[: points.size], dtype="u8")])
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype("u8"))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by place; a text with fewer words is one shingle, one without words has none."""
    n = min(n, len(words))
    if n == 0:
        return words
    size = len(words) - n + 1
    out = np.full(size, n, "u8")
    for k in range(n):
        out = (out ^ words[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mixed(out)

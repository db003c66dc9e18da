"""Texts into cues: the fewest that fit, evenly filled, or as many as there are weights.

Borders are chosen by whole numbers, so that no rounding decides between two.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# What a border costs or is worth, in tens of squared characters for cues and in characters for shares.
LONE, STOP = 500, 20
LONE_SHARE, STOP_SHARE, JOINING_SHARE = 1000, 12, 8
STOPS = r"""[,;:.!?…]["“”»]?$"""
ORDINAL = r"^\d+\.$"
# Words that a share may well begin with.
JOINING = ("a", "ale", "i", "nebo", "když", "že", "protože", "který", "která", "které", "kde", "než", "aby", "ani")


def _lone(word: str) -> bool:
    """A single letter or an ordinal, which belongs to the next word."""
    return (len(word) == 1 and word.isalpha()) or re.search(ORDINAL, word) is not None


def _stops(word: str) -> bool:
    return re.search(STOPS, word) is not None and re.search(ORDINAL, word) is None


def _furthest(at: np.ndarray, limit: int) -> np.ndarray:
    """For every word: where a cue that begins there ends at most; one word always fits."""
    n = len(at) - 1
    return np.maximum(np.searchsorted(at, at[:-1] + limit + 1, side="right") - 1, np.arange(1, n + 1))


def reflow(text: str, limit: int) -> list[str]:
    """The fewest cues of at most ``limit`` characters, with the least squared deviation from an even length and the best borders.

    A dynamic program over word borders.  What the first k cues can hold at
    most, and what the others must leave to them, bounds the borders of each
    step, so that its cost follows the text's length and the room that is left.
    """
    words, size = text.split(), len(text)
    n_words = len(words)
    if size <= limit or n_words < 2:
        return [" ".join(words)]
    at = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    ahead = _furthest(at, limit)
    last = [0]
    while last[-1] < n_words:  # filled greedily: the furthest border after k cues
        last.append(int(ahead[last[-1]]))
    n = max(-(-size // limit), len(last) - 1)
    if n > n_words:
        return words
    last += [n_words] * (n + 1 - len(last))
    back = np.searchsorted(ahead, np.arange(n_words + 1), side="left")  # the first word from which a border is in reach
    first = [n_words]
    for _ in range(n):
        first.append(int(back[first[-1]]) if first[-1] else 0)
    first = first[::-1]
    worth = np.array([LONE * _lone(w) - STOP * _stops(w) for w in words[:-1]] + [0], "i8") * (10 * n * n)
    low = lambda k: max(k, first[k])
    high = lambda k: min(last[k], n_words - (n - k))
    far = np.iinfo("i8").max // 4
    best, come = np.zeros(1, "i8"), []
    for k in range(1, n + 1):
        i, j = np.arange(low(k - 1), high(k - 1) + 1)[:, None], np.arange(low(k), high(k) + 1)[None, :]
        length = at[j] - at[i] - 1
        cost = (length * n - size) ** 2 + worth[j - 1]
        fits = (j > i) & ((length <= limit) | (j == i + 1))
        total = np.where(fits, best[:, None] + cost, far)
        come.append(total.argmin(axis=0) + low(k - 1))
        best = total.min(axis=0)
    cuts = [n_words]
    for k in range(n, 0, -1):
        cuts.append(int(come[k - 1][cuts[-1] - low(k)]))
    cuts = cuts[::-1]
    return [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def share_out(text: str, weights: list[int]) -> list[str]:
    """The text in as many parts as weights, in their proportion, at the best borders from the left; parts may be empty."""
    words, size = text.split(), len(text)
    if len(weights) <= 1 or len(words) <= 1:
        return [text]
    total = sum(weights)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    worth = np.array([LONE_SHARE * _lone(w) - STOP_SHARE * _stops(w) - JOINING_SHARE * (b.lower() in JOINING) for w, b in zip(words, words[1:], strict=False)], "i8")
    cuts, begin, given = [0], 0, 0
    for w in weights[:-1]:
        given += w
        cost = np.abs(ends[begin:-1] * total - size * given) + worth[begin:] * total
        begin += int(cost.argmin()) if cost.size else 0
        cuts.append(min(begin + 1, len(words)))
        begin = min(begin + 1, len(words) - 1)
    cuts.append(len(words))
    return [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def reflowed(text: Column, limit: int) -> Column:
    """Cues of a text, as an array; null stays null."""

    @pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else reflow(t, limit) for t in texts], dtype=object)

    return run(text)


def shared_out(text: Column, weights: Column) -> Column:
    """Parts of a text in proportion to an array of whole weights; null stays null, weights that sum up to nothing give one part."""

    @pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, shares in batches:
            yield pd.Series([None if t is None or w is None else share_out(t, [int(x) for x in w]) for t, w in zip(texts, shares, strict=True)], dtype=object)

    return F.when(F.aggregate(weights, F.lit(0).cast("bigint"), lambda a, x: a + x) > 0, run(text, weights)).when(text.isNotNull() & weights.isNotNull(), F.array(text))

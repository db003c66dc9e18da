"""Reflowed and shared out texts against all splits of short texts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cutloom.operators import reflow
from cutloom.operators.reflow import _lone, _stops

WORDS = ["a", "i", "3.", "12.", "ale", "konec.", "dlouhéslovo", "no,", "ano", "když", "tak!“", "…", "slovo"]


def texts(n, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        words = [rng.choice([*WORDS, "x" * rng.randrange(1, 18)]) for _ in range(rng.randrange(0, 11))]
        yield rng.choice([" ", "  "]).join(words) + rng.choice(["", " "]), rng


def all_splits(text, limit):
    """Of all splits into as few cues as there can be, the one of least cost."""
    w = text.split()
    if len(text) <= limit or len(w) < 2:
        return [" ".join(w)]
    for n in range(-(-len(text) // limit), len(w) + 1):
        found = []
        for c in itertools.combinations(range(1, len(w)), n - 1):
            cuts = [0, *c, len(w)]
            parts = [" ".join(w[a:b]) for a, b in itertools.pairwise(cuts)]
            if all(len(p) <= limit or " " not in p for p in parts):
                ends = [w[b - 1] for b in c]
                found.append((sum((len(p) * n - len(text)) ** 2 for p in parts) + 10 * n * n * sum(500 * _lone(x) - 20 * _stops(x) for x in ends), cuts[::-1], parts))
        if found:
            return min(found)[2]
    return w


def test_reflow_is_the_best_of_all_splits():
    for text, rng in texts(1500):
        limit = rng.randrange(4, 30)
        assert reflow.reflow(text, limit) == all_splits(text, limit), (text, limit)


def test_shares_keep_all_words_and_follow_weights():
    for text, rng in texts(500, seed=2):
        weights = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 6))]
        parts = reflow.share_out(text, weights)
        words = text.split()
        if len(weights) == 1 or len(words) < 2:
            assert parts == [text]
            continue
        assert len(parts) == len(weights) and " ".join(p for p in parts if p).split() == words
        # Border by border: no later border of the first cut is better.
        cost = []
        for i in range(len(words) - 1):
            c = abs(len(" ".join(words[: i + 1])) * sum(weights) - len(text) * weights[0])
            c += sum(weights) * (1000 * _lone(words[i]) - 12 * _stops(words[i]) - 8 * (words[i + 1].lower() in reflow.JOINING))
            cost.append((c, i))
        assert parts[0].split() == words[: min(cost)[1] + 1]


def test_long_text_costs_its_length():
    text = " ".join(f"slovo{i % 97}," if i % 7 == 0 else "abcd" for i in range(60_000))
    parts = reflow.reflow(text, 80)
    assert " ".join(parts) == text and max(map(len, parts)) <= 80


@pytest.mark.parametrize("text", [None, "", "   ", "x" * 500, "a b", "3. a 3. a 3. a"])
def test_odd_texts(spark, text):
    df = spark.createDataFrame([(text, [1, 2]), (text, None), (text, []), (text, [0, 0])], "text string, weights array<bigint>")
    got = df.select(reflow.reflowed(F.col("text"), 8).alias("a"), reflow.shared_out(F.col("text"), F.col("weights")).alias("b")).collect()
    assert all(r.a == (None if text is None else reflow.reflow(text, 8)) for r in got)
    assert [r.b for r in got] == ([None] * 4 if text is None else [reflow.share_out(text, [1, 2]), None, [text], [text]])

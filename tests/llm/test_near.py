"""Near-duplicate texts and passages against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cutloom.llm import ngramjoin, queries

SCHEMA = "doc_id long, text string, keys string, id string"


def shingle_set(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, threshold=0.8):
    sets = [shingle_set(t) if i is not None else set() for i, t, *_ in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    links = defaultdict(set)
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                common[j] += 1
        for j, c in common.items():
            if j != k and c >= threshold * (len(s) + len(sets[j]) - c) - 1e-9:
                links[k].add(j)
    low = [i for i, *_ in rows]
    changed = True
    while changed:
        changed = False
        for k, js in links.items():
            m = min([low[k], *[low[j] for j in js]])
            for j in [k, *js]:
                if low[j] != m:
                    low[j], changed = m, True
    return [(rows[k][0], low[k], len(links[k])) for k in range(len(rows))]


def test_depth():
    assert ngramjoin.depth_for(0.8) == 6
    assert 1 - (1 - 0.8**6) ** ngramjoin.TREES >= ngramjoin.RECALL


@pytest.mark.parametrize("tile", [8, 256])
def test_random_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(ngramjoin, "TILE", tile)
    random.seed(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = random.choices(words, k=random.randint(30, 400))
        for _ in range(random.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, len(w) // 60])):
                w[random.randrange(len(w))] = random.choice(words)
            rows.append((len(rows), " ".join(w), "x", "y"))
    rows += [(900, None, "x", "y"), (901, "", "x", "y"), (902, " .!", "x", "y"), (903, "Hi there", "x", "y"), (904, "hi THERE!", "x", "y"), (None, rows[0][1], "x", "y")]
    rows += [rows[3], rows[3], (905, "long " * 30000, "x", "y"), (906, "x y z " * 9, "x", "y")]
    got = ngramjoin.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert sorted(map(str, [(r.doc_id, r.class_id, r.n_links) for r in got])) == sorted(map(str, want))
    assert ngramjoin.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op9_recall(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (c, n) for i, c, n in brute(rows)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op9_ngram_join(spark, sf_dir).collect()}
    assert set(got) == set(want)
    assert sum(n for _, n in got.values()) >= 0.98 * sum(n for _, n in want.values())
    assert all(got[i][1] <= want[i][1] for i in want)


def test_prefixes_are_shortened_until_the_recall_is_met():
    low, high = np.zeros(ngramjoin.BINS), np.zeros(ngramjoin.BINS)
    low[800:810], high[990:] = 100, 100
    assert ngramjoin.shortened(low, 20, 6, 0.999) == 5 and ngramjoin.shortened(low, 20, 6, 0.99) == 6
    assert ngramjoin.shortened(high, 20, 6, 0.999) == 6 and ngramjoin.shortened(0 * low, 20, 6, 0.999) == 6
    assert ngramjoin.shortened(low, 5, 6, 0.999) < 4


def test_few_trees_still_find_all_links(spark):
    random.seed(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(30):
        base = random.choices(words, k=120)
        rows.append((2 * g, " ".join(base)))
        base[60:62] = random.choices(words, k=2)
        rows.append((2 * g + 1, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngramjoin.near_duplicates(df, trees=3).collect())
    assert got == sorted(brute(rows))


def test_equal_ids_of_other_texts_and_null_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, b + " more"), (3, None), (None, a), (4, ""), (1, a)]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 3, 0), (None, None, 0), (4, 4, 0)], key=str)
    assert ngramjoin.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0

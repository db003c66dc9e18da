"""Top-k search and vector dedup against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutloom.llm import embdedup, topk
from cutloom.llm.common import salted

SCHEMA = "vec_id long, embedding array<double>, label int, score string"
INF, NAN = float("inf"), float("nan")


def brute_top(rows, asked, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = list(dict.fromkeys((i, tuple(v)) for i, v in ok))
    out = []
    for q, v in ok:
        if asked(q):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_odd_rows(spark, monkeypatch):
    random.seed(5)
    rows = [(i, [random.choice([0.0, 0.0, 0.5, -0.25, random.uniform(-1, 1)]) for _ in range(6)], 0, "x") for i in range(300)]
    rows += [(400, None, 0, "x"), (401, [NAN] + [0.0] * 5, 0, "x"), (402, [INF] * 6, 0, "x"), (403, [None] + [1.0] * 5, 0, "x"), (None, [1.0] * 6, 0, "x")]
    rows += [(404, [], 0, "x"), (405, [0.0] * 6, 0, "x"), (406, [1.0, 1.0], None, "x"), rows[10], rows[10], rows[11]]
    rows += [(500 + i, [0.5] * 6, 1, "x") for i in range(50)]  # ties
    monkeypatch.setattr(topk, "BLOCK", 64)
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=7).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, lambda i: i % 10 == 0, 7)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = df.filter("vec_id < 3")
    assert topk.top_k(few, F.lit(True)).count() == 6


def test_top_k_of_large_numbers(spark):
    rows = [(i, [1e13 * (i + 1), float(i)], 0, "x") for i in range(12)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, k=3).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(i, i, 2**63 - 1) for i in (1, 2, 3)]
    rows = [(i, [1e6 * (i + 1), float(i)], 0, "x") for i in range(12)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, k=3).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i, s) for _, _, i, s in brute_top(rows, lambda i: i == 0, 3)]


def brute_links(rows, threshold):
    def ok(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    low, links = list(range(n)), [0] * n
    for a in range(n):
        for b in range(n):
            if a != b and ok(rows[a]) and ok(rows[b]) and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                x, y = x / abs(x).max(), y / abs(y).max()
                if rows[a][1] == rows[b][1] or x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a] += 1
                    low[b] = low[a] = min(low[a], low[b])
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(n):
                if a != b and ok(rows[a]) and ok(rows[b]) and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                    x, y = np.array(rows[a][1]), np.array(rows[b][1])
                    x, y = x / abs(x).max(), y / abs(y).max()
                    if (rows[a][1] == rows[b][1] or x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold) and low[a] != low[b]:
                        low[a] = low[b] = min(low[a], low[b])
                        changed = True
    return sorted((str(r[0]), links[i], str(rows[low[i]][0])) for i, r in enumerate(rows))


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "TILE", 16)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        v = rng.normal(size=8) if i % 3 == 0 else np.array(rows[-1][1]) + rng.normal(size=8) * 0.12
        rows.append((i, v.tolist(), int(i % 20 == 0), "x"))
    rows += [(100 + i, rows[3][1], rows[3][2], "x") for i in range(5)]  # copies
    rows += [(200, None, 0, "x"), (201, [0.0] * 8, 0, "x"), (202, [NAN] * 8, 0, "x"), (203, rows[0][1], None, "x"), (204, [1.0], 0, "x")]
    rows += [(206, [1e200] * 8, 0, "x"), (207, [1e-200] * 8, 0, "x"), (208, [None] * 8, 0, "x"), (209, [], 0, "x")]
    got = embdedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute_links(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embdedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_error_bound_holds():
    rng = np.random.default_rng(1)
    t = embdedup.Tile(list(range(200)), [1] * 200, (rng.normal(size=(200, 32)) * 10.0 ** rng.integers(-5, 5, (200, 1))).tolist())
    u = t.x / t.norm[:, None]
    for threshold in (-0.5, 0.0, 0.3):
        a, b = t.possible(t, threshold)
        assert set(zip(*np.nonzero(u @ u.T >= threshold), strict=True)) <= set(zip(a, b, strict=True))


def test_names_dealt_to_parts_never_pass_the_driver(spark):
    rows = spark.range(40).select("id", (F.col("id") % 3).alias("k"))
    names = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    joined = salted(rows, names, "k")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.name) for r in joined.collect()) == [(i, "ab"[i % 3]) for i in range(40) if i % 3 < 2]


@pytest.mark.parametrize("few", [0, 10_000])
def test_many_labels(spark, monkeypatch, few):
    # A label for every pair of vectors, labels' sizes joined and broadcast.
    monkeypatch.setattr(embdedup, "FEW", few)
    rows = [(i, [1.0, i // 2 + 1.0, float(i % 2) / 100], i // 2) for i in range(60)]
    got = embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(i, 1, i // 2 * 2) for i in range(60)]

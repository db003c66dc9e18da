"""Teasers on hand-made sentences, and random ones against plain loops."""

import random

from pyspark.sql import functions as F

from cutloom.operators import teasers

WORDS = "media_id long, seg_id long, pos long, w string, s_ms long, e_ms long, spk string"


def words(spark, sentences):
    """Sentences as (speaker, text, gap after in ms); words last 500 ms and follow without a gap."""
    t, rows = 0, []
    for i, (spk, text, gap) in enumerate(sentences, 1):
        for k, w in enumerate(text.split()):
            rows.append((1, i, k, w, t, t + 500, spk))
            t += 500
        t += gap
    return spark.createDataFrame(rows, WORDS)


SENTENCES = [
    ("A", "Za tři týdny. Takže to přišlo tak nějak", 0), ("A", "a byl pryč. Nikdo to nečekal vůbec…", 300), ("B", "Ano. Přesně.", 200), ("B", "Byla to strašná noc. Nikdy nezapomenu!", 300),
    ("A", "Proč jste to udělal? protože jsem musel.", 200), ("B", "Navíc to bylo drahé a zbytečné.", 150), ("C", "Jsem host a mluvím dlouho.", 400),
]


def test_units_and_candidates(spark):
    u = teasers.units(words(spark, SENTENCES))
    rows = {r.n: r for r in u.collect()}
    assert [rows[n].text for n in range(4)] == ["Za tři týdny.", "Takže to přišlo tak nějak", "a byl pryč.", "Nikdo to nečekal vůbec…"]
    assert [(rows[n].closed, rows[n].full) for n in range(4)] == [(True, False), (False, False), (True, False), (False, False)]
    assert rows[1].w0 == 3 and rows[11].full and len(rows) == 12
    # With every border silent, what begins and ends well stays.
    silent = teasers.borders(u).select("media_id", "pair_no", F.lit(100).alias("silence_ms"))
    got = {(r.n, r.last_n): r for r in teasers.candidates(u, silent, excluded=F.col("speaker") == "C").collect()}
    #  (0,0) ends where A goes on with a capital; 4 and 5 are answers; 6 and 7 are B's night; 7 is too short; 8 is followed by lower case; 10 begins with an opener.
    assert set(got) == {(0, 0), (6, 6), (6, 7), (8, 9)}
    assert got[6, 7].text == "Byla to strašná noc. Nikdy nezapomenu!" and got[6, 7].edge_ms == 100 and got[6, 7].dur_ms == 3000
    assert got[6, 6].before == "Ano. Přesně." and got[6, 6].after == "Nikdy nezapomenu! Proč jste to udělal?" and got[6, 7].after == "Proč jste to udělal? protože jsem musel."
    # By gaps between words only borders of sentences are pauses.
    assert {(r.n, r.last_n) for r in teasers.candidates(u).collect()} == {(6, 7), (8, 9), (11, 11)}
    assert {(r.n, r.last_n) for r in teasers.candidates(u, silent, avoid=F.col("n") == 7).collect()} >= {(6, 6)}
    assert teasers.candidates(u.limit(0), silent).count() == 0


def test_loops(spark):
    rng = random.Random(6)
    rows, want, goals = [], {}, []
    for p in range(200):
        n, target = rng.randrange(1, 14), rng.choice([15_000, 20_000, 30_000])
        ms = {c: rng.randrange(1500, 9000) for c in range(n)}
        order = rng.sample(range(n), rng.randrange(0, min(n, 6) + 1))
        rows += [(p, c, c + 1, order.index(c) if c in order else None, ms[c]) for c in range(n)]
        goals.append((p, target))
        order = order or list(range(n))[:2]
        total = lambda o, ms=ms: sum(ms[c] for c in o)
        while len(order) > 2 and total(order) > 1.2 * target:
            order.remove(max(order[1:-1], key=lambda c: ms[c]))
        for c in range(n):
            if total(order) < 0.85 * target and c not in order and total(order) + ms[c] <= 1.15 * target:
                order.insert(max(1, len(order) - 1), c)
        want[p] = (order, [c for c in range(n) if c not in order][:6])
    s = spark.createDataFrame(rows, "plan_id long, cand long, rank int, place int, dur_ms long")
    got = {}
    for r in sorted(teasers.assembled(s, spark.createDataFrame(goals, "plan_id long, target_ms long")).collect(), key=lambda r: (r.place or 0, r.spare or 0)):
        got.setdefault(r.plan_id, ([], []))[r.place is None].append(r.cand)
    assert got == want


def test_ranked(spark):
    rng = random.Random(2)
    rows = [(p, n, n + rng.randrange(2), rng.choice([100, 300]), *[rng.randrange(4) for _ in range(3)]) for p in range(20) for n in range(0, 40)]
    names = "plan_id long, n long, last_n long, edge_ms long, hook int, alone int, force int"
    got = {}
    for r in teasers.ranked(spark.createDataFrame(rows, names)).orderBy("rank").collect():
        got.setdefault(r.plan_id, []).append((r.n, r.last_n))
    for p in range(20):
        own = sorted((-(3 * h + 2 * a + 1.5 * f - (1.5 if e < 150 else 0)), n, z) for q, n, z, e, h, a, f in rows if q == p)
        kept = []
        for _, n, z in own:
            if len(kept) < 12 and all(z < a or b < n for a, b in kept):
                kept.append((n, z))
        assert got[p] == kept


def test_repair(spark):
    ranges = [(1, 1, [1, 2], 5000), (1, 2, [3], 4000), (1, 3, [7], 6000), (2, 1, [1], 5000), (2, 2, [2], 5000), (3, 1, [1], 9000), (3, 2, [2], 1000), (3, 3, [3], 1000)]
    spares = [
        (1, 1, [3], 2000, 2100, True), (1, 2, [20], 2000, 2100, False), (1, 3, [7, 8], 2000, 2100, True), (1, 4, [21], 9000, 9100, True), (1, 5, [22], 2000, 2100, True),
        (1, 6, [22, 23], 2000, 2100, True), (1, 7, [24], 2000, 2100, True), (2, 1, [9], 1000, 1000, True), (3, 1, [9], 1000, 1000, True),
    ]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = teasers.repaired(
        df(ranges, "plan_id long, ord long, ids array<bigint>, dur_ms long"), df([(1, 3), (2, 2), (3, 1)], "plan_id long, seg_id long"),
        df(spares, "plan_id long, ord long, ids array<bigint>, dur_ms long, range_ms long, clean boolean"), df([(1, 16_000), (2, 9000), (3, 12_000)], "plan_id long, target_ms long"),
    ).collect()
    of = lambda p: [r.ids for r in sorted(got, key=lambda r: r.place) if r.plan_id == p]
    assert of(1) == [[1, 2], [22], [24], [7]]  # clean, unused, short enough, before the last
    assert of(2) == [[1], [2]]  # only one would stay
    assert of(3) == [[1], [2], [3]]  # too little would stay

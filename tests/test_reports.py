"""Units of an outline, shares, summaries and hand-made fixes on small cases."""

from cutloom.operators import planning, quality, timeline


def test_outline_units(spark):
    picks = [(1, 1, i, 5 - i, i == 3, "t" if i == 4 else None, i) for i in (1, 2, 3, 4, 6, 7)]
    p = spark.createDataFrame(picks, "plan_id long, media_id long, seg_id long, priority long, core boolean, topic string, score long")
    rows = [(1, i, i * 1000, i * 1000 + d, who, q, g) for i, d, who, q, g in [(1, 400, "A", True, False), (2, 500, "B", False, False), (3, 300, "B", False, False), (4, 300, "A", False, True), (5, 1, "A", True, False), (6, 9, None, False, False), (7, 5, "A", False, True)]]
    s = spark.createDataFrame(rows, "media_id long, seg_id long, start_ms long, end_ms long, speaker string, question boolean, goes_on boolean")
    got = [(r.unit, r.first_id, r.n, r.dur_ms, r.priority, r.core, r.topic, r.score, r.speaker) for r in planning.outline_units(p, s).orderBy("unit").collect()]
    assert got == [(1, 1, 2, 900, 3, False, None, 1, "B"), (2, 3, 2, 600, 1, True, "t", 3, "B"), (3, 6, 2, 14, -2, False, None, 6, "")]


def test_share_and_summary(spark):
    used = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 1, 3)], "seq_id long, media_id long, seg_id long")
    s = spark.createDataFrame([(1, 1, 0, 500, "A"), (1, 2, 0, 300, None), (1, 3, 0, 201, "A")], "media_id long, seg_id long, start_ms long, end_ms long, speaker string")
    assert {(r.speaker, r.ms, r.pct) for r in timeline.speaker_share(used, s).collect()} == {("A", 701, 70), ("?", 300, 29)}
    runs = spark.createDataFrame([("m", 110, 100, 50, True), ("m", 95, 100, None, False), ("m", None, 100, 1, True), ("n", None, 100, 1, True)], "model string, length long, target long, overlap long, clean boolean")
    got = {tuple(r) for r in quality.run_summary(runs, ["model"]).collect()}
    assert got == {("m", 3, 2, 1, 50, 8), ("n", 1, 0, 0, 0, 0)}
    m = spark.createDataFrame([(1, 1, "x", 1.0), (1, 2, "x", 4.0), (1, 2, "y", 0.0)], "plan_id long, round long, measure string, value double")
    assert {tuple(r) for r in quality.measure_ranges(m).collect()} == {(1, "x", 2, 2.5, 1.0, 4.0), (1, "y", 1, 0.0, 0.0, 0.0)}


def test_fixes(spark):
    clips = spark.createDataFrame([(1, 1, 0, 5000), (1, 2, 1000, 7000), (1, 3, 2000, 7050), (2, 1, 0, 100)], "seq_id long, clip_ix long, start_ms long, in_ms long")
    fixes = spark.createDataFrame([(1, 1, 7040, 6540), (1, 2, 5059, 5000), (1, 3, 5060, 5000), (2, 1, 9000, 1)], "seq_id long, fix_no long, old_ms long, new_ms long")
    m = timeline.matched_fixes(clips, fixes)
    assert sorted((r.seq_id, r.fix_no, r.clip_ix, r.more_ms) for r in m.collect()) == [(1, 1, 2, 500), (1, 2, 1, 59), (1, 3, None, None), (2, 1, None, None)]
    things = [(1, 1, 0, 900, [(100, 1.0)]), (1, 2, 0, 1001, [(100, 1.0)]), (1, 3, 1009, 1200, [(1100, 1.0)]), (1, 4, 1010, 1200, [(1100, 1.0)]), (1, 5, 0, 5000, None), (1, 6, 1010, 5000, None), (2, 1, 0, 1, [])]
    x = spark.createDataFrame(things, "seq_id long, thing_no long, start_ms long, end_ms long, keys array<struct<t:bigint,v:double>>")
    got = {(r.seq_id, r.thing_no): (r.start_ms, r.end_ms, r.keys and [k.t for k in r.keys]) for r in timeline.shifted_by(x, m).collect()}
    assert got == {
        (1, 1): (0, 959, [100]), (1, 2): (0, 1560, [100]), (1, 3): (1068, 1759, [1159]), (1, 4): (1569, 1759, [1659]), (1, 5): (0, 5000, None), (1, 6): (1569, 5559, None), (2, 1): (0, 1, []),
    }


def test_unplaced(spark):
    points = spark.createDataFrame([(1, 5), (1, 50), (1, 50), (2, 5)], "media_id long, t_ms long")
    items = spark.createDataFrame([(1, 1, 1, 0, 20, 60)], "seq_id long, clip_ix long, media_id long, start_ms long, in_ms long, out_ms long")
    assert sorted(tuple(r) for r in timeline.unplaced(points, items).collect()) == [(2, 5)]

"""Rules that the star schema's texts have no cases for, by hand."""

from pyspark.sql import functions as F

from cutloom.functions import text as X
from cutloom.operators import audio, captions, intervals, planning, quality, sentences, speakers


def words(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "media_id long, w string, s_ms long, e_ms long, spk string")


def test_border_words_follow_end_marks(spark):
    rows = [("podle", 0, 300, "A"), ("sebe.", 310, 600, "A"), ("A", 620, 700, "A"), ("da", 710, 800, "B"), ("se", 810, 900, "B"), ("to", 910, 990, "B")]
    got = [r.spk for r in speakers.smoothed(words(spark, rows)).orderBy("s_ms").collect()]
    assert got == ["A", "A", "B", "B", "B", "B"]
    rows = [("to", 0, 100, "A"), ("je", 110, 200, "A"), ("ta", 210, 300, "A"), ("pravda.", 310, 500, "B"), ("Když", 510, 600, "B"), ("to", 610, 700, "B"), ("je", 710, 800, "B")]
    got = [r.spk for r in speakers.smoothed(words(spark, rows)).orderBy("s_ms").collect()]
    assert got == ["A", "A", "A", "A", "B", "B", "B"]


def test_lone_word_takes_its_neighbours_speaker(spark):
    rows = [("a", 0, 100, "A"), ("b", 110, 200, "B"), ("c", 210, 300, "A"), ("d", 310, 400, "A")]
    assert {r.spk for r in speakers.smoothed(words(spark, rows)).collect()} == {"A"}


def test_runs_keep_their_words(spark):
    rows = [("a.", 0, 100, "A"), ("b", 110, 200, "B"), ("b", 110, 200, "B"), ("c.", 210, 300, None), ("d", 310, 400, "A"), ("e", None, None, "B")]
    made = speakers.smoothed(words(spark, rows))
    assert "Join" not in made._jdf.queryExecution().sparkPlan().toString()
    assert sorted(((r.s_ms, r.e_ms) for r in made.collect()), key=str) == sorted((r[1:3] for r in rows), key=str)


def test_sentences_end_where_they_should(spark):
    rows = [("Ano.", 0, 300, "A"), ("Dobře", 320, 900, "A"), (",", 910, 950, "A"), ("tak.", 960, 1400, "A"), ("Dál", 1410, 1600, "A"), ("pauza", 2600, 2900, "A"), ("jiný", 2910, 3000, None)]
    got = [(r.text, r.n_words) for r in sentences.group_words(words(spark, rows)).orderBy("seg_id").collect()]
    assert got == [("Ano. Dobře, tak.", 4), ("Dál", 1), ("pauza", 1), ("jiný", 1)]


def test_ranges_never_merge_backwards(spark):
    r = spark.createDataFrame([(1, 1, 5, 5000, 6000), (1, 2, 6, 6100, 7000), (1, 3, 1, 1000, 2000), (1, 4, 2, 2300, 2500), (1, 5, 3, 2400, 2450)], "plan_id long, ord long, seg_id long, in_ms long, out_ms long")
    got = [(x.in_ms, x.out_ms, x.ids) for x in sentences.merge_in_order(r).orderBy("ord").collect()]
    assert got == [(5000, 7000, [5, 6]), (1000, 2500, [1, 2, 3])]


def test_questions_pull_their_answers(spark):
    s = spark.createDataFrame([(1, 1, "Proč?", "A"), (1, 2, "Proto.", "B"), (1, 3, "Kdy?", None), (1, 4, "Teď.", None), (1, 5, "Kde?", "A"), (1, 6, "Tady.", "A")], "media_id long, seg_id long, text string, speaker string")
    p = spark.createDataFrame([(9, 1, 1), (9, 1, 4), (9, 1, 5)], "plan_id long, media_id long, seg_id long")
    assert sorted(r.added for r in planning.missing_answers(p, s).collect()) == [2, 3]


def test_moderator_by_questions(spark):
    rows = [(1, i, "x" * 30, "AB"[i % 2]) for i in range(10)] + [(1, 20, "Proč?", "C"), (1, 21, "Ano", "C")]
    s = spark.createDataFrame(rows, "media_id long, seg_id long, text string, speaker string").withColumns({"start_ms": F.lit(0), "end_ms": F.length("text")})
    assert [r.speaker for r in speakers.moderator(s).collect()] == ["C"]
    assert [r.speaker for r in speakers.moderator(s.withColumn("speaker", F.when(F.col("speaker") == "A", "Moderátor").otherwise(F.col("speaker")))).collect()] == ["Moderátor"]


def test_cues_never_span_clips_and_never_overlap(spark):
    rows = [(1, k // 20, 300 * k, 300 * k + 250, "slovo," if k % 7 == 0 else "věta." if k % 11 == 0 else "a" if k % 5 == 0 else "delší", "A") for k in range(200)]
    w = spark.createDataFrame(rows, "seq_id long, clip_ix long, t0_ms long, t1_ms long, w string, spk string")
    c = captions.cues(w).orderBy("ord").collect()
    assert sum(len(r.text.split()) for r in c) == 200
    assert all(x.t1_ms <= y.t0_ms for x, y in zip(c, c[1:], strict=False))
    assert all(len(r.text) <= 80 for r in c)
    starts = {k * 300 * 20 for k in range(10)}
    assert starts <= {r.t0_ms for r in c}


def test_caption_faults(spark):
    lines = [["Dobrý den v", "Praze"], ["x" * 41], ["jdeme k"], ["slovo"], ["Konec."], ["malé písmeno"], ["a", "b", "c"]]
    rows = [(1, i, 3000 * i, 3000 * i + 2500, x) for i, x in enumerate(lines)] + [(1, 7, 20000, 20100, ["Rychlé."]), (1, 8, 20050, 29000, ["Dlouhé tu."])]
    got = {(r.ord, r.issue) for r in captions.issues(spark.createDataFrame(rows, "seq_id long, ord long, t0_ms long, t1_ms long, lines array<string>")).collect()}
    assert {(0, "one-letter line end"), (1, "long line"), (2, "ends with preposition"), (3, "orphan"), (5, "lower case"), (6, "too many lines"), (7, "too short"), (7, "too fast"), (8, "too long"), (8, "overlap")} <= got


def test_known_offset_is_found(spark):
    import random

    random.seed(1)
    base = [random.random() for _ in range(900)]
    rows = [(1, i, x) for i, x in enumerate(base)] + [(2, i, x) for i, x in enumerate(base[120:800])]
    f = spark.createDataFrame(rows, "media_id long, frame_no long, rms double")
    got = audio.offsets(spark.createDataFrame([(1, 2)], "ref_id long, other_id long"), audio.onsets(f), max_lag=400, guard=10).first()
    assert got.lag == 120 and got.confidence > 1.5


def test_word_errors(spark):
    df = spark.createDataFrame([(1, "a b c d".split(), "a x c".split()), (2, [], ["a"]), (3, ["a"], []), (4, list("kitten"), list("sitting"))], "media_id long, ref array<string>, hyp array<string>")
    assert sorted((r.media_id, r.n_ref, r.errors) for r in quality.word_alignment(df).collect()) == [(1, 4, 2), (2, 0, 1), (3, 1, 1), (4, 6, 3)]


def test_correction_rules(spark):
    t = spark.createDataFrame([("# nic",), ("",), ("bez rovnítka",), (" a b = c = d ",), ("= x",), ("y =",)], "value string")
    assert [(r.wrong, r.right) for r in X.correction_rules(t).collect()] == [("a b", "c = d")]
    d = spark.createDataFrame([("Tak hermes, Hermesovi a HERMES.",)], "t string")
    assert d.select(X.corrected(F.col("t"), [("hermes", "Hermés$1")])).first()[0] == "Tak Hermés$1, Hermesovi a Hermés$1."


def test_search_keeps_to_word_boundaries(spark):
    s = spark.createDataFrame([(1, 1, "jaký den"), (1, 2, "JÁ vím"), (1, 3, "nic"), (1, 4, "nic")], "media_id long, seg_id long, text string")
    assert [(r.seg_id, r.hit) for r in X.phrase_hits(s, "ja").orderBy("seg_id").collect()] == [(1, False), (2, True), (3, False)]


def test_lengths_in_briefs(spark):
    d = spark.createDataFrame([("sestřih 2 min 30 s",), ("90 sekund",), ("nic",)], "b string")
    assert [r[0] for r in d.select(X.target_seconds(F.col("b"))).collect()] == [150, 90, None]


def test_interval_core(spark):
    left = spark.createDataFrame([(1, 0, 100), (1, 25000, 26000), (2, 0, 50)], "k long, a long, b long")
    right = spark.createDataFrame([(1, 50, 30000, "x"), (1, 25500, 25600, "y"), (2, 51, 60, "z")], "k long, c long, d long, n string")
    got = sorted((r.k, r.a, r.n) for r in intervals.overlap_join(left, right, ["k"], "a", "b", "c", "d").collect())
    assert got == [(1, 0, "x"), (1, 25000, "x"), (1, 25000, "y")]
    assert intervals.overlap_join(left, right, ["k"], "a", "b", "c", "d", how="left").filter("n is null").count() == 1
    assert intervals.overlap_join(left, right, ["k"], "a", "b", "c", "d", slack_ms=1).count() == 4


def test_removed_time_adds_up(spark):
    from cutloom.operators import timeline

    clips = spark.createDataFrame([(1, 1, 1, 0, 40000, 250000)], "seq_id long, clip_ix long, media_id long, start_ms long, end_ms long, in_ms long")
    holes = spark.createDataFrame([(1, 10000, 15000)], "seq_id long, h_start long, h_end long")
    got = sorted((r.start_ms, r.end_ms, r.in_ms) for r in timeline.remove_ranges(clips, holes).collect())
    assert got == [(0, 10000, 250000), (10000, 35000, 265000)]


def test_edges_move_outward_to_silence(spark):
    loud = [(1, i, 1000.0 if 20 <= i < 43 else 1.0) for i in range(80)] + [(2, i, 1000.0 + i) for i in range(80)]
    f = spark.createDataFrame(loud, "media_id long, frame_no long, rms double")
    p = spark.createDataFrame([(1, 1, 2000, True, 400, 100), (1, 2, 1100, False, 400, 100), (2, 1, 2000, True, 400, 100), (3, 1, 500, True, 400, 100)], "media_id long, point_no long, at_ms long, at_end boolean, extend_ms long, fallback_ms long")
    got = {(r.media_id, r.point_no): (r.time_ms, r.clean) for r in audio.refined_edges(p, f, 50).collect()}
    # 43 * 50 + 30 after the speech, 19 * 50 - 30 before it; without silence the quietest frame's end; without sound the edge itself
    assert got == {(1, 1): (2180, True), (1, 2): (920, True), (2, 1): (2050, False), (3, 1): (500, False)}


def test_lines_skip_pauses(spark):
    lines = spark.createDataFrame([(1, 1, 0, "abcd"), (1, 1, 1, "efgh")], "media_id long, block_no long, line_no long, text string")
    spans = spark.createDataFrame([(1, 1, 0, 500), (1, 1, 2000, 2400)], "media_id long, block_no long, s_ms long, e_ms long")
    got = [(r.t0_ms, r.t1_ms) for r in captions.spread(lines, spans).orderBy("line_no").collect()]
    assert got == [(0, 400), (500, 2400)]

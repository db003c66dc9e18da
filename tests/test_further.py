"""Small cases of speeds, edges, inventions, names, pairs, beds, voices and phrase fixes."""

from pyspark.sql import functions as F

from cutloom.functions import text as X
from cutloom.operators import assembly, audio, captions, multicam, planning, sentences, speakers, timeline


def test_words_at_speed(spark):
    clips = spark.createDataFrame([(1, 1, 7, 1000, 0, 4000, 200), (1, 2, 7, 5000, 0, 4000, None), (1, 3, 7, 9000, 0, 4000, 75)], "seq_id long, clip_ix long, media_id long, start_ms long, in_ms long, out_ms long, speed_pct int")
    words = spark.createDataFrame([(7, 1, 0, "x", 1001, 1500, "A")], "media_id long, seg_id long, pos long, w string, s_ms long, e_ms long, spk string")
    got = [(r.clip_ix, r.t0_ms, r.t1_ms) for r in timeline.words_on_timeline(clips, words).orderBy("clip_ix").collect()]
    assert got == [(1, 1501, 1750), (2, 6001, 6500), (3, 10335, 11000)]


def test_audible_edges(spark):
    frames = spark.createDataFrame([(1, n, 1000.0 if 20 <= n < 60 else 10.0) for n in range(100)], "media_id long, frame_no long, rms double")
    words = spark.createDataFrame([(1, "loud", 1000, 2000), (1, "late", 2900, 3500)], "media_id long, w string, s_ms long, e_ms long")
    edges = [(1, 1, 1, "in", 1500), (1, 1, 1, "out", 3300), (1, 2, 1, "out", 2950), (1, 3, 2, "in", 100), (1, 4, 1, "in", 900), (1, 5, 1, "in", 1500)]
    e = spark.createDataFrame(edges, "seq_id long, clip_ix long, media_id long, edge string, t_ms long")
    got = {(r.clip_ix, r.edge): (r.w, r.cuts, r.loud, r.bad) for r in audio.audible_edges(e, words, frames, 50, outside_ms=100).collect()}
    assert got[1, "in"] == got[5, "in"] == ("loud", True, True, True)
    assert got[1, "out"] == ("late", False, False, False)  # silent, though a word says otherwise
    assert got[2, "out"] == ("late", True, True, True) and got[3, "in"] == (None, False, False, False) and got[4, "in"] == (None, False, False, False)


WORDS = "media_id long, seg_id long, pos long, w string, s_ms long, e_ms long, p double"


def test_inventions(spark):
    rows = [(1, 1, 0, "Titulky", 0, 500, 0.9), (1, 1, 1, "vytvořil", 500, 900, 0.9), (1, 2, 0, "—", 0, 100, 0.9), (1, 2, 1, "slovo", 100, 200, 0.9)]
    rows += [(1, 3, 0, "řídce", 0, 9000, 0.9), (1, 4, 0, "nejistě", 0, 300, 0.3), (1, 5, 0, " ", 0, 1, 0.9), (1, 6, 0, "www.x", 0, 9000, 0.1)]
    w = spark.createDataFrame(rows, WORDS)
    assert sorted(r.w for r in sentences.without_inventions(w).collect()) == ["nejistě", "slovo", "řídce"]
    assert {(r.seg_id, r.reason) for r in sentences.doubtful(w).collect()} == {(1, "invented"), (3, "sparse"), (4, "unsure"), (6, "invented")}
    silence = spark.createDataFrame([(1, 2, 0.6), (1, 3, 0.61)], "media_id long, seg_id long, no_speech double")
    assert {r.seg_id for r in sentences.accepted(w, silence).collect()} == {2}


def test_named_speakers(spark):
    briefs = ["jen Vašíře", "co říká nám dnes paní Ferancová", "jen tak o tom, co nám dnes řekne Ferancová", "S1 jen S1", "všichni", "Jenom Vašíř", None]
    b = spark.createDataFrame([(i, 1, t) for i, t in enumerate(briefs)], "brief_id long, media_id long, brief string")
    s = spark.createDataFrame([(1, n) for n in ("Vašíř Nový", "Ferancová", "S1", "", None)] + [(2, "Vašíř")], "media_id long, speaker string")
    assert sorted(tuple(r) for r in assembly.speakers_named(b, s).collect()) == [(0, "Vašíř Nový"), (1, "Ferancová")]


def test_normal_forms_and_stems(spark):
    df = spark.createDataFrame([("Příliš ŽLUŤOUČKÝ Ǖ Ё й́ é ø ł 한",)], "t string")
    assert df.select(X.normal(F.col("t"))).first()[0] == "prilis zlutoucky u е и e ø ł 한"
    s = spark.createDataFrame([(1, 1, "Viděli Pavloviček."), (1, 2, "nic"), (1, 3, "nic"), (2, 1, "Pavlovičky a (x)"), (2, 2, "pavlovičkami")], "media_id long, seg_id long, text string")
    got = sorted(tuple(r) for r in X.phrase_or_stem_hits(s, "pavlovicky").collect())
    assert got == [(1, 1, True, True), (1, 2, False, True), (2, 1, True, False), (2, 2, False, False)]
    assert [r.hit for r in X.phrase_or_stem_hits(s, "a (x", context=0).collect()] == [True]


def test_pairs(spark):
    rows = [(i, "A" if i % 2 else "B", "?") for i in range(1, 5)] + [(5, "A", "."), (6, "B", "?"), (7, "B", "."), (9, None, "?"), (10, None, "."), (11, "H", "?"), (12, "A", ".")]
    s = spark.createDataFrame([(1, i, who, f"x{mark}") for i, who, mark in rows], "media_id long, seg_id long, speaker string, text string")
    out = spark.createDataFrame([(1, "H")], "media_id long, speaker string")
    of = lambda *ids: sorted((r.seg_id, r.added) for r in planning.with_pairs(spark.createDataFrame([(1, 1, i) for i in ids], "plan_id long, media_id long, seg_id long"), s, out).collect())
    assert of(2) == [(1, True), (2, False), (3, True), (4, True), (5, True)]  # its question, and the chain of answers
    assert of(5) == [(4, True), (5, False)]
    assert of(6) == [(6, False)] and of(7) == [(7, False)]  # one speaker goes on
    assert of(10) == [(9, True), (10, False)] and of(12) == [(12, False)]  # a host's question stays out


def test_beds_and_voices(spark):
    spans = spark.createDataFrame([(1, 1, 500, 2500), (1, 2, 9000, 9500)], "media_id long, range_no long, start_ms long, end_ms long")
    sounds = spark.createDataFrame([(1, "a", 0, 2), (1, "b", 1000, None), (1, "c", 2490, 0), (1, "d", -500, 0)], "media_id long, source string, offset_ms long, track int")
    got = sorted((r.source, r.range_no, r.track, r.in_ms, r.at_ms, r.dur_ms) for r in multicam.audio_beds(spans, sounds).collect())
    assert got == [("a", 1, 2, 500, 0, 2000), ("a", 2, 2, 9000, 2000, 500), ("b", 1, 0, 0, 500, 1500), ("b", 2, 0, 8000, 2000, 500), ("c", 2, 0, 6510, 2000, 500), ("d", 1, 0, 1000, 0, 2000), ("d", 2, 0, 9500, 2000, 500)]
    rows = [(1, 1, "x", 100, None, 4000, 9000, 5000), (1, 2, "y", 8000, None, 6000, 9000, 9000), (1, 3, "z", 0, 5760, 100, 9000, None), (1, 4, "x", 0, None, None, 9000, None)]
    v = spark.createDataFrame(rows, "job_id long, ord long, source string, in_ms long, at_ms long, start_ms long, total_ms long, media_ms long")
    got = sorted(tuple(r) for r in planning.voice_over_segments(v).collect())
    assert got == [(1, 1, "x", 0, 0, 5750), (1, 3, "z", 0, 5760, 3240)]  # the second one lasts 10 ms


def test_phrase_fixes(spark):
    words = spark.createDataFrame([(1, 1, 0, 300, "Kloda"), (1, 1, 300, 600, "klóda"), (1, 1, 600, 900, "ti.")], "seq_id long, clip_ix long, t0_ms long, t1_ms long, w string")
    got = captions.fast_cues(words, {"klóda": "Claude,", "kloda": "cloud"}, [("CLOUD C", "K+C"), ("TI", "TY")]).collect()
    assert [r.text for r in got] == ["K+CLAUDE TY"]
    plain = captions.fast_cues(words, {"klóda": "Claude"}).collect()
    assert [r.text for r in plain] == ["CLAUDE CLAUDE TI"]


def test_sentence_speakers(spark):
    chunks = spark.createDataFrame([(1, k, 1, k * 1000, k * 1000 + d) for k, d in enumerate([900, 400, 500])] + [(1, 9, 2, 0, 100)], "media_id long, chunk_no long, seg_id long, start_ms long, end_ms long")
    found = spark.createDataFrame([(1, 0, "A", -0.5, 0.1), (1, 1, "B", 0.5, 0.1), (1, 2, "B", 0.2, 0.1), (1, 9, "C", 0.9, 0.1)], "media_id long, chunk_no long, person string, similarity double, margin double")
    assert {(r.seg_id, r.person) for r in speakers.sentence_speakers(chunks, found).collect()} == {(1, "B"), (2, "C")}


def test_newest_names(spark):
    rows = [(i, f"2024-01-{1 + i % 28:02d}", "Záznam" if i % 3 else "jiný") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, at string, name string").repartition(7)
    got = {r.id: r.place for r in planning.newest_names(df, "zazn", "id", "at").collect()}
    want = sorted((r for r in rows if r[2] == "Záznam"), key=lambda r: (r[1], r[0]), reverse=True)
    assert got == {r[0]: k for k, r in enumerate(want, 1)}

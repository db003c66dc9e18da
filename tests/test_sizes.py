"""Joins that must not pass the driver, single samples, and letters that Java would spread."""

import pytest
from pyspark.sql import functions as F

from cutloom import plans
from cutloom.functions import text as X
from cutloom.operators import captions, multicam, pictures, sentences, speakers
from cutloom.plans import media
from cutloom.plans.registry import Tables


def broadcasts(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


@pytest.mark.parametrize("name", ["n03_offsets", "n04_silences", "n07_sentence_pauses"])
def test_frames_never_pass_the_driver(spark, sf_dir, name):
    text = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for line in text.splitlines():
        if "Join" in line and ("frame_no" in line or "_lb" in line or "ref_id" in line):
            assert "Broadcast" not in line, line


def test_frames_are_made_without_joins(spark, sf_dir):
    f = media.frames(Tables(spark, sf_dir))
    assert "Join" not in f._jdf.queryExecution().sparkPlan().toString()
    assert f.count() == f.select("media_id", "frame_no").distinct().count()


def test_grids_never_pass_the_driver(spark):
    t = spark.createDataFrame([(1, 0, 3000, "a")], "media_id long, start_ms long, end_ms long, label string")
    assert broadcasts(multicam.grid_accuracy(t, t)) == 0
    turns = t.select("media_id", F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end"), F.col("label").alias("speaker"))
    runs = t.select("media_id", F.lit(1).alias("cam"), "start_ms", "end_ms", F.lit(False).alias("cutaway"))
    seen = multicam.camera_accuracy(turns, runs, {"a": 1})
    assert broadcasts(seen) == 0
    assert [tuple(r) for r in seen.collect()] == [(1, 17, 17)]


def test_one_sample_is_a_shot(spark):
    s = spark.createDataFrame([(1, 500, 6000, [1, 2])], "media_id long, t_ms long, step_ms long, pixels array<long>")
    d = spark.createDataFrame([(1, 800)], "media_id long, duration_ms long")
    assert [tuple(r) for r in pictures.still_shots(s, d).collect()] == [(1, 1, 500, 800, 1)]


def test_large_letters_stay_single(spark):
    x = spark.createDataFrame([("ßaé ﬁ ŉ ᾳ",), ("",), (None,)], "t string").select(X.large(F.col("t"))).collect()
    assert [r[0] for r in x] == ["ẞAÉ ﬁ ŉ ᾼ", "", None]
    c = spark.createDataFrame([(1, 1, 1, "ß als")], "seq_id long, ord long, clip_ix long, text string")
    assert captions.capitalised(c).first()["text"] == "ẞ als"


@pytest.mark.parametrize("name", ["j21_grid_accuracy", "m07_camera_accuracy"])
def test_grid_queries_never_pass_the_driver(spark, sf_dir, name):
    assert broadcasts(plans.QUERIES[name](spark, sf_dir)) == 0


def test_folds_take_many_groups_at_once(spark):
    words = spark.createDataFrame([(1, 1, 0, 2600), (1, 1, 2700, 3000), (1, 2, 4000, 4100), (2, 1, 10, 20)], "media_id long, seg_id long, s_ms long, e_ms long")
    chunks = speakers.voice_chunks(words)
    assert sorted(tuple(r) for r in chunks.collect()) == [(1, 1, 1, 0, 3000), (1, 2, 1, 4000, 4100), (2, 1, 1, 10, 20)]
    ranges = spark.createDataFrame([(1, 2, 8, 500, 700), (1, 1, 7, 0, 400), (1, 3, 2, 2000, 2200)], "plan_id long, ord long, seg_id long, in_ms long, out_ms long")
    merged = sentences.merge_in_order(ranges)
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 1, 0, 700, [7, 8]), (1, 2, 2000, 2200, [2])]
    for df in (chunks, merged):
        assert "FlatMapGroups" not in df._jdf.queryExecution().sparkPlan().toString()


def test_cues_take_many_clips_at_once(spark):
    rows = [(1, 1, 0, 300, "Ano.", "a"), (1, 1, 2000, 2400, "Dnes", "b"), (1, 2, 2500, 2900, "ne", "b"), (2, 1, 0, 100, "x", "a")]
    made = captions.cues(spark.createDataFrame(rows, "seq_id long, clip_ix long, t0_ms long, t1_ms long, w string, spk string"))
    assert "FlatMapGroups" not in made._jdf.queryExecution().sparkPlan().toString()
    assert sorted(tuple(r) for r in made.select("seq_id", "ord", "text", "clip_ix").collect()) == [(1, 1, "Ano.", 1), (1, 2, "Dnes", 1), (1, 3, "ne", 2), (2, 1, "x", 1)]


def made(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_sentences_are_made_without_their_words(spark, tmp_path):
    rows = [(1, 0, "user", "a b. c"), (1, 0, "user", "a b. c"), (1, 1, "system", "d  e\nf."), (1, None, "user", "n"), (None, 0, None, "q "), (2, 0, "user", " "), (2, 1, "user", None), (2, 2, "user", "x. " * 70)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    t = Tables(spark, str(tmp_path))
    assert "Generate" not in made(t.segments)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ")
    plain = t.words.groupBy("media_id", "seg_id").agg(F.min("s_ms"), F.max("e_ms"), text, F.min("spk"), F.count("*"))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, t.segments.collect()), key=str)


def test_pauses_make_words_once(spark, sf_dir):
    assert made(plans.QUERIES["w01_pauses"](spark, sf_dir)).count("Generate explode") + made(plans.QUERIES["w01_pauses"](spark, sf_dir)).count("Generate posexplode") == 1


def test_durations_make_no_words(spark, sf_dir):
    assert made(plans.QUERIES["w02_remove_pauses"](spark, sf_dir)).count("Generate posexplode") == 3


def test_plans_are_snapped_many_at_once(spark, sf_dir):
    assert "FlatMapGroups" not in made(plans.QUERIES["p09_snapped_to_pauses"](spark, sf_dir))


def test_motion_stays_where_it_is(spark, sf_dir):
    # Neither wide frames nor their numbers are shuffled, only sums by span; the one broadcast side is the seats'.
    text = plans.QUERIES["v05_moving_speakers"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in text.splitlines() if "Exchange" in line and ("frame_no" in line or "_lb" in line)]
    assert not [line for line in text.splitlines() if "BroadcastHashJoin" in line and "set_id" in line and "BuildLeft" in line]


def test_energies_of_long_and_overlapping_spans(spark, monkeypatch):
    monkeypatch.setattr(pictures, "FRAMES", 8)
    motion = {(m, f): [(f * 7 + m + j) % 11 for j in range(20)] for m in (1, 2) for f in range(-20, 60)}
    spans = [(1, 0, 1, -13, 41), (2, 0, 1, 0, 8), (3, 1, 1, 7, 9), (4, 1, 2, 30, 400), (5, 0, 2, 5, 5), (6, 7, 2, 0, 9), (7, 0, 3, 0, 9)]
    seats = [(0, "A", 100), (0, "B", 600), (1, "A", 300)]
    want = {}
    for span, s, m, a, b in spans:
        for q, who, x in seats:
            met = [motion[m, f][max(int((x - 140) / 40), 0) : min(int((x + 140) / 40) + 1, 20)] for f in range(a, b) if (m, f) in motion]
            if q == s and met:
                want[span, who] = (sum(map(sum, met)) / sum(map(len, met)), len(met))
    mo = spark.createDataFrame([(m, f, r) for (m, f), r in motion.items()], "media_id long, frame_no long, row array<bigint>")
    sp = spark.createDataFrame(spans, "span_id long, set_id int, media_id long, from_frame long, to_frame long")
    got = pictures.seat_energies(sp, mo, spark.createDataFrame(seats, "set_id int, speaker string, x int")).collect()
    assert {(r.span_id, r.speaker): (r.energy, r.frames) for r in got} == want

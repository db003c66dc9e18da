"""Files in and out, the feedback stream, voices, and rules proven by hand."""

import json

import pytest
from pyspark.sql import functions as F

from cutloom.operators import planning, sentences, speakers
from cutloom.sources import files
from cutloom.streaming import feedback


@pytest.fixture
def folder(tmp_path):
    doc = {
        "version": 2, "source": "C:\\Film\\A.mp4", "duration": 12.3456, "language": "cs", "createdAt": "2024-01-01",
        "segments": [{"id": 1, "start": 0.5, "end": 1.25, "text": "Ano tak.", "speaker": "S1", "words": [{"w": "Ano", "s": 0.5, "e": 0.75, "p": 0.9}, {"w": "tak.", "s": 0.8, "e": 1.2504, "p": 0.8, "spk": "S2"}]}],
    }
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text(json.dumps({"source": "C:/film/a.MP4", "method": "x", "turns": [{"start": 0.1, "end": 2, "speaker": "S1"}], "speakingTime": {"S1": 1.9}, "centroids": {"S1": [1.0, 0.0]}}))
    return tmp_path


def test_transcripts_and_turns(spark, folder):
    t = files.transcripts(spark, str(folder / "t"))
    assert t.first().duration_ms == 12346 and t.first().media_id == "c:/film/a.mp4"
    got = [(r.seg_id, r.pos, r.w, r.s_ms, r.e_ms, r.spk) for r in files.transcript_words(t).orderBy("pos").collect()]
    assert got == [(1, 0, "Ano", 500, 750, "S1"), (1, 1, "tak.", 800, 1250, "S2")]
    d = files.diarizations(spark, str(folder / "d"))
    assert [tuple(r) for r in files.diarization_turns(d).collect()] == [("c:/film/a.mp4", "S1", 100, 2000)]
    assert d.first().speaking_time == {"S1": 1.9}


def test_feedback_log_and_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("2024-01-01 10:05:00", "good", "a"), ("2024-01-01 10:20:00", "good", "a"), ("2024-01-01 11:05:00", "bad", "b")]
    df = spark.createDataFrame(rows, "time string, rating string, agent string").withColumn("time", F.to_timestamp("time"))
    files.append_feedback(df, path)
    files.append_feedback(df.limit(1), path)
    assert files.feedback(spark, path).count() == 4
    q = feedback.ratings(spark, path).writeStream.outputMode("complete").format("memory").queryName("ratings").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r.start), r.agent, r.rating, r.n) for r in spark.table("ratings").collect()}
    assert got == {("2024-01-01 10:00:00", "a", "good", 3), ("2024-01-01 11:00:00", "b", "bad", 1)}


def test_plan_texts(spark):
    t = spark.createDataFrame([(1, 'Plan:\n{"picks": [3, {"id": 5, "fromWord": 1, "toWord": 4}]} done'), (2, "no plan"), (3, '{"picks": []}'), (4, None)], "plan_id long, value string")
    assert [tuple(r) for r in files.plan_picks(t).orderBy("ord").collect()] == [(1, 0, 3, None, None), (1, 1, 5, 1, 4)]


def test_run_log(spark):
    v = ['{"type":"assistant","usage":{"input":5,"output":2}}', "{broken", '{"type":"tool"}', '{"type":"result","cost":0.25}']
    t = spark.createDataFrame([("r", x) for x in v], "run string, value string").coalesce(1)
    assert tuple(files.run_log(t).first()) == ("r", 1, 1, 5, 2, 0.25)


def test_written_texts_come_back(spark, tmp_path):
    t = spark.createDataFrame([(1, "a\nb"), (2, "c")], "seq_id long, value string")
    files.write_texts(t, str(tmp_path / "o"), "seq_id")
    assert sorted((r.seq_id, r.value) for r in spark.read.text(str(tmp_path / "o")).collect()) == [(1, "a"), (1, "b"), (2, "c")]


def test_weak_sentences(spark):
    rows = [
        (1, 1, 0, 900, "no jo ehm"), (1, 2, 1000, 3000, "Dnes chci mluvit o válce v Africe."), (1, 3, 3100, 5000, "Dnes chci mluvit o válce v Asii."),
        (1, 4, 5000, 6000, "A potom jsme"), (1, 5, 8000, 9000, "?!"), (1, 6, 9000, 9500, "Konec."),
    ]
    s = spark.createDataFrame(rows, "media_id long, seg_id long, start_ms long, end_ms long, text string")
    got = {r.seg_id: r.reasons for r in sentences.weak_sentences(s, ["ehm"], ["no", "jo"]).collect()}
    assert got == {1: "filler", 2: "repeated", 4: "unfinished", 5: "empty"}


def test_false_start(spark):
    t = spark.createDataFrame([(["bych...", "Bych", "chtěl", "říct"],), (["tak", "já…", "tak", "jdu"],), (["nic", "tu", "není"],), (["x..."],), ([],)], "words array<string>")
    assert [r[0] for r in t.select(sentences.false_start()).collect()] == [1, 2, 0, 0, 0]


def test_chapters_cover(spark):
    b = spark.createDataFrame([(1, 1, 20), (2, 1, 9)], "media_id long, first long, last long")
    c = spark.createDataFrame([(1, 8, 3), (1, 12, 15), (1, 14, 40)], "media_id long, c_from long, c_to long")
    got = sorted((r.media_id, r.c_from, r.c_to) for r in sentences.covering_chapters(c, b).collect())
    assert got == [(1, 1, 8), (1, 9, 15), (1, 16, 20), (2, 1, 9)]


def test_kept_words_only_count(spark):
    w = spark.createDataFrame([(1, 0, 100, "a"), (1, 40, 500, "b"), (1, 90, 200, "c"), (1, 160, 300, "d")], "media_id long, s_ms long, e_ms long, w string")
    assert sorted(r.w for r in sentences.without_overlaps(w).collect()) == ["a", "c", "d"]


def test_voice_library(spark):
    lib = spark.createDataFrame([("Eva", [1.0, 0.0], 1, ["x"]), ("Jan", [0.0, 1.0], 3, ["y"])], "name string, vec array<double>, n long, sources array<string>")
    new = spark.createDataFrame([("eva", [0.0, 1.0], "z"), ("Petr", [3.0, 4.0], "q")], "name string, vec array<double>, source string")
    got = {r.name: r for r in speakers.enrolled(lib, new).collect()}
    assert got["Eva"].n == 2 and got["Eva"].sources == ["x", "z"] and abs(got["Eva"].vec[0] - 0.5**0.5) < 1e-9
    assert got["Jan"].n == 3 and got["Jan"].vec == [0.0, 1.0] and got["Petr"].vec == [0.6, 0.8]
    assert {r.name for r in speakers.forgotten(lib, "EVA").collect()} == {"Jan"}


def test_clusters_find_speakers(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 200)
    vecs = np.eye(16)[truth] + rng.normal(size=(200, 16)) * 0.12
    rows = [(1, i, 1500, v.tolist()) for i, v in enumerate(vecs)]
    got = speakers.clustered(spark.createDataFrame(rows, "media_id long, chunk_no long, dur_ms long, vec array<double>")).orderBy("chunk_no").collect()
    assert len({(int(t), r.cluster) for t, r in zip(truth, got, strict=True)}) == 3


def test_voices_match_once(spark):
    c = spark.createDataFrame([(1, "S1", [1.0, 0.0]), (1, "S2", [0.9, 0.3])], "media_id long, speaker string, vec array<double>")
    lib = spark.createDataFrame([("Eva", [1.0, 0.05]), ("Jan", [0.0, 1.0])], "name string, vec array<double>")
    assert [(r.speaker, r.name) for r in speakers.matched_voices(c, lib).collect()] == [("S1", "Eva")]


def test_shots_take_turns(spark):
    s = spark.createDataFrame([(1, 1, 11000), (1, 2, 2000), (1, 3, 40000)], "job_id long, ord long, dur_ms long")
    c = spark.createDataFrame([(1, o, k, r) for o in (1, 2, 3) for r, k in enumerate((7, 8))], "job_id long, ord long, shot long, rank long")
    got = [r.shot for r in planning.assigned_shots(s, c).orderBy("ord", "place").collect()]
    assert got == [7, 8, 7, 8, 7, 8, 7]


def test_translations(spark):
    t = spark.createDataFrame([(1, "Ahoj světe", "Hello world"), (2, "Ahoj", "ahoj!"), (3, "No", "x" * 40), (4, "A", "B / C"), (5, "Ano ne", "yes / no")], "id long, src string, out string")
    assert [r.verdict for r in planning.translation_check(t).orderBy("id").collect()] == ["ok", "untranslated", "rejected", "ok", "rejected"]

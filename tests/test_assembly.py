"""Briefs, plans and teasers by hand."""

import json

import pytest
from pyspark.sql import functions as F

from cutloom.operators import assembly


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"a": [{"b": 1}, {"b": 2}, {"b"', {"a": [{"b": 1}, {"b": 2}]}),
        ('text {"a": "say \\"x} y\\" ]", "b": {"c": [1, 2]}, "d": "cut', {"a": 'say "x} y" ]', "b": {"c": [1, 2]}}),
        ('{"a": {"b": 1}, "c": {"d": 2, "e', {"a": {"b": 1}}),
        ("no json here", {}),
        ("", {}),
        (None, {}),
        ('{"a": 1', {}),
        ('{"a": [1]} and more', {"a": [1]}),
    ],
)
def test_repaired_json(raw, want):
    assert json.loads(assembly.repaired_json(raw)) == want


def test_target_lengths(spark):
    wanted = {
        "třicetisekundová upoutávka": 30, "půlminutový": 30, "3 minuty": 180, "2,5 min": 150, "90 sekund": 90, "do jedné minuty": 60, "minuta a půl": 90, "pět minut": 300,
        "dvě minuty a půl": 150, "minutový": 60, "nic": None, "5 minut": 300, "film 12 s": 12, "": None,
    }
    df = spark.createDataFrame([(t,) for t in wanted], "t string")
    assert {r.t: r.s for r in df.select("t", assembly.target_length(F.col("t")).alias("s")).collect()} == wanted


def test_flags(spark):
    df = spark.createDataFrame([("bez otázek moderátora",), ("upoutávka, drastická místa",), ("názor každého hosta",), (None,)], "t string")
    flags = assembly.brief_flags(F.col("t"), F.lit(50))
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in flags.items()]).collect()]
    assert got == [(True, False, True, False, False), (False, True, False, True, False), (False, False, True, False, True), (False, False, True, False, False)]


def test_completed_picks_stop_at_excluded_speakers(spark):
    s = spark.createDataFrame(
        [(1, 1, "a", False, False), (1, 2, "a", True, True), (1, 3, "a", True, True), (1, 4, "h", False, False), (1, 5, "a", True, True), (1, 6, "b", True, False)],
        "media_id long, seg_id long, speaker string, low boolean, goes_on boolean",
    )
    ex = spark.createDataFrame([(1, "h")], "media_id long, speaker string")
    picks = spark.createDataFrame([(9, 1, 3), (8, 1, 5), (7, 1, 1)], "plan_id long, media_id long, seg_id long")
    got = sorted((r.plan_id, r.seg_id) for r in assembly.completed(picks, s, ex).collect())
    assert got == [(7, 1), (7, 2), (7, 3), (9, 1), (9, 2), (9, 3)]


def test_picture_track_keeps_and_continues(spark):
    s = spark.createDataFrame([(1, 1, 500, 10000), (1, 2, 4250, 10000), (1, 3, 6250, 10000)], "track_id long, seg_id long, start_ms long, total_ms long")
    chosen = spark.createDataFrame([(1, 1, 0, 7), (1, 1, 1, 8)], "track_id long, seg_id long, k int, shot long")
    shots = spark.createDataFrame([(7, 0), (8, 1000)], "shot long, from_ms long")
    got = sorted((r.seg_id, r.k, r.shot, r.at_ms, r.dur_ms, r.in_ms) for r in assembly.picture_track(s, chosen, shots).collect())
    assert got == [(1, 0, 7, 0, 2000, 0), (1, 1, 8, 2000, 2000, 1000), (2, 0, 8, 4000, 2000, 3000), (3, 0, 8, 6000, 4000, 5000)]

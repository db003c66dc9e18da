"""Camera planning: the cases of the fixtures, in milliseconds."""

from __future__ import annotations

import random
import time

import pytest

from cutloom.operators.multicam import Camera, Planner, Rules, placed_clips

WIDE, A, B = Camera("wide", "wide"), Camera("a", "close", ("A",)), Camera("b", "close", ("B",))
DEFAULT = [WIDE, A, B]


def at(runs, t):
    return next(r[0] for r in runs if r[1] <= t < r[2])


def plan(turns, end, cameras=DEFAULT, gap=400, **rules):
    return Planner(cameras, Rules(**rules)).plan(turns, 0, end, gap)


def test_alternation():
    runs = plan([("A", 1000, 6000), ("B", 7000, 12000)], 13000)
    assert at(runs, 3000) == 1 and at(runs, 9000) == 2
    assert any(6500 <= r[1] <= 7000 for r in runs)


def test_coverage():
    runs = plan([("A", 0, 20000), ("B", 21000, 40000)], 45000)
    assert runs[0][1] == 0 and runs[-1][2] == 45000
    assert all(x[2] == y[1] for x, y in zip(runs, runs[1:], strict=False))


def test_minimum_shot():
    runs = plan([("AB"[i % 2], i * 1000, i * 1000 + 900) for i in range(30)], 30000, gap=50)
    assert all(r[2] - r[1] >= 1800 for r in runs[:-1])


def test_overlap_goes_wide():
    assert at(plan([("A", 0, 10000), ("B", 4000, 9000)], 10000), 7000) == 0


def test_cutaway():
    runs = plan([("A", 0, 40000)], 40000)
    assert any(r[3] for r in runs)
    assert all(r[2] - r[1] <= 16400 for r in runs if not r[3])


def test_no_wide_cuts_to_the_other_close():
    runs = plan([("A", 0, 40000)], 40000, cameras=[A, B])
    assert any(r[3] and r[0] == 1 for r in runs)


def test_late_camera():
    late = [WIDE, Camera("a", "close", ("A",), 10000), B]
    runs = plan([("A", 0, 20000)], 20000, cameras=late, max_shot=100_000)
    assert at(runs, 5000) == 0 and at(runs, 15000) == 1


def test_unmapped_speaker_stays_wide():
    assert {r[0] for r in plan([("X", 0, 10000)], 10000)} == {0}


def test_clip_maths(spark):
    spans = spark.createDataFrame([(1, 0, 10000, 20000), (1, 1, 50000, 55000)], "media_id long, range_no long, start_ms long, end_ms long")
    runs = spark.createDataFrame([(1, 0, 1, 0, 10000, 20000), (1, 1, 1, 0, 50000, 55000)], "media_id long, range_no long, run long, cam int, start_ms long, end_ms long")
    cams = spark.createDataFrame([(0, "wide", -2000)], "cam int, source string, offset_ms long")
    got = sorted((r.in_ms, r.at_ms, r.dur_ms) for r in placed_clips(runs, spans, cams).collect())
    assert got == [(12000, 0, 10000), (52000, 10000, 5000)]
    late = spark.createDataFrame([(0, "audio", 12000)], "cam int, source string, offset_ms long")
    got = sorted((r.in_ms, r.at_ms, r.dur_ms) for r in placed_clips(runs, spans, late).collect())
    assert got == [(0, 2000, 8000), (38000, 10000, 5000)]


def test_an_hour_is_quick():
    turns, t, k = [], 0, 0
    while t < 3_600_000:
        d = 2000 + (t // 1000 * 7) % 25 * 1000
        turns.append(("AB"[k % 2], t, t + d))
        t, k = t + d + 400, k + 1
    began = time.time()
    runs = plan(turns, 3_600_000)
    assert time.time() - began < 3 and runs[-1][2] == 3_600_000


@pytest.mark.parametrize("seed", range(5))
def test_runs_cover_random_ranges(seed):
    random.seed(seed)
    turns = sorted((random.choice("ABX"), s := random.randrange(60000), s + random.randrange(200, 9000)) for _ in range(25))
    runs = plan(turns, 60000)
    assert runs[0][1] == 0 and runs[-1][2] == 60000
    assert all(x[2] == y[1] for x, y in zip(runs, runs[1:], strict=False))


def test_a_short_first_run_goes_to_the_next():
    # a until 1100 is no shot; with it b, until 2500, is one
    runs = plan([("A", 0, 900), ("B", 1400, 2300), ("A", 2800, 9000)], 9000, gap=50, silence_to_wide=60_000)
    assert [(r[0], r[1]) for r in runs] == [(2, 0), (1, 2500)]


def test_name_tags(spark):
    from cutloom.operators.multicam import name_tags

    shots = spark.createDataFrame([(1, "a", 0, 1000), (1, "b", 1000, 9000), (1, "a", 20_000, 21_000), (1, "a", 21_050, 26_000)], "media_id long, person string, start_ms long, end_ms long")
    tags = spark.createDataFrame([(1, 1, "a", 5000), (1, 2, "b", 1500), (1, 3, "c", 700)], "media_id long, tag_no long, person string, t_ms long")
    got = {r.tag_no: (r.t_ms, r.dur_ms) for r in name_tags(tags, shots).collect()}
    assert got == {1: (20_120, 3800), 2: (1120, 3800), 3: (700, 2500)}

"""Picture rules of a studio edit: cut points between words, still pictures, head positions, who moves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutloom.operators import intervals

# Marks after a word at which a cut is welcome.
PAUSE_MARKS = r"[.?!,;:]$"


def word_gaps(words: DataFrame) -> DataFrame:
    """Gaps between neighbouring words (media_id, s_ms, e_ms, w): media_id, t2 (twice the middle), gap_ms, mark."""
    w = W.partitionBy("media_id").orderBy("s_ms", "e_ms")
    n = words.select("media_id", "e_ms", F.lead("s_ms").over(w).alias("_n"), F.col("w").rlike(PAUSE_MARKS).alias("mark")).filter("_n is not null")
    return n.select("media_id", (F.col("e_ms") + F.col("_n")).cast("bigint").alias("t2"), F.greatest(F.col("_n") - F.col("e_ms"), F.lit(0)).alias("gap_ms"), "mark")


def _cuts(a: int, b: int, limit: int, t2: np.ndarray, worth: np.ndarray, shortest: int, over: int, wide: int) -> list[int]:
    """From the last cut on the best gap within reach, until the rest is short; all in half milliseconds."""
    found, at = [], 2 * a
    while 2 * b - at > 2 * (limit + over):
        lo, hi = np.searchsorted(t2, [at + 2 * shortest, at + 2 * limit + 1])
        if lo >= hi:
            lo, hi = np.searchsorted(t2, [at + 2 * limit + 1, at + 2 * (limit + wide) + 1])
        if lo >= hi:
            break
        near = worth[lo:hi] - 15 * np.abs(10 * (t2[lo:hi] - at) - 16 * limit)
        at = int(t2[lo + near.argmax()])
        found.append(at)
    return found


def cut_points(items: DataFrame, words: DataFrame, *, shortest_ms: int = 1300, tail_ms: int = 900, over_ms: int = 800, wide_ms: int = 2000) -> DataFrame:
    """(item_id, k, t2): where items (item_id, media_id, a_ms, b_ms, limit_ms) are cut between words; ``t2`` is twice the time in ms.

    Gaps from ``shortest_ms`` after an item's start to ``tail_ms`` before its end
    count.  While more than limit and ``over_ms`` are left, the next cut is the
    best gap within the limit after the last one, else within ``wide_ms`` beyond
    it: 1.5 for a second of gap (0.6 at most), 0.5 for a mark, less 0.15 for a
    second's distance from 0.8 limits; ties go to the earlier one.  Where there
    is none, cutting ends.  The window begins at the last cut, so an item is a
    fold over its gaps; gaps meet items in time buckets.
    """
    g = word_gaps(words).withColumn("_t", F.floor(F.col("t2") / 2))
    i = items.withColumns({"_lo": F.col("a_ms") + shortest_ms - 1, "_hi": F.col("b_ms") - tail_ms}).filter("_hi >= _lo")
    met = intervals.overlap_join(i, g, ["media_id"], "_lo", "_hi", "_t", "_t")
    met = met.filter((F.col("t2") >= 2 * (F.col("a_ms") + shortest_ms)) & (F.col("t2") <= 2 * (F.col("b_ms") - tail_ms)))
    worth = 3000 * F.least("gap_ms", F.lit(600)) + F.when(F.col("mark"), 1_000_000).otherwise(0)
    met = met.groupBy("item_id", "a_ms", "b_ms", "limit_ms").agg(F.array_sort(F.collect_list(F.struct("t2", worth.cast("bigint").alias("worth")))).alias("g"))
    met = met.select("item_id", "a_ms", "b_ms", "limit_ms", F.transform("g", lambda x: x["t2"]).alias("t2"), F.transform("g", lambda x: x["worth"]).alias("worth"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                found = _cuts(r.a_ms, r.b_ms, r.limit_ms, np.asarray(r.t2, "i8"), np.asarray(r.worth, "i8"), shortest_ms, over_ms, wide_ms)
                out += [(r.item_id, k, t) for k, t in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["item_id", "k", "t2"])

    return met.mapInPandas(run, "item_id bigint, k int, t2 bigint")


def sample_step(duration_ms: Column) -> Column:
    """About 90 samples a recording, 6 to 20 seconds apart."""
    return F.least(F.lit(20_000), F.greatest(F.lit(6000), F.floor(duration_ms / 90))).cast("bigint")


def sampled(key_frames: DataFrame, steps: DataFrame) -> DataFrame:
    """(media_id, t_ms, step_ms): the first key frame (media_id, t_ms), and each first one at least a step (media_id, step_ms), but for a millisecond, after the last.

    Which frame is next depends on the one taken before: one running value over a recording's times; the pictures aren't read.
    """
    times = key_frames.groupBy("media_id").agg(F.array_sort(F.collect_set("t_ms")).alias("t")).join(steps, "media_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                t, i = np.asarray(r.t, "i8"), 0
                while i < t.size:
                    out.append((r.media_id, int(t[i]), r.step_ms))
                    i = int(np.searchsorted(t, t[i] + max(1, r.step_ms - 1)))
            yield pd.DataFrame(out, columns=["media_id", "t_ms", "step_ms"])

    return times.mapInPandas(run, "media_id bigint, t_ms bigint, step_ms bigint")


def still_shots(samples: DataFrame, durations: DataFrame, *, change10: int = 25) -> DataFrame:
    """(media_id, shot, from_ms, to_ms, n): samples (media_id, t_ms, step_ms, pixels as whole numbers) whose picture hardly changes, as one shot.

    A sample extends the shot while its mean difference from the shot's first
    sample, the last that was kept, is under ``change10`` tenths; slow changes
    add up.  A shot ends a step after its last sample, the last one at the
    duration (media_id, duration_ms) at most.  One fold per recording over its
    samples, about 90 in number.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_ms", ignore_index=True)
        pixels = np.stack(pdf.pixels.to_numpy()).astype("i8")
        first, starts = pixels[0], [0]
        for i, p in enumerate(pixels[1:], 1):
            if 10 * int(np.abs(p - first).sum()) >= change10 * p.size:
                first = p
                starts.append(i)
        last = np.array([*starts[1:], len(pdf)]) - 1
        to = pdf.t_ms.to_numpy()[last] + pdf.step_ms.to_numpy()[last]
        if not pd.isna(pdf.duration_ms[0]):
            to[-1] = min(to[-1], pdf.duration_ms[0])
        shots = range(1, len(starts) + 1)
        return pd.DataFrame({"media_id": pdf.media_id[0], "shot": shots, "from_ms": pdf.t_ms.to_numpy()[starts], "to_ms": to, "n": last - np.array(starts) + 1})

    x = samples.join(durations, "media_id", "left").select("media_id", "t_ms", "step_ms", "pixels", "duration_ms")
    return x.groupBy("media_id").applyInPandas(fold, "media_id bigint, shot int, from_ms bigint, to_ms bigint, n int")


def head_positions(items: DataFrame, detections: DataFrame, *, tolerance: int = 230, long_ms: int = 1600, grid_ms: int = 1) -> DataFrame:
    """(item_id, x, y, n): where to look in items (item_id, media_id, a_ms, b_ms, seat_x, y0, y1), the middle over several pictures.

    Three pictures of an item, four of one longer than ``long_ms``, lie evenly in
    it.  In each the heads found (detections: media_id, t_ms on the grid of
    ``grid_ms``, x, y, width) near the seat and within its heights count, but
    those narrower than 0.6 of the widest; the one nearest to the seat is taken,
    or without a seat the widest.  Ties go to the one further left, then above.
    Medians of the two coordinates are cut to whole numbers; items without any
    head give no row.
    """
    n = F.when(F.col("b_ms") - F.col("a_ms") > long_ms, 4).otherwise(3)
    at = F.col("a_ms") + F.floor((F.col("b_ms") - F.col("a_ms")) * (2 * F.col("k") + 1) / (2 * n))
    grid = items.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("t_ms", (F.floor(at / grid_ms) * grid_ms).cast("bigint"))
    met = grid.join(detections, ["media_id", "t_ms"])
    seat = F.col("seat_x").isNotNull()
    near = ~seat | ((F.abs(F.col("x") - F.col("seat_x")) <= tolerance) & F.col("y").between(F.col("y0"), F.col("y1")))
    picture = W.partitionBy("item_id", "k")
    met = met.filter(near).withColumn("_w", F.max("width").over(picture)).filter(~seat | (10 * F.col("width") >= 6 * F.col("_w")))
    best = met.withColumn("_far", F.when(seat, F.abs(F.col("x") - F.col("seat_x"))).otherwise(-F.col("width")))
    taken = best.groupBy("item_id", "k").agg(F.min(F.struct("_far", "x", "y")).alias("h"))
    # Towards zero, as whole numbers are cut.
    middle = lambda c: F.percentile(c, 0.5).cast("int")
    return taken.groupBy("item_id").agg(middle("h.x").alias("x"), middle("h.y").alias("y"), F.count("*").cast("int").alias("n"))


#: So many frames have one list of the spans they may be in.
FRAMES = 256


def _band(motion: Column, x: Column, half: int, cell: int) -> Column:
    """The cells of a motion row around a seat."""
    lo = F.greatest(((x - half) / cell).cast("int"), F.lit(0))
    hi = F.least(((x + half) / cell).cast("int") + 1, F.size(motion))
    return F.slice(motion, lo + 1, F.greatest(hi - lo, F.lit(0)))


def seat_energies(spans: DataFrame, motion: DataFrame, seats: DataFrame, *, half: int = 140, cell: int = 40) -> DataFrame:
    """(span_id, speaker, energy, frames): mean motion around every seat (set_id, speaker, x) in spans (span_id, set_id, media_id, from_frame, to_frame).

    ``motion`` is (media_id, frame_no, row: an array over the picture's width in
    cells of ``cell``), one row per frame.  Rows are wide, so they stay in the
    partition of their recording: each looks its spans up in one array of the
    recording's, a list for every :data:`FRAMES` frames, and only sums by span
    are shuffled.
    """
    last = spans.withColumn("_last", F.col("to_frame") - 1).filter("_last >= from_frame and span_id is not null")
    s = F.struct("from_frame", "_last", "span_id", "set_id")
    first, until = F.floor(F.col("from_frame") / FRAMES), F.floor(F.col("_last") / FRAMES)
    lists = last.select("media_id", F.explode(F.sequence(first, until)).alias("_b"), s.alias("_s"))
    ends = last.groupBy("media_id").agg(F.min(first).alias("_lo"), F.max(until).alias("_hi"))
    empty = ends.select("media_id", F.explode(F.sequence("_lo", "_hi")).alias("_b"), F.lit(None).cast(lists.schema["_s"].dataType).alias("_s"))
    per = lists.unionByName(empty).groupBy("media_id", "_b").agg(F.collect_list("_s").alias("_l"))
    per = per.groupBy("media_id").agg(F.min("_b").alias("_lo"), F.array_sort(F.collect_list(F.struct("_b", "_l"))).alias("_by"))
    f = F.col("frame_no")
    own = F.get("_by", (F.floor(f / FRAMES) - F.col("_lo")).cast("int"))["_l"]
    # The list is taken where the join finds it, so that no frame carries all of a recording's.
    met = motion.join(per.hint("shuffle_hash"), "media_id").select("row", "frame_no", own.alias("_l"))
    met = met.select("row", F.explode(F.filter("_l", lambda x: (x["from_frame"] <= f) & (f <= x["_last"]))).alias("_s")).select("row", "_s.span_id", "_s.set_id")
    # One row per seat; a frame counts once, whatever places a speaker has.
    places = seats.filter("speaker is not null").groupBy("set_id", "speaker").agg(F.collect_list("x").alias("_x")).select("set_id", "speaker", F.posexplode("_x").alias("_k", "x"))
    band = _band(F.col("row"), F.col("x"), half, cell)
    met = met.join(F.broadcast(places), "set_id").select("span_id", "speaker", "_k", F.aggregate(band, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("_s"), F.size(band).alias("_n"))
    return met.groupBy("span_id", "speaker").agg((F.sum("_s") / F.sum("_n")).alias("energy"), F.count_if(F.col("_k") == 0).alias("frames"))


def baselines(energies: DataFrame, wide: DataFrame) -> DataFrame:
    """(set_id, speaker, base): a seat's usual motion, its mean energy over wide spans (span_id, set_id)."""
    # All energies have frames: asked for here, too, the sums by span are the same as in moving_speakers and made once.
    return energies.filter("frames > 0").join(wide, "span_id").groupBy("set_id", "speaker").agg((F.avg("energy") + 1e-3).alias("base"))


def moving_speakers(
    spans: DataFrame, energies: DataFrame, seats: DataFrame, base: DataFrame, *, weight: float = 2.5, clear: float = 1.25, fewest: int = 3
) -> DataFrame:
    """(span_id, speaker): who speaks in each span, by voice where that is known, else by motion.

    ``spans`` are in the order ``ord`` of their sequence (seq_id) and have
    set_id, ``spoken`` (who the transcript says, or null) and ``presenter``.  A
    speaker with a seat is taken at once.  Else each seat's energy counts
    relative to its baseline, the presenter's ``weight`` times; under ``fewest``
    frames it is the presenter.  If the best isn't ``clear`` times the second,
    the speaker of the span before stays, where they have a seat here.  What
    stays is what was decided before, so the last clear decision is carried
    forward; a seat that is missing in between ends it.
    """
    seated = F.broadcast(seats.select("set_id", F.col("speaker").alias("_who")))  # one row per seat
    s = spans.join(F.broadcast(seats.groupBy("set_id").agg(F.sort_array(F.collect_set("speaker")).alias("_seats"))), "set_id")
    presenter = F.when(F.array_contains("_seats", F.col("presenter")), F.col("presenter")).otherwise(F.col("_seats")[0])
    s = s.withColumn("_pr", presenter)
    e = s.join(seated, "set_id").join(energies.withColumnRenamed("speaker", "_who"), ["span_id", "_who"], "left").join(base.withColumnRenamed("speaker", "_who"), ["set_id", "_who"], "left")
    score = F.coalesce(F.col("energy"), F.lit(0.0)) / F.coalesce(F.col("base"), F.lit(1.0 + 1e-3)) * F.when(F.col("_who") == F.col("_pr"), weight).otherwise(1.0)
    by = F.array_sort(F.collect_list(F.struct((-score).alias("m"), F.col("_who").alias("who"))))
    top = e.groupBy("span_id").agg(by.alias("_by"), F.max("frames").alias("_frames"))
    s = s.join(top, "span_id", "left")
    few = F.coalesce(F.col("_frames"), F.lit(0)) < fewest
    unclear = (F.size("_by") > 1) & (-F.col("_by")[0]["m"] < clear * -F.col("_by")[1]["m"])
    fixed = F.when(F.array_contains("_seats", F.col("spoken")), F.col("spoken")).when(few, F.col("_pr")).when(~unclear, F.col("_by")[0]["who"])
    s = s.withColumn("_fixed", fixed).withColumn("_else", F.col("_by")[0]["who"])
    return _held(s)


def _held(s: DataFrame) -> DataFrame:
    """Spans with a decision, or None where the one before stays if it is seated, else ``_else``."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", ignore_index=True)
        out, before = [], None
        for r in pdf.itertuples():
            fixed = getattr(r, "fixed")
            before = fixed if isinstance(fixed, str) else before if before in set(r.seats) else r.other
            out.append(before)
        return pdf[["span_id"]].assign(speaker=out)

    x = s.select("seq_id", "ord", "span_id", F.col("_fixed").alias("fixed"), F.col("_else").alias("other"), F.col("_seats").alias("seats"))
    return x.groupBy("seq_id").applyInPandas(fold, "span_id bigint, speaker string")

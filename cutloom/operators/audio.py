"""Audio energy as a time series: silence, levels, offsets between recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutloom.operators import intervals


def envelope(samples: DataFrame, hop: int = 80) -> DataFrame:
    """RMS of every full hop of samples (media_id, i, x): media_id, frame_no, rms; the partial tail is dropped."""
    g = samples.groupBy("media_id", F.floor(F.col("i") / hop).alias("frame_no"))
    return g.agg(F.count("*").alias("_n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")).filter(F.col("_n") == hop).drop("_n")


def onsets(frames: DataFrame) -> DataFrame:
    """Standardised rises of log energy (media_id, frame_no, rms): media_id, frame_no, onset."""
    w = W.partitionBy("media_id").orderBy("frame_no")
    e = F.log1p(F.col("rms") * 100)
    d = frames.withColumn("_e", e).withColumn("_d", F.greatest(F.lit(0.0), F.coalesce(F.col("_e") - F.lag("_e").over(w), F.lit(0.0))))
    m = W.partitionBy("media_id")
    return d.select("media_id", "frame_no", ((F.col("_d") - F.avg("_d").over(m)) / (F.stddev_pop("_d").over(m) + 1e-9)).alias("onset"))


def pauses(pairs: DataFrame, frames: DataFrame, hop_ms: int, *, before_ms: int = 150, after_ms: int = 300, around_ms: int = 1500, least_ms: int = 90) -> DataFrame:
    """``pairs`` (media_id, pair_no, a_ms, b_ms) with silence_ms and silent.

    The longest run of frames (media_id, frame_no, rms) near the pair below a
    threshold a quarter of the way from the local floor to the local peak level
    (10th and 95th percentile).  Only frames around pairs are ever looked at.
    """
    f = frames.select("media_id", "frame_no", (F.col("frame_no") * hop_ms).alias("_ft"), (20 * F.log10(F.greatest(F.col("rms"), F.lit(1e-7)))).alias("db"))
    p = pairs.withColumns({"_lo": F.least("a_ms", "b_ms") - around_ms, "_hi": F.greatest("a_ms", "b_ms") + around_ms - hop_ms})
    met = intervals.overlap_join(p, f, ["media_id"], "_lo", "_hi", "_ft", "_ft")
    key = ["media_id", "pair_no"]
    level = met.groupBy(*key).agg(F.percentile("db", F.array(F.lit(0.1), F.lit(0.95))).alias("_p"))
    near = met.filter((F.col("_ft") >= F.least("a_ms", "b_ms") - before_ms) & (F.col("_ft") <= F.greatest("a_ms", "b_ms") + after_ms)).join(level, key)
    quiet = near.filter(F.col("db") < F.col("_p")[0] + 0.25 * F.greatest(F.lit(0.0), F.col("_p")[1] - F.col("_p")[0]))
    run = F.col("frame_no") - F.row_number().over(W.partitionBy(*key).orderBy("frame_no"))
    runs = quiet.withColumn("_r", run).groupBy(*key, "_r").agg(F.count("*").alias("_n")).groupBy(*key).agg((F.max("_n") * hop_ms).alias("silence_ms"))
    out = pairs.join(runs, key, "left").withColumn("silence_ms", F.coalesce("silence_ms", F.lit(0)))
    return out.withColumn("silent", F.col("silence_ms") >= least_ms)


def offsets(pairs: DataFrame, frames: DataFrame, *, max_lag: int, guard: int) -> DataFrame:
    """``pairs`` (ref_id, other_id) with lag (in frames) and confidence, by cross-correlation of onsets.

    One pair is one group: two series and their FFT.  Frames: media_id, frame_no, onset.
    """
    import numpy as np

    f = frames.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "onset"))), lambda x: x["onset"]).alias("env"))
    a = f.select(F.col("media_id").alias("ref_id"), F.col("env").alias("a"))
    b = f.select(F.col("media_id").alias("other_id"), F.col("env").alias("b"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x, y = np.array(r.a, "f4"), np.array(r.b, "f4")
                size = 1 << (x.size + y.size - 1).bit_length()
                corr = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
                lag = (np.arange(size) + size // 2) % size - size // 2
                allowed = np.where(np.abs(lag) <= max_lag, corr, -np.inf)
                k = int(np.argmax(allowed))
                away = np.minimum((np.arange(size) - k) % size, (k - np.arange(size)) % size)
                second = float(np.max(np.where(away > guard, allowed, -np.inf)))
                out.append((r.ref_id, r.other_id, int(lag[k]), float(allowed[k] / second) if second > 0 else float("inf")))
            yield pd.DataFrame(out, columns=["ref_id", "other_id", "lag", "confidence"])

    joined = pairs.join(a.hint("merge"), "ref_id").join(b.hint("merge"), "other_id").select("ref_id", "other_id", "a", "b")
    return joined.mapInPandas(run, "ref_id bigint, other_id bigint, lag bigint, confidence double")


def resampled(keys: DataFrame, step_ms: int = 250) -> DataFrame:
    """Key-frame paths (path_id, t_ms, v) by linear interpolation on a grid from the first key to the last: path_id, t_ms, v."""
    w = W.partitionBy("path_id").orderBy("t_ms")
    k = keys.select("path_id", F.col("t_ms").alias("_a"), F.col("v").alias("_va"), F.lead("t_ms").over(w).alias("_b"), F.lead("v").over(w).alias("_vb"), F.min("t_ms").over(W.partitionBy("path_id")).alias("_s"))
    first = F.ceil((F.col("_a") - F.col("_s")) / step_ms)
    last = F.ceil((F.coalesce("_b", F.col("_a") + 1) - F.col("_s")) / step_ms) - 1
    g = k.filter(last >= first).withColumn("_k", F.explode(F.sequence(first, last))).withColumn("t_ms", F.col("_s") + F.col("_k") * step_ms)
    part = (F.col("t_ms") - F.col("_a")) / (F.col("_b") - F.col("_a"))
    grid = g.select("path_id", "t_ms", (F.col("_va") + F.coalesce((F.col("_vb") - F.col("_va")) * part, F.lit(0.0))).alias("v"))
    end = k.filter(F.col("_b").isNull() & ((F.col("_a") - F.col("_s")) % step_ms != 0)).select("path_id", F.col("_a").alias("t_ms"), F.col("_va").alias("v"))
    return grid.unionByName(end)


def refined_edges(points: DataFrame, frames: DataFrame, hop_ms: int, *, around_ms: int = 1500, least: int = 3, room_ms: int = 30) -> DataFrame:
    """``points`` (media_id, point_no, at_ms, at_end, extend_ms, fallback_ms) with time_ms and clean.

    An edge moves outward, to later times where ``at_end``, to the first
    ``least`` quiet frames within ``extend_ms`` and keeps ``room_ms`` of them;
    if there are none, to the quietest frame within ``fallback_ms``.  It never
    moves inward.  Quiet is the lowest quarter between the levels (10th and 95th
    percentile) around the edge; without frames an edge stays.
    """
    key = ["media_id", "point_no"]
    f = frames.select("media_id", "frame_no", "rms", (F.col("frame_no") * hop_ms).alias("_ft"), (20 * F.log10(F.greatest(F.col("rms"), F.lit(1e-7)))).alias("_db"))
    wide = F.col("extend_ms") + around_ms
    met = intervals.overlap_join(points.withColumns({"_lo": F.col("at_ms") - wide, "_hi": F.col("at_ms") + wide - hop_ms}), f, ["media_id"], "_lo", "_hi", "_ft", "_ft")
    level = met.groupBy(*key).agg(F.percentile("_db", F.array(F.lit(0.1), F.lit(0.95))).alias("_p"))
    away = F.when(F.col("at_end"), 1).otherwise(-1) * (F.col("frame_no") - F.floor(F.col("at_ms") / hop_ms + 0.5))
    near = met.withColumn("_k", away).filter((F.col("_k") >= 0) & (F.col("_k") <= F.round(F.col("extend_ms") / hop_ms))).join(level, key)
    low = F.col("_db") < F.col("_p")[0] + 0.25 * F.greatest(F.lit(0.0), F.col("_p")[1] - F.col("_p")[0])
    near = near.withColumn("_run", F.sum(low.cast("int")).over(W.partitionBy(*key).orderBy("_k").rangeBetween(0, least - 1)))
    found = near.groupBy(*key).agg(
        F.min(F.when(F.col("_run") == least, F.struct("_k", "_ft"))).alias("_q"),
        F.min(F.when(F.col("_k") <= F.round(F.least("extend_ms", "fallback_ms") / hop_ms), F.struct("rms", "_k", "_ft"))).alias("_l"),
    )
    out = F.when(F.col("at_end"), 1).otherwise(-1)
    to = F.coalesce(F.col("_q._ft") + out * room_ms, F.col("_l._ft") + F.when(F.col("at_end"), hop_ms).otherwise(0), F.col("at_ms"))
    by = F.least(F.greatest(out * (to - F.col("at_ms")), F.lit(0)), F.col("extend_ms"))
    return points.join(found, key, "left").select(*points.columns, (F.col("at_ms") + out * by).cast("bigint").alias("time_ms"), F.col("_q").isNotNull().alias("clean"))


def audible_edges(
    edges: DataFrame, words: DataFrame, frames: DataFrame, hop_ms: int, *, outside_ms: int, loud_db: float = -12.0, cut_db: float = -20.0
) -> DataFrame:
    """Edges (seq_id, clip_ix, media_id, edge, t_ms) as they sound: seq_id, clip_ix, edge, t_ms, w, level_db, cuts, loud, bad.

    ``level_db`` is the loudest frame just outside, relative to the speech
    around; ``loud`` is more than ``loud_db``.  A word that an edge crosses
    (``w``) is cut where more than ``cut_db`` is heard: times of words are often
    a little late, so a silent edge within a word is fine.  Without sound
    a crossed word counts as cut.  A level is measured once per place, however
    many clips are cut there.
    """
    from cutloom.operators import assembly, timeline

    place = F.struct("edge", "t_ms")
    spots = edges.select("media_id", "edge", "t_ms").distinct().select("media_id", place.alias("edge_no"), "t_ms", F.when(F.col("edge") == "in", -1).otherwise(1).alias("side"))
    levels = assembly.edge_levels(spots, frames, hop_ms, outside_ms).select("media_id", "edge_no.edge", "edge_no.t_ms", "level_db")
    crossed = timeline.edges_in_words(edges, words)
    x = edges.join(crossed, ["seq_id", "clip_ix", "edge", "t_ms"]).join(levels, ["media_id", "edge", "t_ms"], "left")
    loud = F.coalesce(F.col("level_db") > loud_db, F.lit(False))
    cuts = F.col("w").isNotNull() & F.coalesce(F.col("level_db") > cut_db, F.lit(True))
    return x.select("seq_id", "clip_ix", "edge", "t_ms", "w", "level_db", cuts.alias("cuts"), loud.alias("loud"), (cuts | loud).alias("bad"))

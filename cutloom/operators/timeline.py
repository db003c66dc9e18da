"""Timelines: clips, words on them, edits with ripple."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutloom.operators import intervals


def speech_clips(clips: DataFrame) -> DataFrame:
    """The clips that carry speech: enabled audio clips; where a sequence has none, its enabled video clips.  Repeated placements once."""
    on = clips.filter(~F.col("disabled") & F.col("media_id").isNotNull())
    audio = F.max((F.col("kind") == "audio").cast("int")).over(W.partitionBy("seq_id"))
    chosen = on.withColumn("_a", audio).filter((F.col("kind") == "audio") | (F.col("_a") == 0)).drop("_a")
    first = F.row_number().over(W.partitionBy("seq_id", "media_id", "start_ms", "in_ms").orderBy("clip_ix"))
    return chosen.withColumn("_r", first).filter("_r = 1").drop("_r")


def narration(clips: DataFrame) -> DataFrame:
    """The longest audio clip of each sequence whose media is no video clip's there."""
    video = clips.filter("kind = 'video'").select("seq_id", "media_id").distinct()
    own = clips.filter("kind = 'audio'").join(video, ["seq_id", "media_id"], "left_anti")
    rank = F.row_number().over(W.partitionBy("seq_id").orderBy(F.desc(F.col("end_ms") - F.col("start_ms")), "clip_ix"))
    return own.withColumn("_r", rank).filter("_r = 1").select("seq_id", "clip_ix", "media_id", "start_ms", "end_ms")


def words_on_timeline(clips: DataFrame, words: DataFrame, slack_ms: int = 10) -> DataFrame:
    """Words inside a clip's source range, in timeline time: seq_id, clip_ix, t0_ms, t1_ms, w, spk.

    A clip with another speed than 100 (``speed_pct``, null is 100) holds its
    source that much faster; times are whole milliseconds, halves up.
    """
    speed = F.coalesce("speed_pct", F.lit(100)) if "speed_pct" in clips.columns else F.lit(100)
    c = clips.select("seq_id", "clip_ix", "media_id", "start_ms", "in_ms", "out_ms", speed.alias("_speed"))
    met = intervals.overlap_join(words.select("media_id", "seg_id", "pos", "w", "s_ms", "e_ms", "spk"), c, ["media_id"], "s_ms", "e_ms", "in_ms", "out_ms")
    inside = met.filter((F.col("s_ms") >= F.col("in_ms") - slack_ms) & (F.col("e_ms") <= F.col("out_ms") + slack_ms))
    placed = lambda t: F.col("start_ms") + F.floor((2 * 100 * (F.col(t) - F.col("in_ms")) + F.col("_speed")) / (2 * F.col("_speed")))
    return inside.select("seq_id", "clip_ix", "seg_id", "pos", placed("s_ms").alias("t0_ms"), placed("e_ms").alias("t1_ms"), "w", "spk")


def used_sentences(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """Sentences of which a timeline uses enough: overlap over 0.35 of the shorter of sentence and clip."""
    c = clips.select("seq_id", "media_id", "in_ms", "out_ms")
    met = intervals.overlap_join(segments.select("media_id", "seg_id", "start_ms", "end_ms"), c, ["media_id"], "start_ms", "end_ms", "in_ms", "out_ms")
    overlap = F.least("end_ms", "out_ms") - F.greatest("start_ms", "in_ms")
    least = F.least(F.col("end_ms") - F.col("start_ms"), F.col("out_ms") - F.col("in_ms"))
    return met.filter(overlap * 100 > least * 35).select("seq_id", "media_id", "seg_id").distinct()


def clip_words(clips: DataFrame, words: DataFrame) -> DataFrame:
    """Text and first id of the words that lie in a clip by more than half: seq_id, clip_ix, text, n."""
    c = clips.select("seq_id", "clip_ix", "media_id", "in_ms", "out_ms")
    met = intervals.overlap_join(words.select("media_id", "w", "s_ms", "e_ms"), c, ["media_id"], "s_ms", "e_ms", "in_ms", "out_ms")
    overlap = F.least("e_ms", "out_ms") - F.greatest("s_ms", "in_ms")
    mine = met.filter(overlap * 2 > F.col("e_ms") - F.col("s_ms"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_ms", "e_ms", "w"))), lambda x: x["w"]), " ")
    return mine.groupBy("seq_id", "clip_ix").agg(text.alias("text"), F.count("*").alias("n"))


def edges(clips: DataFrame) -> DataFrame:
    """Every clip's in and out edge in source time: seq_id, clip_ix, media_id, edge, t_ms."""
    both = F.array(F.struct(F.lit("in").alias("edge"), F.col("in_ms").alias("t_ms")), F.struct(F.lit("out").alias("edge"), F.col("out_ms").alias("t_ms")))
    return clips.select("seq_id", "clip_ix", "media_id", F.explode(both).alias("x")).select("seq_id", "clip_ix", "media_id", "x.edge", "x.t_ms")


def edges_in_words(edges: DataFrame, words: DataFrame, eps_ms: int = 10) -> DataFrame:
    """Edges with whether they cross a word: seq_id, clip_ix, edge, t_ms, w (null if clean)."""
    met = intervals.overlap_join(edges, words.select("media_id", "w", "s_ms", "e_ms"), ["media_id"], "t_ms", "t_ms", "s_ms", "e_ms")
    hit = met.filter((F.col("s_ms") < F.col("t_ms") - eps_ms) & (F.col("e_ms") > F.col("t_ms") + eps_ms))
    first = hit.groupBy("seq_id", "clip_ix", "edge", "t_ms").agg(F.min_by("w", F.struct("s_ms", "e_ms", "w")).alias("w"))
    return edges.select("seq_id", "clip_ix", "edge", "t_ms").join(first, ["seq_id", "clip_ix", "edge", "t_ms"], "left")


def snap_to_cuts(ranges: DataFrame, cuts: DataFrame, words: DataFrame, near_ms: int = 40, far_ms: int = 1500) -> DataFrame:
    """Ranges (plan_id, ord, media_id, in_ms, out_ms) moved to a picture cut where no speech lies between.

    The first cut in (in + near, in + far] and the last in [out - far, out - near)
    count: new_in_ms, new_out_ms, and warn_in / warn_out where speech forbids the move.
    """
    c = cuts.select("media_id", F.col("t_ms").alias("_t"))
    r = ranges.select("plan_id", "ord", "media_id", "in_ms", "out_ms")
    a = intervals.overlap_join(r.withColumns({"_a": F.col("in_ms") + near_ms + 1, "_b": F.col("in_ms") + far_ms}), c, ["media_id"], "_a", "_b", "_t", "_t")
    b = intervals.overlap_join(r.withColumns({"_a": F.col("out_ms") - far_ms, "_b": F.col("out_ms") - near_ms - 1}), c, ["media_id"], "_a", "_b", "_t", "_t")
    first = a.groupBy("plan_id", "ord").agg(F.min("_t").alias("cut_in"))
    last = b.groupBy("plan_id", "ord").agg(F.max("_t").alias("cut_out"))
    cand = r.join(first, ["plan_id", "ord"], "left").join(last, ["plan_id", "ord"], "left")
    w = words.select("media_id", F.col("s_ms").alias("_ws"), F.col("e_ms").alias("_we"))

    def spoken(lo: str, hi: str, name: str) -> DataFrame:
        met = intervals.overlap_join(cand.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull()), w, ["media_id"], lo, hi, "_ws", "_we")
        return met.filter((F.col("_ws") < F.col(hi)) & (F.col("_we") > F.col(lo))).select("plan_id", "ord", F.lit(True).alias(name)).distinct()

    out = cand.join(spoken("in_ms", "cut_in", "_si"), ["plan_id", "ord"], "left").join(spoken("cut_out", "out_ms", "_so"), ["plan_id", "ord"], "left")
    warn_in, warn_out = F.coalesce("_si", F.lit(False)), F.coalesce("_so", F.lit(False))
    return out.select(
        "plan_id", "ord",
        F.when(warn_in, F.col("in_ms")).otherwise(F.coalesce("cut_in", "in_ms")).alias("new_in_ms"),
        F.when(warn_out, F.col("out_ms")).otherwise(F.coalesce("cut_out", "out_ms")).alias("new_out_ms"),
        warn_in.alias("warn_in"), warn_out.alias("warn_out"),
    )


def razor(clips: DataFrame, at: DataFrame) -> DataFrame:
    """Clips split at cut times of their sequence (seq_id, t_ms): seq_id, clip_ix, part, start_ms, end_ms, in_ms, out_ms."""
    met = intervals.overlap_join(clips, at.select("seq_id", "t_ms"), ["seq_id"], "start_ms", "end_ms", "t_ms", "t_ms")
    inner = met.filter((F.col("t_ms") > F.col("start_ms")) & (F.col("t_ms") < F.col("end_ms"))).groupBy("seq_id", "clip_ix").agg(F.collect_set("t_ms").alias("_t"))
    c = clips.join(inner, ["seq_id", "clip_ix"], "left").withColumn("_t", F.coalesce("_t", F.array().cast("array<bigint>")))
    bounds = F.sort_array(F.array_distinct(F.concat(F.array("start_ms", "end_ms"), F.col("_t"))))
    parts = c.withColumn("_b", bounds).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_b") - 1)))
    s, e = F.element_at("_b", F.col("_i")), F.element_at("_b", F.col("_i") + 1)
    return parts.select(
        "seq_id", "clip_ix", F.col("_i").cast("bigint").alias("part"), s.alias("start_ms"), e.alias("end_ms"),
        (F.col("in_ms") + s - F.col("start_ms")).alias("in_ms"), (F.col("in_ms") + e - F.col("start_ms")).alias("out_ms"),
    )


def remove_ranges(clips: DataFrame, holes: DataFrame, ripple: bool = True) -> DataFrame:
    """Clips without time ranges of their sequence (seq_id, h_start, h_end; united first), later ones moved up if ``ripple``."""
    united = intervals.merged(holes.select("seq_id", "h_start", "h_end"), ["seq_id"], "h_start", "h_end", 0)
    keep = clips.select("seq_id", "clip_ix", "start_ms", "end_ms", "in_ms")
    parts = intervals.subtract(keep, united, ["seq_id"], "start_ms", "end_ms", "h_start", "h_end")
    moved = intervals.removed_before(parts, united, ["seq_id"], "part_start", "h_start", "h_end") if ripple else parts.withColumn("removed_ms", F.lit(0).cast("bigint"))
    return moved.select(
        "seq_id", "clip_ix",
        (F.col("part_start") - F.col("removed_ms")).alias("start_ms"), (F.col("part_end") - F.col("removed_ms")).alias("end_ms"),
        (F.col("in_ms") + F.col("part_start") - F.col("start_ms")).alias("in_ms"),
    )


def remove_clips(clips: DataFrame, gone: DataFrame, ripple: bool = True) -> DataFrame:
    """Clips without listed ones (seq_id, clip_ix); with ``ripple`` later ones of the track move up by what went before."""
    marked = clips.join(gone.select("seq_id", "clip_ix", F.lit(True).alias("_g")), ["seq_id", "clip_ix"], "left")
    w = W.partitionBy("seq_id", "track").orderBy("start_ms", "clip_ix").rowsBetween(W.unboundedPreceding, -1)
    lost = F.coalesce(F.sum(F.when(F.col("_g"), F.col("end_ms") - F.col("start_ms"))).over(w), F.lit(0)) if ripple else F.lit(0)
    out = marked.withColumn("_l", lost).filter(F.col("_g").isNull())
    return out.select("seq_id", "clip_ix", "track", (F.col("start_ms") - F.col("_l")).alias("start_ms"), (F.col("end_ms") - F.col("_l")).alias("end_ms"))


def close_gaps(clips: DataFrame, most_ms: int = 80) -> DataFrame:
    """Ends moved to the next clip's start on the track where one or two frames are missing: seq_id, clip_ix, end_ms."""
    nxt = F.lead("start_ms").over(W.partitionBy("seq_id", "track").orderBy("start_ms", "clip_ix"))
    gap = nxt - F.col("end_ms")
    return clips.select("seq_id", "clip_ix", F.when((gap > 0) & (gap <= most_ms), nxt).otherwise(F.col("end_ms")).alias("end_ms"))


def jump_cuts(clips: DataFrame, least_ms: int = 300) -> DataFrame:
    """Consecutive clips of one source that jump in it: seq_id, clip_ix, jump_ms."""
    w = W.partitionBy("seq_id").orderBy("start_ms", "clip_ix")
    jump = F.col("in_ms") - F.lag("out_ms").over(w)
    same = F.lag("media_id").over(w) == F.col("media_id")
    return clips.select("seq_id", "clip_ix", F.when(same, jump).alias("jump_ms")).filter(F.abs("jump_ms") > least_ms)


def fingerprint(clips: DataFrame) -> DataFrame:
    """seq_id, n, print: a hash over a sequence's ordered clips; equal prints mean nothing to do again."""
    one = F.concat_ws(":", "media_id", "start_ms", "end_ms", "in_ms")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clip_ix", one.alias("x")))), lambda x: x["x"]), "|")
    return clips.groupBy("seq_id").agg(F.count("*").alias("n"), F.substring(F.sha1(text), 1, 16).alias("print"))


def place(points: DataFrame, items: DataFrame, slack_ms: int = 20) -> DataFrame:
    """Source times (media_id, t_ms) on timelines, in the first item that holds them: media_id, t_ms, seq_id, at_ms."""
    i = items.select("seq_id", "clip_ix", "media_id", "start_ms", "in_ms", "out_ms")
    met = intervals.overlap_join(points.select("media_id", "t_ms"), i, ["media_id"], "t_ms", "t_ms", "in_ms", "out_ms", slack_ms=slack_ms)
    ok = met.filter((F.col("t_ms") >= F.col("in_ms") - slack_ms) & (F.col("t_ms") < F.col("out_ms")))
    at = F.col("start_ms") + F.col("t_ms") - F.col("in_ms")
    return ok.groupBy("media_id", "t_ms", "seq_id").agg(F.min_by(at, F.col("clip_ix")).alias("at_ms"))


def sync(clips: DataFrame, offsets: DataFrame) -> DataFrame:
    """Clips (path) with their offset (path, offset_ms, confidence_pct); none is 0; a warning below 1.5."""
    o = offsets.select(F.lower("path").alias("_p"), F.col("offset_ms").alias("_o"), "confidence_pct")
    j = clips.join(o, F.lower("path") == F.col("_p"), "left")
    return j.withColumn("offset_ms", F.coalesce("_o", F.lit(0))).withColumn("warn", F.coalesce(F.col("confidence_pct") < 150, F.lit(False))).drop("_p", "_o", "confidence_pct")


def verified_cameras(clips: DataFrame, offsets: DataFrame, most_ms: int = 50) -> DataFrame:
    """Camera clips with gap to the clip before, error of the source in, and whether one is a fault: seq_id, clip_ix, gap_ms, error_ms, fault."""
    c = clips.join(offsets.select("media_id", "offset_ms"), "media_id")
    gap = F.col("start_ms") - F.lag("end_ms", 1, 0).over(W.partitionBy("seq_id").orderBy("start_ms", "clip_ix"))
    error = F.abs(F.col("in_ms") - (F.col("start_ms") - F.col("offset_ms")))
    return c.select("seq_id", "clip_ix", gap.alias("gap_ms"), error.alias("error_ms")).withColumn("fault", (F.col("error_ms") > most_ms) | (F.abs("gap_ms") > 1))


def overridden(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Items (seq_id, clip_ix, start_ms, end_ms, in_ms) with spans of other material (seq_id, o_start, o_end, o_in) laid over: the rest of each and the spans."""
    parts = intervals.subtract(items.select("seq_id", "clip_ix", "start_ms", "end_ms", "in_ms"), spans, ["seq_id"], "start_ms", "end_ms", "o_start", "o_end")
    rest = parts.select("seq_id", "clip_ix", F.col("part_start").alias("start_ms"), F.col("part_end").alias("end_ms"), (F.col("in_ms") + F.col("part_start") - F.col("start_ms")).alias("in_ms"))
    new = spans.select("seq_id", F.lit(None).cast("bigint").alias("clip_ix"), F.col("o_start").alias("start_ms"), F.col("o_end").alias("end_ms"), F.col("o_in").alias("in_ms"))
    return rest.unionByName(new)


def split_at_word(items: DataFrame, words: DataFrame, prefix: str, after_ms: int, kind: str, least_ms: int = 500) -> DataFrame:
    """Items (media_id, item, a_ms, b_ms, kind) cut at the first word with a prefix after a time; later ones get another kind."""
    at = words.filter((F.col("s_ms") >= after_ms) & F.startswith(F.lower("w"), F.lit(prefix))).groupBy("media_id").agg(F.min("s_ms").alias("_t"))
    j = items.join(at, "media_id", "left")
    crossing = (F.col("a_ms") < F.col("_t")) & (F.col("b_ms") - F.col("_t") > least_ms)
    head = F.struct(F.col("a_ms").alias("a"), F.col("_t").alias("b"), F.col("kind").alias("k"))
    tail = F.struct(F.col("_t").alias("a"), F.col("b_ms").alias("b"), F.lit(kind).alias("k"))
    whole = F.struct(F.col("a_ms").alias("a"), F.col("b_ms").alias("b"), F.when(F.col("a_ms") >= F.col("_t"), F.lit(kind)).otherwise(F.col("kind")).alias("k"))
    parts = F.when(crossing, F.array(head, tail)).otherwise(F.array(whole))
    return j.select("media_id", "item", F.explode(parts).alias("x")).select("media_id", "item", F.col("x.a").alias("a_ms"), F.col("x.b").alias("b_ms"), F.col("x.k").alias("kind"))


def narration_sources(clips: DataFrame, narration: DataFrame) -> DataFrame:
    """Every source ever used under a narration: narration media, source."""
    n = narration.select("seq_id", F.col("media_id").alias("narration"))
    return clips.filter("kind = 'video'").join(n, "seq_id").select("narration", F.col("media_id").alias("source")).distinct()


def picture_cuts(clips: DataFrame, scenes: DataFrame, least_ms: int = 800, edge_ms: int = 120, apart_ms: int = 200) -> DataFrame:
    """Scene changes (media_id, t_ms) in enabled video clips, in timeline time, none next to one kept before: seq_id, at_ms.

    Which are kept depends on those kept, so the last step is a fold over a timeline's few cuts.
    """
    import pandas as pd

    c = clips.filter((F.col("kind") == "video") & ~F.col("disabled") & (F.col("end_ms") - F.col("start_ms") >= least_ms)).select("seq_id", "clip_ix", "media_id", "start_ms", "end_ms", "in_ms", "out_ms")
    met = intervals.overlap_join(scenes.select("media_id", "t_ms"), c, ["media_id"], "t_ms", "t_ms", "in_ms", "out_ms")
    t = F.col("t_ms") - F.col("in_ms")
    near = met.filter((t >= edge_ms) & (t <= F.col("end_ms") - F.col("start_ms") - edge_ms)).select("seq_id", "clip_ix", (F.col("start_ms") + t).alias("at_ms"))

    def fold(key, pdf):
        kept: list[int] = []
        for x in pdf.sort_values(["clip_ix", "at_ms"]).at_ms.tolist():
            if not any(abs(x - y) < apart_ms for y in kept):
                kept.append(x)
        return pd.DataFrame([(key[0], x) for x in sorted(kept)], columns=["seq_id", "at_ms"])

    return near.groupBy("seq_id").applyInPandas(fold, "seq_id bigint, at_ms bigint")


def edit_quality(used: DataFrame, segments: DataFrame, moderators: DataFrame, keyword: str) -> DataFrame:
    """How good an edit is (used: seq_id, media_id, seg_id): seq_id, sentences, by_moderator, fragments, unfinished, on_topic."""
    from cutloom.functions import text as X

    w = W.partitionBy("media_id").orderBy("seg_id")
    low = X.starts_lower(F.col("text"))
    s = segments.withColumn("_low", low).withColumns({"_prev": F.lag("seg_id").over(w), "_next": F.lead("seg_id").over(w), "_nlow": F.lead("_low").over(w), "_nspk": F.lead("speaker").over(w)})
    s = s.join(moderators.select("media_id", "speaker", F.lit(True).alias("_mod")), ["media_id", "speaker"], "left")
    u = used.join(s, ["media_id", "seg_id"])
    have = used.select("seq_id", "media_id", F.col("seg_id").alias("_id"), F.lit(True).alias("_h")).distinct()
    u = u.join(have.withColumnsRenamed({"_id": "_prev", "_h": "_hp"}), ["seq_id", "media_id", "_prev"], "left")
    u = u.join(have.withColumnsRenamed({"_id": "_next", "_h": "_hn"}), ["seq_id", "media_id", "_next"], "left")
    cut = F.col("_nlow") & F.col("speaker").eqNullSafe(F.col("_nspk")) & F.col("_hn").isNull()
    topic = F.contains(X.normal(F.col("text")), F.lit(keyword))
    return u.groupBy("seq_id").agg(
        F.count("*").alias("sentences"), F.count_if(F.coalesce("_mod", F.lit(False))).alias("by_moderator"), F.count_if(F.col("_low") & F.col("_hp").isNull()).alias("fragments"),
        F.count_if(cut).alias("unfinished"), F.count_if(topic).alias("on_topic"),
    )


def speaker_share(used: DataFrame, segments: DataFrame) -> DataFrame:
    """How an edit's time is shared (used: seq_id, media_id, seg_id): seq_id, speaker, ms, pct (floored)."""
    s = used.join(segments.select("media_id", "seg_id", "speaker", (F.col("end_ms") - F.col("start_ms")).alias("_ms")), ["media_id", "seg_id"])
    per = s.groupBy("seq_id", F.coalesce("speaker", F.lit("?")).alias("speaker")).agg(F.sum("_ms").alias("ms"))
    return per.withColumn("pct", F.floor(F.col("ms") * 100 / F.nullif(F.sum("ms").over(W.partitionBy("seq_id")), F.lit(0))))


def unplaced(points: DataFrame, items: DataFrame) -> DataFrame:
    """Source times (media_id, t_ms) that no timeline's item holds, to be warned of."""
    return points.select("media_id", "t_ms").distinct().join(place(points, items).select("media_id", "t_ms").distinct(), ["media_id", "t_ms"], "left_anti")


def matched_fixes(clips: DataFrame, fixes: DataFrame, near_ms: int = 60) -> DataFrame:
    """Manual fixes (seq_id, fix_no, old_ms, new_ms) with the first clip that begins there: seq_id, fix_no, clip_ix, pos_ms, more_ms.

    A clip begins there if its in point is less than ``near_ms`` away; fixes of
    none have nulls, and were made already.
    """
    f = fixes.withColumns({"_lo": F.col("old_ms") - near_ms + 1, "_hi": F.col("old_ms") + near_ms - 1})
    met = intervals.overlap_join(f, clips.select("seq_id", "clip_ix", "in_ms", F.col("start_ms").alias("_s")), ["seq_id"], "_lo", "_hi", "in_ms", "in_ms")
    first = met.groupBy("seq_id", "fix_no").agg(F.min(F.struct("clip_ix", "_s")).alias("_f"))
    found = fixes.join(first, ["seq_id", "fix_no"], "left")
    return found.select("seq_id", "fix_no", F.col("_f.clip_ix").alias("clip_ix"), F.col("_f._s").alias("pos_ms"), F.when(F.col("_f").isNotNull(), F.col("old_ms") - F.col("new_ms")).alias("more_ms"))


def shifted_by(things: DataFrame, matched: DataFrame, near_ms: int = 10) -> DataFrame:
    """Sounds and titles (seq_id, thing_no, start_ms, end_ms, and keys or null: array of (t, v)) after fixes of :func:`matched_fixes`.

    What begins at a fixed clip's start or later (``near_ms`` after it) moves by
    what the clip was made longer, its keys with it; what only ends after it is
    made longer, unless its keys are null (titles), which stay.  Fixes and
    things are one sorted union per timeline with running sums.
    """
    f = matched.filter("clip_ix is not null").select("seq_id", F.col("pos_ms").alias("_t"), F.col("more_ms").alias("_more"))
    ask = lambda t, i: things.select("seq_id", "thing_no", F.lit(i).alias("_i"), t.alias("_t"))
    both = ask(F.col("start_ms") - near_ms, 0).unionByName(ask(F.col("end_ms") - 1, 1)).unionByName(f, allowMissingColumns=True)
    so_far = F.coalesce(F.sum("_more").over(W.partitionBy("seq_id").orderBy("_t").rangeBetween(W.unboundedPreceding, 0)), F.lit(0))
    moved = both.withColumn("_m", so_far).filter("thing_no is not null").groupBy("seq_id", "thing_no").agg(F.max(F.when(F.col("_i") == 0, F.col("_m"))).alias("_a"), F.max(F.when(F.col("_i") == 1, F.col("_m"))).alias("_b"))
    x = things.join(moved, ["seq_id", "thing_no"])
    end = F.when(F.col("keys").isNull(), F.col("_a")).otherwise(F.greatest("_a", "_b"))
    keys = F.transform("keys", lambda k: F.struct((k["t"] + F.col("_a")).alias("t"), k["v"].alias("v")))
    return x.select("seq_id", "thing_no", (F.col("start_ms") + F.col("_a")).alias("start_ms"), (F.col("end_ms") + end).alias("end_ms"), keys.alias("keys"))

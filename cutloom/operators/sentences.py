"""Pauses, islands, safe cut bounds and sentence-level flags."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutloom.operators import intervals

GUARD_MS, EPS_MS = 20, 1


def durations(words: DataFrame, tail_ms: int = 1500) -> DataFrame:
    """media_id, duration_ms: the last word's end and a tail."""
    return words.groupBy("media_id").agg((F.max("e_ms") + tail_ms).alias("duration_ms"))


def pauses(words: DataFrame, media: DataFrame, min_pause_ms: int = 1000) -> DataFrame:
    """Silence of at least ``min_pause_ms`` between words, before the first and after the last: media_id, start_ms, end_ms."""
    w = W.partitionBy("media_id").orderBy("s_ms", "e_ms")
    gaps = words.select("media_id", F.lag("e_ms", 1, 0).over(w).alias("start_ms"), F.col("s_ms").alias("end_ms"), F.when(F.lead(F.lit(True)).over(w).isNull(), F.col("e_ms")).alias("_tail"))
    few = gaps.filter((F.col("end_ms") - F.col("start_ms") >= min_pause_ms) | F.col("_tail").isNotNull()).join(media.select("media_id", "duration_ms"), "media_id", "left")
    both = F.array(F.struct("start_ms", "end_ms"), F.struct(F.col("_tail").alias("start_ms"), F.col("duration_ms").alias("end_ms")))
    return few.select("media_id", F.inline(both)).filter(F.col("end_ms") - F.col("start_ms") >= min_pause_ms)


def speech_islands(words: DataFrame, min_pause_ms: int = 700) -> DataFrame:
    """Runs of words without a pause: media_id, a_ms, b_ms.  The gap is taken to the word before."""
    w = W.partitionBy("media_id").orderBy("s_ms", "e_ms")
    new = F.when(F.col("s_ms") - F.lag("e_ms").over(w) < min_pause_ms, 0).otherwise(1)
    marked = words.withColumn("_n", new).withColumn("_i", F.sum("_n").over(w))
    return marked.groupBy("media_id", "_i").agg(F.min("s_ms").alias("a_ms"), F.max_by("e_ms", F.struct("s_ms", "e_ms")).alias("b_ms")).drop("_i")


def cut_bounds(ranges: DataFrame, words: DataFrame, before_ms: int = 150, after_ms: int = 150) -> DataFrame:
    """``ranges`` (media_id, a_ms, b_ms, ..) with in_ms, min_in_ms, out_ms, max_out_ms.

    Padded, but clear of the words before and after by a guard; the limits say
    how far a later refinement may go.  The neighbours come from one sorted
    union with the words, not from a range join.
    """
    ends = words.select("media_id", (F.col("e_ms") - EPS_MS).alias("_k"), "e_ms")
    with_prev = intervals.neighbours(ranges, ends.select("media_id", "_k"), ["media_id"], "a_ms", "_k").withColumnRenamed("prev_ms", "_prev").drop("next_ms")
    starts = words.select("media_id", (F.col("s_ms") + EPS_MS).alias("_k"))
    both = intervals.neighbours(with_prev, starts, ["media_id"], "b_ms", "_k").withColumnRenamed("next_ms", "_next").drop("prev_ms")
    prev, nxt = F.col("_prev") + EPS_MS + GUARD_MS, F.col("_next") - EPS_MS - GUARD_MS
    a, b = F.col("a_ms"), F.col("b_ms")
    low = F.greatest(a - before_ms, F.coalesce(prev, a - before_ms))
    high = F.least(b + after_ms, F.coalesce(nxt, b + after_ms))
    return both.withColumns(
        {
            "in_ms": F.greatest(F.lit(0), F.least(low, a)),
            "min_in_ms": F.greatest(F.lit(0), F.when(prev.isNull(), 0).otherwise(F.least(prev, a))),
            "out_ms": F.greatest(high, b),
            "max_out_ms": F.greatest(nxt, b),
        }
    ).drop("_prev", "_next")


def remove_pauses(words: DataFrame, media: DataFrame, min_pause_ms: int = 700, pad_ms: int = 150) -> DataFrame:
    """The kept ranges of a recording without its pauses: media_id, in_ms, out_ms."""
    bounded = cut_bounds(speech_islands(words, min_pause_ms), words, pad_ms, pad_ms).join(media, "media_id")
    clipped = bounded.select("media_id", "in_ms", F.least("out_ms", "duration_ms").alias("out_ms"))
    return intervals.merged(clipped, ["media_id"], "in_ms", "out_ms", 0)


def assemble(ranges: DataFrame, frame_ms: int = 40) -> DataFrame:
    """Ranges on a timeline: in floored and out raised to the frame, shorter than a frame skipped, placed one after another."""
    low, high = F.floor(F.col("in_ms") / frame_ms) * frame_ms, F.ceil(F.col("out_ms") / frame_ms) * frame_ms
    r = ranges.withColumns({"in_f": low, "out_f": high}).filter(F.col("out_f") - F.col("in_f") >= frame_ms)
    w = W.partitionBy("media_id").orderBy("in_f").rowsBetween(W.unboundedPreceding, -1)
    return r.withColumn("at_ms", F.coalesce(F.sum(F.col("out_f") - F.col("in_f")).over(w), F.lit(0)))


def merge_in_order(ranges: DataFrame, gap_ms: int = 400) -> DataFrame:
    """Consecutive ranges of a plan united in their order: plan_id, ord, in_ms, out_ms, ids.

    A range joins the one being built if it doesn't begin before it and the gap
    is small; what is built grows, so this is a fold over the plan's ranges,
    which come as arrays, many plans to a batch.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for plan_id, ids, ins, outs in zip(pdf.plan_id, pdf.ids, pdf.ins, pdf.outs, strict=True):
                out: list[list] = []
                for seg_id, in_ms, out_ms in zip(ids.tolist(), ins.tolist(), outs.tolist(), strict=True):
                    if out and in_ms >= out[-1][2] and in_ms - out[-1][3] <= gap_ms:
                        out[-1][3] = max(out[-1][3], out_ms)
                        out[-1][4].append(seg_id)
                    else:
                        out.append([plan_id, len(out) + 1, in_ms, out_ms, [seg_id]])
                rows += out
            yield pd.DataFrame(rows, columns=["plan_id", "ord", "in_ms", "out_ms", "ids"])

    per = ranges.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("ord", "seg_id", "in_ms", "out_ms"))).alias("_r"))
    per = per.select("plan_id", F.col("_r.seg_id").alias("ids"), F.col("_r.in_ms").alias("ins"), F.col("_r.out_ms").alias("outs"))
    return per.mapInPandas(run, "plan_id bigint, ord bigint, in_ms bigint, out_ms bigint, ids array<bigint>")


def suspicious_windows(words: DataFrame, media: DataFrame, flagged: DataFrame, gap_ms: int = 6000, pad_ms: int = 500, join_ms: int = 1000, least_ms: int = 1000) -> DataFrame:
    """Windows to transcribe again: flagged segments and long gaps, padded, clipped, united: media_id, start_ms, end_ms."""
    w = W.partitionBy("media_id").orderBy("s_ms", "e_ms").rowsBetween(W.unboundedPreceding, -1)
    gaps = words.select("media_id", F.coalesce(F.max("e_ms").over(w), F.lit(0)).alias("start_ms"), F.col("s_ms").alias("end_ms"))
    tail = words.groupBy("media_id").agg(F.max("e_ms").alias("start_ms")).join(media, "media_id").select("media_id", "start_ms", F.col("duration_ms").alias("end_ms"))
    both = gaps.unionByName(tail).filter(F.col("end_ms") - F.col("start_ms") > gap_ms).unionByName(flagged.select("media_id", "start_ms", "end_ms"))
    padded = both.join(media, "media_id").select(
        "media_id", F.greatest(F.lit(0), F.col("start_ms") - pad_ms).alias("start_ms"), F.least(F.col("end_ms") + pad_ms, "duration_ms").alias("end_ms")
    )
    return intervals.merged(padded, ["media_id"], "start_ms", "end_ms", join_ms).filter(F.col("end_ms") - F.col("start_ms") >= least_ms)


def asr_flags(words: DataFrame, min_ms: int = 4000) -> DataFrame:
    """Segments that look wrong: long with too few words, or of low mean probability: media_id, seg_id, start_ms, end_ms, reason."""
    s = words.groupBy("media_id", "seg_id").agg(
        F.min("s_ms").alias("start_ms"), F.max("e_ms").alias("end_ms"), F.count("*").alias("n"), F.sum(F.round(F.col("p") * 100).cast("bigint")).alias("p100")
    )
    length = F.col("end_ms") - F.col("start_ms")
    sparse = (length > min_ms) & (F.col("n") * 2000 < length)
    unsure = F.col("p100") < 35 * F.col("n")
    return s.withColumn("reason", F.when(sparse, "sparse").when(unsure, "unsure")).filter("reason is not null").select("media_id", "seg_id", "start_ms", "end_ms", "reason")


def continuity(picks: DataFrame, segments: DataFrame) -> DataFrame:
    """Picks cut from their continuation or start: plan_id, seg_id, flaw.

    The next sentence of the same speaker begins in lower case and isn't
    picked, or the pick begins so and the one before isn't picked.
    """
    w = W.partitionBy("media_id").orderBy("seg_id")
    low = F.substring("text", 1, 1).rlike(r"^\p{Ll}")
    s = segments.withColumn("_low", low)
    s = s.withColumns(
        {
            "_nid": F.lead("seg_id").over(w), "_nlow": F.lead("_low").over(w), "_nspk": F.lead("speaker").over(w),
            "_pid": F.lag("seg_id").over(w), "_pspk": F.lag("speaker").over(w),
        }
    )
    mine = picks.select("plan_id", "media_id", "seg_id").join(s, ["media_id", "seg_id"])
    have = picks.select("plan_id", F.col("seg_id").alias("_have"))
    ends = mine.filter(F.col("_nlow") & F.col("speaker").eqNullSafe(F.col("_nspk"))).select("plan_id", "seg_id", F.col("_nid").alias("_have"), F.lit("unfinished").alias("flaw"))
    begins = mine.filter(F.col("_low") & F.col("speaker").eqNullSafe(F.col("_pspk"))).select("plan_id", "seg_id", F.col("_pid").alias("_have"), F.lit("fragment").alias("flaw"))
    return ends.unionByName(begins).join(have, ["plan_id", "_have"], "left_anti").select("plan_id", "seg_id", "flaw")


def chapters(segments: DataFrame, size: int = 3) -> DataFrame:
    """Chapters of ``size`` sentences: media_id, chapter, seg_from, seg_to."""
    c = segments.withColumn("chapter", F.floor((F.col("seg_id") - 1) / size))
    return c.groupBy("media_id", "chapter").agg(F.min("seg_id").alias("seg_from"), F.max("seg_id").alias("seg_to"))


def in_chapters(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Every chapter with its sentences' bounds and sorted speakers."""
    j = intervals.overlap_join(chapters, segments.select("media_id", "seg_id", "start_ms", "end_ms", "speaker"), ["media_id"], "seg_from", "seg_to", "seg_id", "seg_id", bucket_ms=64)
    return j.groupBy("media_id", "chapter").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.sort_array(F.collect_set("speaker")), ",").alias("speakers"), F.count("*").alias("n")
    )


def repaired(old: DataFrame, new: DataFrame, windows: DataFrame) -> DataFrame:
    """Segments (media_id, start_ms, end_ms, text) with those inside replaced windows exchanged.

    A new segment counts in the window of its midpoint; an old one goes only if
    both ends lie inside a window that got a replacement.
    """
    wnd = windows.select("media_id", F.col("start_ms").alias("_ws"), F.col("end_ms").alias("_we"))
    mid = new.withColumn("_m", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))
    placed = intervals.overlap_join(mid, wnd, ["media_id"], "_m", "_m", "_ws", "_we")
    used = placed.select("media_id", F.col("_ws").alias("_us"), F.col("_we").alias("_ue")).distinct()
    cond = (old["media_id"] == used["media_id"]) & (old["start_ms"] >= used["_us"]) & (old["end_ms"] <= used["_ue"])
    kept = old.join(used, cond, "left_anti")
    cols = ["media_id", "start_ms", "end_ms", "text"]
    return kept.select(*cols).unionByName(placed.select(*cols).distinct())


def text_batches(segments: DataFrame, max_chars: int = 800) -> DataFrame:
    """``segments`` with ``batch``: a new one when the characters so far (12 more per row) would pass ``max_chars``."""

    def fold(pdf):
        pdf = pdf.sort_values("seg_id")
        size, batch, out = 0, 0, []
        for n in pdf["n_chars"].tolist():
            if size and size + n > max_chars:
                batch, size = batch + 1, 0
            size += n + 12
            out.append(batch)
        return pdf.assign(batch=out)[["media_id", "seg_id", "batch"]]

    rows = segments.select("media_id", "seg_id", F.char_length("text").alias("n_chars"))
    return rows.groupBy("media_id").applyInPandas(fold, "media_id bigint, seg_id bigint, batch bigint")


def group_words(words: DataFrame, max_ms: int = 20_000, gap_ms: int = 900, least_ms: int = 1200) -> DataFrame:
    """``words`` (media_id, s_ms, e_ms, w, spk) as sentences: media_id, seg_id, start_ms, end_ms, text, speaker, n_words.

    A sentence ends at a long gap, when it would grow too long, when the
    speaker changes (to or from none, too), and after an end mark once it is
    long enough.  The state starts anew at each sentence, so one recording is
    one sequential pass.
    """
    import re

    def fold(key, pdf):
        rows = list(pdf.sort_values(["s_ms", "e_ms"])[["w", "s_ms", "e_ms", "spk"]].itertuples(index=False))
        out, cur = [], []

        def flush():
            if cur:
                text = re.sub(r"\s+([,.;:!?…])", r"\1", " ".join(x.w for x in cur)).strip()
                out.append((key[0], len(out) + 1, cur[0].s_ms, cur[-1].e_ms, text, cur[0].spk, len(cur)))
                cur.clear()

        for w in rows:
            if cur and (w.s_ms - cur[-1].e_ms > gap_ms or w.e_ms - cur[0].s_ms > max_ms or w.spk != cur[-1].spk):
                flush()
            cur.append(w)
            if w.w.endswith((".", "!", "?", "…")) and w.e_ms - cur[0].s_ms >= least_ms:
                flush()
        flush()
        return pd.DataFrame(out, columns=["media_id", "seg_id", "start_ms", "end_ms", "text", "speaker", "n_words"])

    schema = "media_id bigint, seg_id bigint, start_ms bigint, end_ms bigint, text string, speaker string, n_words bigint"
    return words.select("media_id", "w", "s_ms", "e_ms", "spk").groupBy("media_id").applyInPandas(fold, schema)


def weak_sentences(segments: DataFrame, fillers: list[str], soft: list[str], near_ms: int = 45_000, gap_ms: int = 1200) -> DataFrame:
    """Sentences worth leaving out: media_id, seg_id, reasons (sorted, comma-joined).

    Empty; mostly fillers; a repeated attempt (its first words are much like
    those of one of the next three sentences, soon after); unfinished before a
    pause.  Only the likeness of word lists is Python, in vectors.
    """
    from cutloom.functions import text as X

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def one(x, y):
            if x is None or y is None:
                return False
            n = min(len(x), len(y), 8)
            return n >= 3 and SequenceMatcher(None, list(x[:n]), list(y[:n])).ratio() >= 0.7

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    w = W.partitionBy("media_id").orderBy("seg_id")
    s = segments.withColumn("_w", X.tokens(F.col("text")))
    for k in (1, 2, 3):
        close = F.lead("start_ms", k).over(w) - F.col("end_ms") <= near_ms
        s = s.withColumn(f"_n{k}", F.when(close, F.lead("_w", k).over(w)))
    n = F.size("_w")
    hard, both = F.size(F.filter("_w", lambda x: x.isin(fillers))), F.size(F.filter("_w", lambda x: x.isin([*fillers, *soft])))
    filler = (n > 0) & ((hard * 4 > n) | (n <= 3) & (both == n))
    again = (n > 0) & (alike("_w", "_n1") | alike("_w", "_n2") | alike("_w", "_n3"))
    open_ = (n > 0) & ~X.ends_sentence(F.col("text")) & (F.lead("start_ms").over(w) - F.col("end_ms") > gap_ms)
    found = {"empty": n == 0, "filler": filler, "repeated": again, "unfinished": open_}
    s = s.withColumn("reasons", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in found.items()])), ","))
    return s.filter("reasons <> ''").select("media_id", "seg_id", "reasons")


def covering_chapters(chapters: DataFrame, bounds: DataFrame) -> DataFrame:
    """Chapters (media_id, c_from, c_to) made to cover their recording (media_id, first, last) without gaps or overlaps.

    Swapped bounds are turned, then clipped, then each begins right after the
    one before; what vanishes goes.  A chapter's beginning depends on the
    repaired end before it, which is the original end, so a lag is enough.
    """
    a, b = F.least("c_from", "c_to"), F.greatest("c_from", "c_to")
    c = bounds.join(chapters, "media_id", "left").select("media_id", "first", "last", F.greatest(a, "first").alias("a"), F.least(b, "last").alias("b"))
    whole = c.groupBy("media_id", "first", "last").agg(F.count_if(F.col("a") <= F.col("b")).alias("_n")).filter("_n = 0").select("media_id", F.col("first").alias("c_from"), F.col("last").alias("c_to"))
    c = c.filter("a <= b")
    w = W.partitionBy("media_id").orderBy("a", "b")
    c = c.withColumn("c_from", F.coalesce(F.lag("b").over(w) + 1, "first")).filter(F.col("c_from") <= F.col("b"))
    c = c.withColumn("c_to", F.when(F.lead("a").over(w).isNull(), F.col("last")).otherwise(F.col("b")))
    return c.select("media_id", "c_from", "c_to").unionByName(whole)


def without_overlaps(words: DataFrame, slack_ms: int = 50) -> DataFrame:
    """Words (media_id, s_ms, e_ms, w) that don't begin before the kept ones end; what counts is kept words only, so it is a fold."""

    def fold(pdf):
        reach, keep = None, []
        pdf = pdf.sort_values(["s_ms", "e_ms"])
        for s, e in zip(pdf.s_ms.tolist(), pdf.e_ms.tolist(), strict=True):
            ok = reach is None or s >= reach - slack_ms
            reach = max(reach or 0, e) if ok else reach
            keep.append(ok)
        return pdf[keep]

    return words.select("media_id", "s_ms", "e_ms", "w").groupBy("media_id").applyInPandas(fold, "media_id bigint, s_ms bigint, e_ms bigint, w string")


def false_start(words: str = "words"):
    """Index of the good attempt in an array of words: one of the first four ends with dots and the next repeats an earlier one; else 0."""
    base = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    last = F.least(F.lit(4), F.size(words) - 2)
    tries = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    good = F.filter(tries, lambda k: F.element_at(words, k + 1).rlike(r"(\.\.\.|…)$") & F.array_contains(F.slice(base, 1, k + 1), F.element_at(base, k + 2)))
    return F.coalesce(F.get(good, F.lit(0)) + 1, F.lit(0))


def junk_words(words: DataFrame, phrases: list[str]) -> DataFrame:
    """Words without tokens that hold no letter or digit, and without sentences that are known inventions."""
    from cutloom.functions import text as X

    real = words.filter(F.col("w").rlike(r"[\p{L}\p{N}]"))
    bad = segments_text(real).filter(F.array_join(X.tokens(F.col("text")), " ").isin(phrases)).select("media_id", "seg_id")
    return real.join(bad, ["media_id", "seg_id"], "left_anti")


def segments_text(words: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ")
    return words.groupBy("media_id", "seg_id").agg(text.alias("text"))


# What transcription invents where there is music, silence or nothing.
INVENTED = (
    r"(?i)titulky vytvořil|johnyx|titulky:|subtitles by|amara\.org|www\.|děkuji za pozornost|"
    r"odebírejte|sledujte nás|titulky pro"
)


def without_inventions(words: DataFrame) -> DataFrame:
    """Words with a letter or digit, of segments whose text holds nothing that is known to be invented."""
    bad = segments_text(words).filter(F.col("text").rlike(INVENTED)).select("media_id", "seg_id")
    return words.filter(F.col("w").rlike(r"[\p{L}\p{N}]")).join(bad, ["media_id", "seg_id"], "left_anti")


def doubtful(words: DataFrame, min_ms: int = 4000) -> DataFrame:
    """Segments to hear again, with why: invented, sparse or unsure (:func:`asr_flags`): media_id, seg_id, start_ms, end_ms, reason."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ")
    s = words.groupBy("media_id", "seg_id").agg(
        F.min("s_ms").alias("start_ms"), F.max("e_ms").alias("end_ms"), F.count("*").alias("_n"), F.sum(F.round(F.col("p") * 100).cast("bigint")).alias("_p"), text.alias("_t")
    )
    length = F.col("end_ms") - F.col("start_ms")
    reason = F.when(F.col("_t").rlike(INVENTED), "invented").when((length > min_ms) & (F.col("_n") * 2000 < length), "sparse").when(F.col("_p") < 35 * F.col("_n"), "unsure")
    return s.withColumn("reason", reason).filter("reason is not null").select("media_id", "seg_id", "start_ms", "end_ms", "reason")


def accepted(fresh: DataFrame, silence: DataFrame, *, most_silent: float = 0.6, least_pct: int = 40) -> DataFrame:
    """Segments heard again that count: (media_id, seg_id) of ``fresh`` words.

    They have words, nothing invented, a chance of no speech (media_id, seg_id,
    no_speech) of ``most_silent`` at most, and a mean probability of
    ``least_pct`` percent.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ")
    s = fresh.filter(F.trim("w") != "").groupBy("media_id", "seg_id").agg(F.count("*").alias("_n"), F.sum(F.round(F.col("p") * 100).cast("bigint")).alias("_p"), text.alias("_t"))
    s = s.join(silence, ["media_id", "seg_id"], "left")
    ok = ~F.col("_t").rlike(INVENTED) & (F.coalesce("no_speech", F.lit(0.0)) <= most_silent) & (F.col("_p") >= least_pct * F.col("_n"))
    return s.filter(ok).select("media_id", "seg_id")

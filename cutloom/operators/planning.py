"""Edit plans: pairs, units, ranking, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing_answers(picks: DataFrame, segments: DataFrame, mark: str = r"\?\s*$") -> DataFrame:
    """The other half of every question and answer of which a plan has one: plan_id, added.

    A question is followed by a sentence of another speaker, or both have none.
    """
    w = W.partitionBy("media_id").orderBy("seg_id")
    s = segments.select("media_id", "seg_id", "text", "speaker", F.lead("seg_id").over(w).alias("nid"), F.lead("speaker").over(w).alias("nspk"))
    other = ~F.col("speaker").eqNullSafe(F.col("nspk")) | (F.col("speaker").isNull() & F.col("nspk").isNull())
    pairs = s.filter(F.col("nid").isNotNull() & other & F.col("text").rlike(mark)).select("media_id", F.col("seg_id").alias("q"), F.col("nid").alias("a"))
    both = pairs.select("media_id", F.col("q").alias("seg_id"), F.col("a").alias("added")).unionByName(pairs.select("media_id", F.col("a").alias("seg_id"), F.col("q").alias("added")))
    want = picks.select("plan_id", "media_id", "seg_id").join(both, ["media_id", "seg_id"]).select("plan_id", "added")
    return want.join(picks.select("plan_id", F.col("seg_id").alias("added")), ["plan_id", "added"], "left_anti").distinct()


def units(picks: DataFrame, segments: DataFrame) -> DataFrame:
    """Consecutive picks that follow each other in one speaker's speech as one unit: plan_id, unit, first_id, n, dur_ms, speaker."""
    s = picks.join(segments.select("media_id", "seg_id", "start_ms", "end_ms", "speaker"), ["media_id", "seg_id"])
    w = W.partitionBy("plan_id").orderBy("ord")
    joined = (F.col("seg_id") == F.lag("seg_id").over(w) + 1) & F.col("speaker").eqNullSafe(F.lag("speaker").over(w))
    marked = s.withColumn("_n", F.when(joined, 0).otherwise(1)).withColumn("unit", F.sum("_n").over(w))
    return marked.groupBy("plan_id", "unit").agg(
        F.min("seg_id").alias("first_id"), F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("dur_ms"), F.min("speaker").alias("speaker")
    )


def ranked_passages(candidates: DataFrame, target_ms: int) -> DataFrame:
    """Candidates (plan_id, cand_no, n_words, dur_ms, indep, strength, point, brief, linking) with score10 and rank.

    Scores count in tenths, so that they are whole: 2 indep + 2 strength +
    1.5 point + 2 brief, less 3 for a linking or very short start, less 1.5 for
    a length off the target; ties by distance to the target.
    """
    score = 20 * F.col("indep") + 20 * F.col("strength") + 15 * F.col("point") + 20 * F.col("brief")
    score = score - F.when(F.col("linking") | (F.col("n_words") <= 2), 30).otherwise(0)
    off = (F.col("dur_ms") * 100 > 115 * target_ms) | (F.col("dur_ms") * 100 < 75 * target_ms)
    scored = candidates.withColumn("score10", (score - F.when(off, 15).otherwise(0)).cast("bigint"))
    order = W.partitionBy("plan_id").orderBy(F.desc("score10"), F.abs(F.col("dur_ms") - target_ms), "cand_no")
    return scored.withColumn("rank", F.row_number().over(order))


def finalists(ranked: DataFrame, within10: int = 80) -> DataFrame:
    """Of those near the best the first five independent ones, else the first four."""
    w = W.partitionBy("plan_id")
    near = ranked.withColumn("_b", F.max("score10").over(w)).filter(F.col("score10") >= F.col("_b") - within10)
    free = F.col("indep") > 0
    numbered = near.withColumns({"_f": F.max(free.cast("int")).over(w), "_free": free})
    place = numbered.withColumn("_p", F.row_number().over(W.partitionBy("plan_id", "_free").orderBy("rank"))).withColumn("_q", F.row_number().over(w.orderBy("rank")))
    keep = (F.col("_f") == 1) & F.col("_free") & (F.col("_p") <= 5) | (F.col("_f") == 0) & (F.col("_q") <= 4)
    return place.filter(keep).select("plan_id", "cand_no", "score10", "rank")


def chapter_choice(scores: DataFrame) -> DataFrame:
    """Chapters (plan_id, chapter, score) of at least 2, else of at least 1, else all."""
    best = F.max("score").over(W.partitionBy("plan_id"))
    return scores.withColumn("_b", F.least(F.lit(2), best)).filter((F.col("score") >= F.col("_b")) | (F.col("_b") < 1)).drop("_b")


def capped_candidates(candidates: DataFrame, most: int) -> DataFrame:
    """The ``most`` candidates from the best chapters, in order of time."""
    rank = F.row_number().over(W.partitionBy("plan_id").orderBy(F.desc("score"), "start_ms", "cand_no"))
    kept = candidates.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("plan_id").orderBy("start_ms", "cand_no")))


def unused(segments: DataFrame, picks: DataFrame, excluded: list[str]) -> DataFrame:
    """Sentences neither picked nor of an excluded speaker: media_id, seg_id."""
    free = segments.filter(~F.coalesce(F.col("speaker"), F.lit("")).isin(excluded)).select("media_id", "seg_id")
    return free.join(picks.select("media_id", "seg_id"), ["media_id", "seg_id"], "left_anti")


def voice_over(jobs: DataFrame, lead_ms: int = 250) -> DataFrame:
    """Picture segments under a voice (job_id, ord, start_ms, total_ms): job_id, ord, at_ms, dur_ms.

    Each begins a little before its sentence, the first at 0, and lasts until the next.
    """
    w = W.partitionBy("job_id").orderBy("ord")
    at = F.when(F.row_number().over(w) == 1, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(0), F.col("start_ms") - lead_ms))
    placed = jobs.withColumn("at_ms", at).withColumn("dur_ms", F.coalesce(F.lead("at_ms").over(w), F.col("total_ms")) - F.col("at_ms"))
    return placed.filter("dur_ms > 50").select("job_id", "ord", "at_ms", "dur_ms")


def fit_to_length(units: DataFrame, target_ms: int, tolerance_pct: int = 9) -> DataFrame:
    """Units (plan_id, unit, dur_ms, prio) that fit: dropped from the lowest priority while too long, never below the range.

    What is dropped depends on what was before, so a plan is one pass.
    """
    low, high = target_ms * (100 - tolerance_pct) // 100, target_ms * (100 + tolerance_pct) // 100

    def fold(pdf):
        pdf = pdf.sort_values(["prio", "unit"])
        total, keep = int(pdf.dur_ms.sum()), []
        for r in pdf.itertuples():
            drop = total > high and total - r.dur_ms >= low
            total -= r.dur_ms if drop else 0
            keep.append(not drop)
        return pdf.assign(kept=keep)[["plan_id", "unit", "kept"]]

    return units.select("plan_id", "unit", "dur_ms", "prio").groupBy("plan_id").applyInPandas(fold, "plan_id bigint, unit bigint, kept boolean")


def passages(segments: DataFrame, target_ms: int, pause_ms: int = 120, mark: str = r"[.!?]\W*$") -> DataFrame:
    """Passages of one speaker about as long as the target, clean at both ends: media_id, from_id, to_id, dur_ms.

    They begin after a pause with a capital and end with a mark before a pause.
    Of equal starts, then of equal ends, the nearest to the target stays.  Pairs
    are joined within a speaker's run and the length allowed, never all.
    """
    from cutloom.operators import intervals

    low, high = target_ms * 60 // 100, target_ms * 125 // 100
    w = W.partitionBy("media_id").orderBy("seg_id")
    gap = F.col("start_ms") - F.lag("end_ms").over(w)
    after = F.lead("start_ms").over(w) - F.col("end_ms")
    new = F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(w)), 0).otherwise(1)
    s = segments.withColumns({"_g": gap, "_a": after, "_n": new}).withColumn("run", F.sum("_n").over(w))
    starts = s.filter((F.trim("text") != "") & ~F.col("text").rlike(r"^\s*\p{Ll}") & (F.col("_g").isNull() | (F.col("_g") >= pause_ms)))
    ends = s.filter(F.col("text").rlike(mark) & ~F.col("text").rlike(r"(\.\.\.|…)\W*$") & (F.col("_a").isNull() | (F.col("_a") >= pause_ms)))
    a = starts.select("media_id", "run", F.col("seg_id").alias("from_id"), F.col("start_ms").alias("_s"), (F.col("start_ms") + low).alias("_lo"), (F.col("start_ms") + high).alias("_hi"))
    b = ends.select("media_id", "run", F.col("seg_id").alias("to_id"), F.col("end_ms").alias("_e"))
    met = intervals.overlap_join(a, b, ["media_id", "run"], "_lo", "_hi", "_e", "_e").filter("to_id >= from_id").withColumn("dur_ms", F.col("_e") - F.col("_s"))
    off = F.abs(F.col("dur_ms") - target_ms)
    one = met.withColumn("_r", F.row_number().over(W.partitionBy("media_id", "from_id").orderBy(off, "to_id"))).filter("_r = 1")
    two = one.withColumn("_r", F.row_number().over(W.partitionBy("media_id", "to_id").orderBy(off, "from_id"))).filter("_r = 1")
    return two.select("media_id", "from_id", "to_id", "dur_ms")


def without_shouts(units: DataFrame, least: int = 4) -> DataFrame:
    """Units (plan_id, unit, text) without shouts and scraps, if enough are left."""
    n = F.size(F.split(F.trim("text"), r"\s+"))
    shout = F.contains(F.col("text"), F.lit("!")) & (n <= 10) | (n <= 6)
    left = F.count_if(~shout).over(W.partitionBy("plan_id"))
    return units.withColumn("_k", ~shout | (left < least)).filter("_k").drop("_k")


def short_units(units: DataFrame, target_ms: int, most_ms: int = 8000) -> DataFrame:
    """Only units (plan_id, unit, dur_ms) up to ``most_ms``, where they alone reach twice the target."""
    short = F.col("dur_ms") <= most_ms
    total = F.coalesce(F.sum(F.when(short, F.col("dur_ms"))).over(W.partitionBy("plan_id")), F.lit(0))
    return units.withColumn("_k", short | (total < 2 * target_ms)).filter("_k").drop("_k")


def guarded_verdicts(verdicts: DataFrame, least: int = 5, share_pct: int = 90) -> DataFrame:
    """Verdicts (batch, id, off_topic) with a batch's off-topic labels dropped if nearly all have them."""
    w = W.partitionBy("batch")
    absurd = (F.count("*").over(w) >= least) & (F.count_if("off_topic").over(w) * 100 >= share_pct * F.count("*").over(w))
    return verdicts.withColumn("off_topic", F.col("off_topic") & ~absurd)


def translation_check(pairs: DataFrame) -> DataFrame:
    """Translations (id, src, out): id, verdict: rejected (much too long, or alternatives), untranslated, or ok."""
    from cutloom.functions import text as X

    bad = (F.char_length("out") > 3 * F.char_length("src") + 25) | F.contains(F.col("out"), F.lit(" / "))
    same = (F.array_join(X.tokens(F.col("src")), " ") == F.array_join(X.tokens(F.col("out")), " ")) & F.col("src").rlike(r"\p{L}{3}")
    passes = ~F.col("src").rlike(r"\p{L}{2}")
    return pairs.select("id", F.when(passes, "ok").when(bad, "rejected").when(same, "untranslated").otherwise("ok").alias("verdict"))


def topic_seconds(units: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per plan and topic what is chosen and what is left: plan_id, topic, chosen_ms, left_n, left_ms, shortest_left_ms."""
    u = units.join(chosen.select("plan_id", "unit", F.lit(True).alias("_c")), ["plan_id", "unit"], "left")
    in_, out = F.col("_c"), F.col("_c").isNull()
    return u.groupBy("plan_id", "topic").agg(
        F.coalesce(F.sum(F.when(in_, F.col("dur_ms"))), F.lit(0)).alias("chosen_ms"), F.count_if(out).alias("left_n"),
        F.coalesce(F.sum(F.when(out, F.col("dur_ms"))), F.lit(0)).alias("left_ms"), F.min(F.when(out, F.col("dur_ms"))).alias("shortest_left_ms"),
    )


def assigned_shots(sentences: DataFrame, candidates: DataFrame, seconds_a_shot: int = 5) -> DataFrame:
    """Shots for a voice-over's sentences: job_id, ord, place, shot.

    A sentence (job_id, ord, dur_ms) wants one to four shots; the least used of
    its candidates (job_id, ord, shot, rank) comes first, none twice in a row.
    Use so far decides, so a job is a fold.
    """
    import pandas as pd

    want = F.greatest(F.lit(1), F.least(F.lit(4), F.bround(F.col("dur_ms") / (1000 * seconds_a_shot)).cast("int")))
    shots = candidates.groupBy("job_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shot"))), lambda x: x["shot"]).alias("shots"))
    rows = sentences.join(shots, ["job_id", "ord"]).select("job_id", "ord", want.alias("want"), "shots")

    def fold(key, pdf):
        used, last, out = {}, None, []
        for r in pdf.sort_values("ord").itertuples():
            for place in range(1, r.want + 1):
                free = [s for s in r.shots if s != last] or list(r.shots)
                last = min(free, key=lambda s: used.get(s, 0))
                used[last] = used.get(last, 0) + 1
                out.append((key[0], r.ord, place, last))
        return pd.DataFrame(out, columns=["job_id", "ord", "place", "shot"])

    return rows.groupBy("job_id").applyInPandas(fold, "job_id bigint, ord bigint, place bigint, shot bigint")


def spread(candidates: DataFrame, most: int = 12) -> DataFrame:
    """Teaser candidates (plan_id, cand_no, a, b, score10), the best first, none overlapping one taken before: plan_id, cand_no, place."""
    import pandas as pd

    def fold(key, pdf):
        taken, out = [], []
        for r in pdf.sort_values(["score10", "a", "cand_no"], ascending=[False, True, True]).itertuples():
            if len(out) < most and all(r.b < a or r.a > b for a, b in taken):
                taken.append((r.a, r.b))
                out.append((key[0], r.cand_no, len(out) + 1))
        return pd.DataFrame(out, columns=["plan_id", "cand_no", "place"])

    return candidates.select("plan_id", "cand_no", "a", "b", "score10").groupBy("plan_id").applyInPandas(fold, "plan_id bigint, cand_no bigint, place bigint")


def newest_names(items: DataFrame, part: str, key: str, at: str, name: str = "name") -> DataFrame:
    """Items whose name holds a part, whatever its case and marks, by their place from the newest: (``key``, place).

    Places are counted over ranges of time, each on its own, with the numbers of
    newer ranges before, so that no task orders all items.
    """
    from cutloom.functions import text as X

    hits = items.filter(X.normal(F.col(name)).contains(part)).select(key, at)
    parts = hits.repartitionByRange(F.desc(at), F.desc(key)).withColumn("_p", F.spark_partition_id())
    own = parts.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(F.desc(at), F.desc(key))))
    # As many rows as there are partitions.
    sizes = own.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return own.join(before, "_p").select(key, (F.col("_n") + F.col("_b")).cast("int").alias("place"))


def voice_over_segments(segments: DataFrame, *, lead_ms: int = 250, least_ms: int = 50) -> DataFrame:
    """Pictures under a voice: job_id, ord, source, in_ms, at_ms, dur_ms.

    ``segments`` (job_id, ord, source, in_ms, at_ms, start_ms, total_ms,
    media_ms) lie where ``at_ms`` says, else ``lead_ms`` before their sentence's
    start; those with neither go.  The first begins at 0, each lasts until the
    next, the last until the end of the voice; of ``least_ms`` or less they go.
    A picture that would run beyond the end of its recording (``media_ms``, null
    if unknown) begins earlier in it, at 0 at most.
    """
    s = segments.withColumn("at_ms", F.coalesce("at_ms", F.when(F.col("start_ms").isNotNull(), F.greatest(F.lit(0), F.col("start_ms") - lead_ms)))).filter("at_ms is not null")
    w = W.partitionBy("job_id").orderBy("at_ms", "ord")
    s = s.withColumn("_at", F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.col("at_ms")))
    s = s.withColumn("dur_ms", F.coalesce(F.lead("at_ms").over(w), F.col("total_ms")) - F.col("_at")).filter(F.col("dur_ms") > least_ms)
    pulled = F.when(F.col("in_ms") + F.col("dur_ms") > F.col("media_ms"), F.greatest(F.lit(0), F.col("media_ms") - F.col("dur_ms"))).otherwise(F.col("in_ms"))
    return s.select("job_id", "ord", "source", pulled.cast("bigint").alias("in_ms"), F.col("_at").cast("bigint").alias("at_ms"), F.col("dur_ms").cast("bigint").alias("dur_ms"))


def with_pairs(picks: DataFrame, segments: DataFrame, excluded: DataFrame, mark: str = r"\?\s*$") -> DataFrame:
    """Picks (plan_id, media_id, seg_id) with the other half of every question and answer: plan_id, media_id, seg_id, added.

    A question (``segments``: media_id, seg_id, text, speaker) ends with its mark
    and is followed by the next number, of another speaker, or both have none.
    A picked answer gets its question; a picked question, or one that came in as
    an answer, gets its answer, so that a chain of questions is followed to its
    end.  Sentences of excluded speakers (media_id, speaker) don't come in.
    """
    w = W.partitionBy("media_id").orderBy("seg_id")
    other = (F.col("speaker") != F.lead("speaker").over(w)) | (F.col("speaker").isNull() & F.lead("speaker").over(w).isNull())
    follows = F.lead("seg_id").over(w) == F.col("seg_id") + 1
    s = segments.join(excluded.select("media_id", "speaker", F.lit(True).alias("_out")).distinct(), ["media_id", "speaker"], "left")
    s = s.select("media_id", "seg_id", F.coalesce(F.col("text").rlike(mark) & other & follows, F.lit(False)).alias("_q"), F.coalesce("_out", F.lit(False)).alias("_out"))
    p = picks.select("plan_id", "media_id", "seg_id").distinct().withColumn("_kept", F.lit(True))
    x = p.select("plan_id", "media_id").distinct().join(s, "media_id").join(p, ["plan_id", "media_id", "seg_id"], "left")
    near = W.partitionBy("plan_id", "media_id").orderBy("seg_id")
    kept = F.coalesce("_kept", F.lit(False))
    x = x.withColumn("_base", kept | (F.col("_q") & ~F.col("_out") & F.coalesce(F.lead("_kept").over(near), F.lit(False))))
    # A run goes on where the sentence before is a question; in it, what is there stays there.
    new = ~F.coalesce(F.lag("_q").over(near), F.lit(False)) | F.col("_out")
    x = x.withColumn("_run", F.sum(new.cast("int")).over(near))
    held = F.max("_base").over(W.partitionBy("plan_id", "media_id", "_run").orderBy("seg_id"))
    return x.withColumn("_held", held).filter("_held").select("plan_id", "media_id", "seg_id", (~kept).alias("added"))


def outline_units(picks: DataFrame, segments: DataFrame) -> DataFrame:
    """Picked sentences that must not be parted as units: plan_id, media_id, unit, first_id, n, dur_ms, priority, core, topic, score, speaker.

    ``picks`` has plan_id, media_id, seg_id, priority, core, topic and score,
    ``segments`` start_ms, end_ms, speaker and the flags question (answered by
    the next sentence) and goes_on.  A picked sentence belongs to the unit of the
    picked one with the number before if that is a question or it goes on from
    it.  A unit has its smallest priority, is core if any of it is, has its first
    topic and its first sentence's score; its speaker is who speaks longest in
    it, the earlier one on a tie.
    """
    s = picks.join(segments.select("media_id", "seg_id", "start_ms", "end_ms", "speaker", "question", "goes_on"), ["media_id", "seg_id"])
    w = W.partitionBy("plan_id", "media_id").orderBy("seg_id")
    joined = (F.col("seg_id") == F.lag("seg_id").over(w) + 1) & (F.lag("question").over(w) | F.col("goes_on"))
    s = s.withColumn("unit", F.sum(F.when(joined, 0).otherwise(1)).over(w)).withColumn("_ms", F.col("end_ms") - F.col("start_ms"))
    key = ["plan_id", "media_id", "unit"]
    said = s.groupBy(*key, F.coalesce("speaker", F.lit("")).alias("_who")).agg(F.sum("_ms").alias("_t"), F.min("seg_id").alias("_i"))
    said = said.groupBy(*key).agg(F.max_by("_who", F.struct("_t", -F.col("_i"))).alias("speaker"))
    topic = F.min(F.when(F.col("topic").isNotNull(), F.struct("seg_id", "topic")))["topic"]
    u = s.groupBy(*key).agg(
        F.min("seg_id").alias("first_id"), F.count("*").alias("n"), F.sum("_ms").alias("dur_ms"), F.min("priority").alias("priority"), F.bool_or("core").alias("core"),
        topic.alias("topic"), F.min_by("score", "seg_id").alias("score"),
    )
    return u.join(said, key)

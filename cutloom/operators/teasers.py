"""Teasers: short statements cut out of sentences, ranked, put together to a length, repaired where an edge is bad."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What ends a unit, what doesn't, and what no statement begins with.
STOP = r"[.!?]$"
NO_STOP = r"(\.\.\.|…)$"
ANSWERS = r"(?i)^(absolutně|jo|ano|ne|jasně|určitě|přesně|no|dobře|tak)[^\p{L}\p{N}_]*$"
OPENERS = (
    r"^(takže|tak|proto|protože|no|jo|taky|tím|že|za (prvé|druhé|třetí|čtvrté)|zaprvé|zadruhé|"
    r"zatřetí|navíc|dále|zároveň|také|další)(?:[^\p{L}\p{N}_]|$)"
)
#: Silence after a unit that has no other, the last of a recording.
OPEN_MS = 500


def units(words: DataFrame) -> DataFrame:
    """Words (media_id, seg_id, pos, w, s_ms, e_ms, spk) in the pieces of sentences between their stops.

    media_id, n (from 0), seg_id, w0, w1, s_ms, e_ms, text, speaker, closed (ends at a stop), full (a whole sentence).
    """
    w = W.partitionBy("media_id", "seg_id").orderBy("pos")
    stop = F.col("w").rlike(STOP) & ~F.col("w").rlike(NO_STOP)
    x = words.withColumn("_stop", stop).withColumn("_piece", F.sum(stop.cast("int")).over(w) - stop.cast("int"))
    x = x.groupBy("media_id", "seg_id", "_piece").agg(
        F.min("pos").alias("w0"), F.max("pos").alias("w1"), F.min_by("s_ms", "pos").alias("s_ms"), F.max_by("e_ms", "pos").alias("e_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda i: i["w"]), " ").alias("text"),
        F.min("spk").alias("speaker"), F.bool_or("_stop").alias("closed"),
    )
    x = x.withColumn("full", F.count("*").over(W.partitionBy("media_id", "seg_id")) == 1)
    n = F.row_number().over(W.partitionBy("media_id").orderBy("seg_id", "w0")) - 1
    return x.select("media_id", n.cast("bigint").alias("n"), "seg_id", "w0", "w1", "s_ms", "e_ms", "text", "speaker", "closed", "full")


def borders(units: DataFrame) -> DataFrame:
    """The gaps between units as pairs of times, to be measured once each: media_id, pair_no (the unit before), a_ms, b_ms."""
    w = W.partitionBy("media_id").orderBy("n")
    return units.select("media_id", F.col("n").alias("pair_no"), F.col("e_ms").alias("a_ms"), F.lead("s_ms").over(w).alias("b_ms")).filter("b_ms is not null")


def candidates(
    units: DataFrame, silences: DataFrame | None = None, *, excluded: Column | None = None, avoid: Column | None = None,
    shortest_ms: int = 1200, longest_ms: int = 8000, longest_run_ms: int = 9000, most_units: int = 2, pause_ms: int = 120, silence_ms: int = 70,
) -> DataFrame:
    """Runs of one speaker's units that stand alone: media_id, n, last_n, dur_ms, edge_ms, text, before, after, speaker.

    A run begins with a capital, no answer, no opener that goes on from a thought
    before, and at a pause; it ends at a stop, at a pause, and where the same
    speaker doesn't go on in lower case.  ``silences`` (media_id, pair_no,
    silence_ms) are the measured silences of :func:`borders`: each border is
    looked up once, however many runs have it; without them a gap between words
    of ``pause_ms`` is a pause.  ``excluded`` marks units whose speaker may not
    begin, ``avoid`` those that no run may hold.  ``edge_ms`` is the shorter
    silence at its edges, ``before`` and ``after`` the two units around.
    """
    w = W.partitionBy("media_id").orderBy("n")
    x = units.withColumn("_out", excluded if excluded is not None else F.lit(False)).withColumn("_avoid", avoid if avoid is not None else F.lit(False))
    gap = F.lead("s_ms").over(w) - F.col("e_ms")
    if silences is None:
        x = x.withColumns({"_pause": F.coalesce(gap >= pause_ms, F.lit(True)), "_edge": F.lit(OPEN_MS).cast("bigint")})
    else:
        x = x.join(silences.select("media_id", F.col("pair_no").alias("n"), F.col("silence_ms").cast("bigint").alias("_ms")), ["media_id", "n"], "left")
        last = F.lead("n").over(w).isNull()
        x = x.withColumn("_edge", F.when(last, OPEN_MS).otherwise(F.coalesce("_ms", F.lit(0))))
        x = x.withColumn("_pause", last | (F.col("_edge") >= silence_ms))
    t = F.trim("text")
    starts = ~F.col("_out") & ~F.col("_avoid") & t.rlike(r"^\P{Ll}") & ~t.rlike(ANSWERS) & ~F.lower(t).rlike(OPENERS) & F.lag("_pause", 1, True).over(w)
    goes_on = F.coalesce(F.lead("speaker").over(w).eqNullSafe(F.col("speaker")) & F.lead("text").over(w).rlike(r"^\p{Ll}") & F.lead("n").over(w).isNotNull(), F.lit(False))
    ends = F.col("closed") & F.col("_pause") & ~goes_on
    x = x.withColumns({"_starts": starts, "_ends": ends, "_edge_before": F.lag("_edge", 1, OPEN_MS).over(w)})
    x = x.withColumn("_ahead", F.collect_list(F.struct("n", "e_ms", "text", "speaker", F.col("_ends").alias("ends"), F.col("_edge").alias("edge"), F.col("_avoid").alias("avoid"))).over(w.rowsBetween(0, most_units + 1)))
    x = x.withColumn("before", F.array_join(F.collect_list("text").over(w.rowsBetween(-2, -1)), " "))
    k = F.explode(F.sequence(F.lit(1), F.least(F.lit(most_units), F.size("_ahead")))).alias("_k")
    x = x.filter("_starts").select("*", k).withColumn("_run", F.slice("_ahead", 1, F.col("_k"))).withColumn("_last", F.element_at("_ahead", F.col("_k")))
    dur = F.col("_last.e_ms") - F.col("s_ms")
    one = F.forall("_run", lambda u: u["speaker"].eqNullSafe(F.col("speaker")) & ~u["avoid"])
    fits = dur.between(shortest_ms, F.when(F.col("_k") == 1, longest_ms).otherwise(longest_run_ms))
    text = lambda c: F.array_join(F.transform(c, lambda u: u["text"]), " ")
    return x.filter(one & fits & F.col("_last.ends")).select(
        "media_id", "n", F.col("_last.n").alias("last_n"), dur.alias("dur_ms"), F.least("_edge_before", F.col("_last.edge")).alias("edge_ms"),
        text("_run").alias("text"), "before", text(F.slice("_ahead", F.col("_k") + 1, 2)).alias("after"), "speaker",
    )


def ranked(rated: DataFrame, *, most: int = 12, short_edge_ms: int = 150) -> DataFrame:
    """Candidates (plan_id, n, last_n, edge_ms, and how they do as hook, alone and in force, 0 to 3) by score, without overlaps: plan_id, n, last_n, score10, rank.

    The score is 3, 2 and 1.5 for a point of each, less 1.5 where an edge is
    short; ties go to the earlier and shorter one.  One that shares a unit with
    a better one goes, and ``most`` stay.  Which stay depends on all better
    ones, so a plan is one fold.
    """
    score = 30 * F.col("hook") + 20 * F.col("alone") + 15 * F.col("force") - F.when(F.col("edge_ms") < short_edge_ms, 15).otherwise(0)
    x = rated.select("plan_id", "n", "last_n", score.cast("bigint").alias("score10"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score10", "n", "last_n"], ascending=[False, True, True], ignore_index=True)
        taken, keep = np.zeros(int(pdf.last_n.max()) + 1, bool), []
        for r in pdf.itertuples():
            if len(keep) < most and not taken[r.n : r.last_n + 1].any():
                taken[r.n : r.last_n + 1] = True
                keep.append(r.Index)
        return pdf.loc[keep].assign(rank=range(1, len(keep) + 1))

    return x.groupBy("plan_id").applyInPandas(fold, "plan_id bigint, n bigint, last_n bigint, score10 bigint, rank int")


def _sum(c: Column, field: str = "ms") -> Column:
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x[field])


def assembled(statements: DataFrame, targets: DataFrame, *, spares: int = 6) -> DataFrame:
    """(plan_id, cand, place, spare): a teaser of about its target's length.

    ``statements`` (plan_id, cand, rank, place, dur_ms) are all that were found,
    best first, ``place`` where an editor put them, or null; ``targets``
    (plan_id, target_ms).  If none was placed the best two are.  While there are
    more than two and they are longer than 1.2 targets the longest between the
    first and the last goes; while they are shorter than 0.85 the best that
    still fits 1.15 comes in before the last.  Of those left ``spares`` are kept,
    best first.  A plan has a handful of statements, so both loops are
    expressions on arrays of them.
    """
    item = F.struct("rank", "cand", F.col("dur_ms").cast("bigint").alias("ms"))
    p = statements.groupBy("plan_id").agg(F.sort_array(F.collect_list(item)).alias("all"), F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", item.alias("x"))))).alias("own"))
    p = p.join(targets, "plan_id").withColumn("own", F.transform("own", lambda x: x["x"]))
    p = p.withColumn("own", F.when(F.size("own") > 0, F.col("own")).otherwise(F.slice("all", 1, 2)))
    target = F.col("target_ms")

    def shorter(acc: Column, _: Column) -> Column:
        middle = F.transform(F.slice(acc, 2, F.greatest(F.size(acc) - 2, F.lit(0))), lambda x: x["ms"])
        longest = F.array_position(middle, F.array_max(middle))
        return F.when((F.size(acc) > 2) & (_sum(acc) * 10 > target * 12), F.filter(acc, lambda x, i: i != longest)).otherwise(acc)

    def longer(acc: Column, x: Column) -> Column:
        fits = (_sum(acc) * 100 < target * 85) & ~F.exists(acc, lambda y: y["cand"] == x["cand"]) & ((_sum(acc) + x["ms"]) * 100 <= target * 115)
        front = F.greatest(F.size(acc) - 1, F.lit(1))
        return F.when(fits, F.concat(F.slice(acc, 1, front), F.array(x), F.slice(acc, front + 1, F.size(acc)))).otherwise(acc)

    p = p.withColumn("own", F.aggregate(F.sequence(F.lit(1), F.size("own")), F.col("own"), shorter))
    p = p.withColumn("own", F.aggregate("all", F.col("own"), longer))
    p = p.withColumn("rest", F.slice(F.filter("all", lambda x: ~F.exists("own", lambda y: y["cand"] == x["cand"])), 1, spares))
    own = p.select("plan_id", F.posexplode("own").alias("i", "x")).select("plan_id", "x.cand", (F.col("i") + 1).alias("place"), F.lit(None).cast("int").alias("spare"))
    rest = p.select("plan_id", F.posexplode("rest").alias("i", "x")).select("plan_id", "x.cand", F.lit(None).cast("int").alias("place"), (F.col("i") + 1).alias("spare"))
    return own.unionByName(rest)


def repaired(ranges: DataFrame, bad: DataFrame, spares: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, place, ids, dur_ms, spare): a teaser without the ranges whose edges are bad, filled up again by spares.

    ``ranges`` (plan_id, ord, ids, dur_ms), ``bad`` (plan_id, seg_id), ``spares``
    (plan_id, ord, ids, dur_ms, range_ms, clean) and ``targets`` (plan_id,
    target_ms or null).  Ranges with a bad sentence go if two or more stay and
    60 percent of the target; then spares in their order, clean ones without a
    bad or used sentence, come in before the last range, until 85 percent are
    reached, none that would lead beyond 115.  Else all stays as it is.
    """
    wrong = bad.groupBy("plan_id").agg(F.collect_set("seg_id").alias("bad"))
    of = lambda df, *fields: df.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("ord", *fields))).alias("x"))
    p = of(ranges, "ids", F.col("dur_ms").cast("bigint").alias("ms")).withColumnRenamed("x", "all")
    p = p.join(wrong, "plan_id", "left").join(targets, "plan_id", "left")
    p = p.join(of(spares.filter("clean"), "ids", F.col("dur_ms").cast("bigint").alias("ms"), F.col("range_ms").cast("bigint").alias("built")).withColumnRenamed("x", "extra"), "plan_id", "left")
    p = p.withColumn("bad", F.coalesce("bad", F.expr("cast(array() as array<bigint>)")))
    p = p.withColumn("kept", F.filter("all", lambda x: ~F.arrays_overlap(x["ids"], F.col("bad"))))
    target = F.col("target_ms")
    drops = (F.size("kept") < F.size("all")) & (F.size("kept") >= 2) & (target.isNull() | (_sum(F.col("kept")) * 10 >= target * 6))
    p = p.withColumn("drops", drops).withColumn("kept", F.when(F.col("drops"), F.col("kept")).otherwise(F.col("all")))

    def fill(acc: Column, s: Column) -> Column:
        fits = (acc["total"] * 100 < target * 85) & ((acc["total"] + s["ms"]) * 100 <= target * 115)
        fits = fits & ~F.arrays_overlap(s["ids"], F.col("bad")) & ~F.arrays_overlap(s["ids"], acc["used"])
        grown = F.struct((acc["total"] + s["built"]).alias("total"), F.concat(acc["used"], s["ids"]).alias("used"), F.concat(acc["more"], F.array(F.struct(s["ids"].alias("ids"), s["built"].alias("ms"), s["ord"].alias("spare")))).alias("more"))
        return F.when(F.coalesce(fits, F.lit(False)), grown).otherwise(acc)

    kind = "array<struct<ids:array<bigint>,ms:bigint,spare:bigint>>"
    start = F.struct(_sum(F.col("kept")).alias("total"), F.flatten(F.transform("kept", lambda x: x["ids"])).alias("used"), F.expr(f"cast(array() as {kind})").alias("more"))
    more = F.when(F.col("drops") & F.col("extra").isNotNull(), F.aggregate("extra", start, fill)["more"]).otherwise(F.expr(f"cast(array() as {kind})"))
    own = F.transform("kept", lambda x: F.struct(x["ids"].alias("ids"), x["ms"].alias("ms"), F.lit(None).cast("bigint").alias("spare")))
    p = p.withColumn("own", own).withColumn("more", more)
    n = F.size("own")
    p = p.withColumn("out", F.concat(F.slice("own", 1, F.greatest(n - 1, F.lit(0))), F.col("more"), F.slice("own", F.greatest(n, F.lit(1)), 1)))
    return p.select("plan_id", F.posexplode("out").alias("i", "x")).select("plan_id", (F.col("i") + 1).alias("place"), "x.ids", F.col("x.ms").alias("dur_ms"), "x.spare")

"""Versions, statistics and scores of runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def current_version(df: DataFrame, by: list[str], newest: list) -> DataFrame:
    """The last written row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*newest))).filter("_r = 1").drop("_r")


def call_statistics(calls: DataFrame) -> DataFrame:
    """Calls (phase, sec, prompt) per phase; a missing phase is "-": phase, calls, sec, prompt."""
    return calls.groupBy(F.coalesce("phase", F.lit("-")).alias("phase")).agg(F.count("*").alias("calls"), F.sum("sec").alias("sec"), F.sum("prompt").alias("prompt"))


def language_vote(votes: DataFrame) -> DataFrame:
    """The language (media_id, lang, p) with the largest sum of probability: media_id, lang."""
    s = votes.groupBy("media_id", "lang").agg(F.sum("p").alias("p"))
    return s.groupBy("media_id").agg(F.max_by("lang", F.struct("p", "lang")).alias("lang"))


def best_overlap(picked: DataFrame, references: DataFrame) -> DataFrame:
    """Jaccard per cent of ids (plan_id, ids) with the best of several references (plan_id, ref_no, ids): plan_id, best_pct."""
    j = picked.join(references.withColumnRenamed("ids", "_ref"), "plan_id")
    both, any_ = F.size(F.array_intersect("ids", "_ref")), F.size(F.array_union("ids", "_ref"))
    return j.groupBy("plan_id").agg(F.max(F.floor(both * 100 / F.greatest(any_, F.lit(1)))).alias("best_pct"))


def stability(rounds: DataFrame) -> DataFrame:
    """Ids over rounds (plan_id, round, id): plan_id, rounds, distinct_ids, always."""
    n = rounds.groupBy("plan_id").agg(F.count_distinct("round").alias("rounds"), F.count_distinct("id").alias("distinct_ids"))
    per = rounds.groupBy("plan_id", "id").agg(F.count_distinct("round").alias("k")).join(n, "plan_id")
    return per.groupBy("plan_id").agg(F.max("rounds").alias("rounds"), F.max("distinct_ids").alias("distinct_ids"), F.count_if(F.col("k") == F.col("rounds")).alias("always"))


def sync_errors(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Offsets found against known ones (path, offset_ms): path, error_ms."""
    return found.join(truth.withColumnRenamed("offset_ms", "_t"), "path").select("path", F.abs(F.col("offset_ms") - F.col("_t")).alias("error_ms"))


def word_alignment(pairs: DataFrame) -> DataFrame:
    """Word error rate of recordings (media_id, ref, hyp as arrays of words): media_id, n_ref, errors.

    An edit distance is one table per recording; rows of it are filled as arrays.
    """
    import numpy as np

    def distance(ref: list[str], hyp: list[str]) -> int:
        code: dict[str, int] = {}
        r, h = (np.array([code.setdefault(w, len(code)) for w in x], "i8") for x in (ref, hyp))
        row, place = np.arange(h.size + 1), np.arange(h.size + 1)
        for i, w in enumerate(r.tolist(), 1):
            best = np.minimum(row[1:] + 1, row[:-1] + (h != w))
            row = np.minimum.accumulate(np.concatenate([[i], best]) - place) + place
        return int(row[-1])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(n_ref=[len(x) for x in pdf.ref], errors=[distance(list(a), list(b)) for a, b in zip(pdf.ref, pdf.hyp, strict=True)])[["media_id", "n_ref", "errors"]]

    return pairs.select("media_id", "ref", "hyp").mapInPandas(run, "media_id bigint, n_ref bigint, errors bigint")


def trace(ref: list[str], hyp: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """The edit distance of two lists of words, and the pairs of places that its path matches.

    From the end the path goes over a match where it can, else past a word of
    the reference, else past one of the other, else over a replacement.  A row
    of the table is two numbers with a bit for each word of ``hyp``: where it
    rises and where it falls by one (Myers).  Only every so many rows are kept;
    those between are filled again when the path comes to them.
    """
    full, places = (1 << len(hyp)) - 1, {}
    for j, w in enumerate(hyp):
        places[w] = places.get(w, 0) | 1 << j

    def following(up: int, down: int, w: str) -> tuple[int, int, int]:
        """The next row's rises and falls, and where it is one above the row before."""
        same = places.get(w, 0)
        level = ((((same & up) + up) ^ up) | same | down) & full
        above, below = down | (full & ~(level | up)), level & up
        shifted = (above << 1 | 1) & full
        return (below << 1 | ~(level | shifted)) & full, shifted & level, above

    step = max(1, int(len(ref) ** 0.5))
    row = (full, 0)
    kept = [row]
    for i, w in enumerate(ref, 1):
        row = following(*row, w)[:2]
        if i % step == 0:
            kept.append(row)
    distance = len(ref) + row[0].bit_count() - row[1].bit_count()
    i, j, pairs = len(ref), len(hyp), []
    while i and j:
        start = (i - 1) // step * step
        (up, down), rows = kept[start // step], []
        for w in ref[start:i]:
            up, down, above = following(up, down, w)
            rows.append((above, up))
        while i > start and j:
            above, up = rows[i - start - 1]
            if ref[i - 1] == hyp[j - 1]:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif above >> (j - 1) & 1:
                i -= 1
            elif up >> (j - 1) & 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
    return distance, pairs[::-1]


def word_deviations(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Two transcripts' words (media_id, pos, w, s_ms, e_ms) compared: media_id, n_ref, errors, matched, mean_ms, p95_ms.

    Words are compared in lower case without marks.  The deviations are those of
    starts and ends of matched words: their mean, and the one that 95 percent of
    them come before; 0 where nothing matches.  A recording that only one has
    is compared with no words.
    """
    plain = F.regexp_replace(F.lower("w"), r"[^\p{L}\p{N}_]", "")

    def words(df: DataFrame, name: str) -> DataFrame:
        w = F.array_sort(F.collect_list(F.struct("pos", plain.alias("w"), "s_ms", "e_ms")))
        field = lambda f: F.transform(w, lambda x: x[f]).alias(f"{name}_{f}")
        return df.groupBy("media_id").agg(field("w"), field("s_ms"), field("e_ms"))

    def run(batches):
        for pdf in batches:
            out = []
            for x in pdf.to_dict("records"):
                a, b = ([] if x[f"{n}_w"] is None else list(x[f"{n}_w"]) for n in ("ref", "hyp"))
                errors, pairs = trace(a, b)
                off = [abs(int(x[f"ref_{f}"][i]) - int(x[f"hyp_{f}"][j])) for i, j in pairs for f in ("s_ms", "e_ms")]
                off.sort()
                out.append((x["media_id"], len(a), errors, len(pairs), sum(off) / len(off) if off else 0.0, off[int(0.95 * len(off))] if off else 0))
            yield pd.DataFrame(out, columns=["media_id", "n_ref", "errors", "matched", "mean_ms", "p95_ms"])

    both = words(ref, "ref").join(words(hyp, "hyp"), "media_id", "full")
    return both.mapInPandas(run, "media_id bigint, n_ref bigint, errors bigint, matched bigint, mean_ms double, p95_ms bigint")


def measure_ranges(rounds: DataFrame) -> DataFrame:
    """Measures of rounds (plan_id, round, measure, value): plan_id, measure, rounds, mean, least, most."""
    return rounds.groupBy("plan_id", "measure").agg(F.count_distinct("round").alias("rounds"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def run_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs (length, target, overlap, clean; length is null where nothing was made) in sum: ``by``, runs, made, clean, overlap, off_pct.

    ``overlap`` and ``off_pct``, the deviation of lengths in percent of their
    targets, are means over what was made, whole numbers, halves up; 0 where
    there is none.
    """
    made = F.col("length").isNotNull()
    whole = lambda c: F.coalesce(F.floor(c + 0.5), F.lit(0)).cast("bigint")
    off = F.when(made, F.abs(F.col("length") - F.col("target")) * 100 / F.col("target"))
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_if(made).alias("made"), F.count_if(made & F.col("clean")).alias("clean"), whole(F.avg(F.when(made, F.col("overlap")))).alias("overlap"), whole(F.avg(off)).alias("off_pct")
    )

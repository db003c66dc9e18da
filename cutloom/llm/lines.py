"""Line dedup: repeated runs of lines by prefix doubling over line ids.

Every line gets an id; positions are named by the rank of the run of lines that
begins there, first of one line, then of twice as many, each rank found from
two ranks of half the length.  Positions with the same rank are one interval of
the suffix order whose common prefix has at least that many lines.  Only
positions in an interval of two or more go on, so every round is smaller, and
the rounds end when no rank is shared.  A position leaves with the longest
power of two by which its suffix shares a prefix with an earlier one; a run of
any length is covered by two of these lengths, one from its start and one to
its end.  All but the first position of an interval are later copies; what they
cover makes up the maximal repeated runs, and is deleted.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutloom.llm.common import dropped, named, written

LAST = (1 << 63) - 1
POSITION = ["d", "h", "n"]


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` whose ``by`` occurs more than once, with its ``rank`` in sorted order and its ``first`` position.

    Names are combined before the shuffle, and joined back with a plain
    equi-join, so that a very frequent line is no single group anywhere.
    """
    names = rows.groupBy(*by).agg(F.count("*").alias("c"), F.min(F.struct(*POSITION)).alias("first")).filter("c > 1")
    ranks = written(names.select(*by, "first").orderBy(*by).withColumn("place", F.monotonically_increasing_id()))
    out = written(rows.join(ranks, by).select(*POSITION, "alone", F.col("place").alias("rank"), "first").distinct())
    dropped(ranks)
    return out


def _longer(rows: DataFrame, step: int) -> DataFrame:
    """Runs of ``rows`` made longer by the run that begins ``step`` lines later."""
    later = rows.select("d", "h", (F.col("n") - step).alias("n"), F.col("rank").alias("rank2"))
    return rows.join(later, POSITION).select(*POSITION, "alone", "rank", "rank2")


def repeated_lines(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_lines: int = 2, min_words: int = 4) -> DataFrame:
    """(d, h, gone): for every document with later copies the numbers of their lines, counted without blank ones."""
    body = F.coalesce(named(text), F.lit(""))
    rows = df.select(*_key(named(doc_id), body), F.posexplode(F.filter(F.split(body, "\n"), _filled)).alias("n", "line")).select(
        *POSITION,
        F.unhex(F.md5("line")).alias("line_id"),
        (F.length(F.btrim("line")) - F.length(F.replace(F.btrim("line"), F.lit(" "))) >= min_words - 1).alias("alone"),
    )
    runs = _ranked(rows, ["line_id"])
    later = F.struct(*POSITION) > F.col("first")
    # (position, lines that it shares with an earlier one)
    found = [runs.filter(later & (F.col("alone") | F.lit(min_lines == 1))).select(*POSITION, F.lit(1).alias("run"))]
    size, step = 1, min(1, max(0, min_lines - 1))
    while step:
        longer = _ranked(_longer(runs, step), ["rank", "rank2"])
        dropped(runs) if size > 1 else None
        runs, size = longer, size + step
        if size >= min_lines:
            found.append(written(runs.filter(later).select(*POSITION, F.lit(size).alias("run"))))
        if runs.isEmpty():
            break
        # The minimum is met exactly; from there on every round doubles.
        step = size if size >= min_lines else min(size, min_lines - size)
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    both = both.groupBy(*POSITION).agg(F.max("run").alias("run"))
    # Of every position the lines that none before it covers, so that a long run costs its length, not its square.
    end = F.col("n") + F.col("run")
    before = F.max(end).over(W.partitionBy("d", "h").orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    start = F.greatest("n", F.coalesce(before, F.col("n")))
    new = both.select("d", "h", start.alias("start"), end.alias("end")).filter(F.col("start") < F.col("end"))
    return new.select("d", "h", F.explode(F.sequence("start", F.col("end") - 1)).alias("n")).groupBy("d", "h").agg(F.collect_list("n").alias("gone"))


def _key(doc_id: Column, body: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("bigint"), F.lit(LAST)).alias("d"), F.xxhash64(body).alias("h")]


def named_in(struct: str, column: str) -> Column:
    return F.col(struct).getField(column)


def _filled(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) != ""


def dedup(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_lines: int = 2, min_words: int = 4) -> DataFrame:
    """``df`` with later copies of repeated line runs deleted from ``text``, and ``n_lines``, ``n_removed``, ``n_runs``.

    A line is deleted if it lies in a run of at least ``min_lines`` lines that
    also stands earlier, or if it has at least ``min_words`` words and stands
    earlier alone; earlier is by document id (null last), then by line, so the
    first copy always stays.  Blank lines have no ids and stay, unless nothing
    else is left, when the text becomes empty.  Rows with equal id and text are
    the same document.  Null texts stay null, with no lines; columns of the
    added names are replaced, others pass unchanged.
    """
    added = {"n_lines", "n_removed", "n_runs"}
    keep = [c for c in df.columns if c not in added]
    gone = repeated_lines(df, text=text, doc_id=doc_id, min_lines=min_lines, min_words=min_words)
    body = F.coalesce(named(text), F.lit(""))
    own = df.select(F.struct(*map(named, keep)).alias("row"), *_key(named(doc_id), body))
    joined = own.join(gone, ["d", "h"], "left").select("row", "gone")
    body = F.coalesce(named_in("row", text), F.lit(""))
    lines = F.split(body, "\n")
    numbers = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: _filled(F.get("lines", i)))
    cut = F.transform(F.sort_array("gone"), lambda i: F.get("numbers", i))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "cut"), lambda i: F.get("lines", i))
    some = F.col("gone").isNotNull()
    staged = joined.withColumn("lines", lines).withColumn("numbers", numbers)
    staged = staged.withColumn("cut", F.when(some, cut)).withColumn("left", F.when(some, left))
    new = F.when(~some, named_in("row", text)).when(F.size("gone") == F.size("numbers"), F.lit("")).otherwise(F.array_join("left", "\n"))
    runs = F.size(F.array_except("gone", F.transform("gone", lambda i: i + 1)))
    none = F.lit(0).cast("long")
    return staged.select(
        *[new.alias(c) if c == text else named_in("row", c).alias(c) for c in keep],
        F.size("numbers").cast("long").alias("n_lines"),
        F.when(some, F.size("gone").cast("long")).otherwise(none).alias("n_removed"),
        F.when(some, runs.cast("long")).otherwise(none).alias("n_runs"),
    )

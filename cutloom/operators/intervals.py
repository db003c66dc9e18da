"""Joins and windows over time intervals, the core of most operators.

Overlap joins never compare everything with everything: both sides are dealt to
time buckets of their key, joined on (key, bucket), and a pair is kept only in
the first bucket the two share.  Searches for a next or previous event are one
sorted union and a running value.

Spark's estimate of a table's size doesn't see what ``explode`` adds, so a side
that is dealt to buckets or a grid would be broadcast through the driver where
the table it comes from is small: such joins are asked to merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_MS = 10_000


def _buckets(start: Column, end: Column, size: int) -> Column:
    return F.sequence(F.floor(start / size), F.floor(F.greatest(start, end) / size))


def overlap_join(
    left: DataFrame, right: DataFrame, on: list[str], l_start: str, l_end: str, r_start: str, r_end: str, *, bucket_ms: int = BUCKET_MS, how: str = "inner", slack_ms: int = 0, by: str = "merge"
) -> DataFrame:
    """Pairs with equal ``on`` whose closed intervals, widened by ``slack_ms``, meet.

    Columns of the two sides must differ but for ``on``.  ``how`` is inner or
    left; left rows without a partner then have nulls.  Null bounds meet nothing.
    ``by`` is how the join is done: shuffle_hash, with a small right side, spares
    the sort of wide left rows.
    """
    l = left.withColumn("_lb", F.explode_outer(_buckets(F.col(l_start) - slack_ms, F.col(l_end) + slack_ms, bucket_ms)))
    r = right.withColumn("_rb", F.explode(_buckets(F.col(r_start), F.col(r_end), bucket_ms)))
    first = F.greatest(F.floor((F.col(l_start) - slack_ms) / bucket_ms), F.floor(F.col(r_start) / bucket_ms))
    meets = (F.col(l_start) - slack_ms <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end) + slack_ms)
    keyed = r.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in r.columns])
    cond = (F.col("_lb") == F.col("_rb")) & meets & (F.col("_lb") == first)
    for c in on:
        cond = (l[c] == keyed[f"_{c}"]) & cond
    pairs = l.join(keyed.hint(by), cond, "inner").drop("_lb", "_rb", *[f"_{c}" for c in on])
    if how == "inner":
        return pairs
    rest = left.join(pairs.select(*left.columns).distinct(), left.columns, "left_anti") if not on else _unmatched(left, pairs)
    return pairs.unionByName(rest, allowMissingColumns=True)


def _unmatched(left: DataFrame, pairs: DataFrame) -> DataFrame:
    found = pairs.select(*left.columns).distinct()
    cond = None
    for c in left.columns:
        same = left[c].eqNullSafe(found[c])
        cond = same if cond is None else cond & same
    return left.join(found, cond, "left_anti")


def neighbours(points: DataFrame, events: DataFrame, on: list[str], at: str, event: str, *, strict: bool = False) -> DataFrame:
    """``points`` with ``prev_ms`` and ``next_ms``: the last event at or before, and the first at or after, each point."""
    mine = points.withColumn("_t", F.col(at)).withColumn("_e", F.lit(None).cast("bigint"))
    theirs = events.select(*on, F.col(event).cast("bigint").alias("_t"), F.col(event).cast("bigint").alias("_e"))
    both = mine.withColumn("_mine", F.lit(True)).unionByName(theirs, allowMissingColumns=True)
    key = W.partitionBy(*on).orderBy("_t")
    up = key.rangeBetween(W.unboundedPreceding, -1 if strict else 0)
    down = key.rangeBetween(1 if strict else 0, W.unboundedFollowing)
    out = both.withColumns({"prev_ms": F.max("_e").over(up), "next_ms": F.min("_e").over(down)})
    return out.filter("_mine").drop("_t", "_e", "_mine")


def islands(df: DataFrame, by: list[str], start: str, end: str, gap_ms: int, *, inclusive: bool = True, order: list[str] | None = None) -> DataFrame:
    """``df`` with ``island``: rows of a key in time order stay together while the gap to the running end is small.

    A gap equal to ``gap_ms`` joins if ``inclusive``.  ``order`` defaults to the
    start, then the end.
    """
    w = W.partitionBy(*by).orderBy(*(order or [start, end]))
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col(start) - reach > gap_ms if inclusive else F.col(start) - reach >= gap_ms
    return df.withColumn("_new", F.when(reach.isNull() | apart, 1).otherwise(0)).withColumn("island", F.sum("_new").over(w)).drop("_new")


def merged(df: DataFrame, by: list[str], start: str, end: str, gap_ms: int, *, inclusive: bool = True) -> DataFrame:
    """Intervals of a key united where they overlap or stand within ``gap_ms``: by, start, end."""
    marked = islands(df, by, start, end, gap_ms, inclusive=inclusive)
    return marked.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def removed_before(points: DataFrame, holes: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """``points`` with ``removed_ms``: how much of disjoint ``holes`` lies before each point (ripple map).

    One sorted union: a hole begun counts by running sums of starts and ends.
    """
    mine = points.withColumn("_t", F.col(at)).withColumn("_mine", F.lit(True))
    opened = holes.select(*on, F.col(start).alias("_t"), F.col(start).alias("_s"), F.lit(1).alias("_n"))
    closed = holes.select(*on, F.col(end).alias("_t"), (-F.col(end)).alias("_s"), F.lit(-1).alias("_n"))
    both = mine.unionByName(opened.unionByName(closed), allowMissingColumns=True)
    w = W.partitionBy(*on).orderBy("_t").rangeBetween(W.unboundedPreceding, 0)
    # A hole left behind adds end - start, one still open t - start.
    lost = F.coalesce(F.sum("_n").over(w), F.lit(0)) * F.col("_t") - F.coalesce(F.sum("_s").over(w), F.lit(0))
    return both.withColumn("removed_ms", lost).filter("_mine").drop("_t", "_mine", "_s", "_n")


def subtract(items: DataFrame, holes: DataFrame, on: list[str], start: str, end: str, h_start: str, h_end: str) -> DataFrame:
    """What is left of ``items`` without disjoint ``holes``: one row per remaining part, with ``part_start`` and ``part_end``."""
    ids = items.columns
    hit = overlap_join(items, holes.select(*on, F.col(h_start).alias("_hs"), F.col(h_end).alias("_he")), on, start, end, "_hs", "_he", how="left")
    per = hit.groupBy(*ids).agg(F.sort_array(F.collect_list(F.when(F.col("_hs").isNotNull(), F.struct("_hs", "_he")))).alias("_h"))
    starts = F.concat(F.array(F.col(start)), F.transform("_h", lambda h: F.greatest(h["_he"], F.col(start))))
    ends = F.concat(F.transform("_h", lambda h: F.least(h["_hs"], F.col(end))), F.array(F.col(end)))
    parts = per.withColumn("_p", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))))
    return parts.select(*ids, F.col("_p.s").alias("part_start"), F.col("_p.e").alias("part_end")).filter("part_end > part_start")

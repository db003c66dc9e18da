"""Which units of a plan stay: lengths, fair shares and chapters that must not be missing.

What one unit's going or coming does depends on all that stay at that moment,
so a plan's units are one fold; a plan is as long as its recording's outline,
never a table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NUMBERS = r"(?i)\d|milion|tisíc|procent"
#: A selection that can't be shortened within its range may stay so much longer, in percent.
OVERRUN_PCT = 9
#: Units of this score are the first and the concluding ones, and go last.
KEY_SCORE = 4
#: How many of the units dropped in the first pass may come back.
SECOND_CHOICE = 12
SWAPS = 8

UNITS = ["plan_id", "unit", "dur_ms", "speaker", "topic", "chapter", "core", "score", "priority"]


class Selection:
    """A plan's units as arrays, and which of them are kept.

    Shares are compared as whole numbers: more than a fair share of n is
    mine / all > 1 / n + slack, in parts of a hundred.
    """

    def __init__(self, pdf: pd.DataFrame, *, by_speaker: bool, by_topic: bool, by_chapter: bool):
        code = lambda c: pd.factorize(pdf[c])[0]  # noqa: E731  missing is -1
        self.ms, self.unit = pdf.dur_ms.to_numpy("i8"), pdf.unit.to_numpy("i8")
        self.core, self.score, self.priority = pdf.core.to_numpy(bool), pdf.score.to_numpy("i8"), pdf.priority.to_numpy("i8")
        self.speaker, self.topic, self.chapter = code("speaker"), code("topic"), code("chapter")
        self.kept = pdf.kept.to_numpy(bool) if "kept" in pdf else np.ones(len(pdf), bool)
        self.speakers = len(set(self.speaker) - {-1})
        self.by_speaker = by_speaker and self.speakers >= 2
        self.by_topic, self.by_chapter = by_topic, by_chapter
        self.known_topics = set(self.topic) - {-1}  # those with material, in the plan or beside it

    def total(self) -> int:
        return int(self.ms[self.kept].sum())

    def _over(self, group: np.ndarray, of: np.ndarray, n: int, slack: int) -> np.ndarray:
        sums = np.zeros(group.max(initial=-1) + 2, "i8")
        np.add.at(sums, group[of] + 1, self.ms[of])
        return (group >= 0) & (sums[group + 1] * 100 * n > int(self.ms[of].sum()) * (100 + slack * n))

    def violations(self) -> np.ndarray:
        """For every unit: how many of the plan's shares its speaker, topic and chapter have too much of."""
        found = np.zeros(len(self.ms), int)
        if self.by_speaker:
            found += self._over(self.speaker, self.kept, self.speakers, 5)
        if self.by_topic and len(self.known_topics) >= 2:
            found += self._over(self.topic, self.kept & (self.topic >= 0), len(self.known_topics), 10)
        if self.by_chapter:
            n = np.bincount(self.chapter[self.kept] + 1, minlength=self.chapter.max(initial=-1) + 2)
            found += n[self.chapter + 1] - self.kept > 0
        return found

    def drop_order(self) -> np.ndarray:
        """Kept units, the first to go first."""
        bad = self.violations()
        order = np.lexsort([self.unit, self.ms, -self.priority, self.score, -bad, self.core])
        return order[self.kept[order]]

    def keep_order(self, units: np.ndarray) -> np.ndarray:
        bad = self.violations()[units]
        return units[np.lexsort([self.unit[units], self.priority[units], -self.score[units], bad, ~self.core[units]])]

    def trim(self, high: int, low: int) -> np.ndarray:
        """Drops units until the plan is no longer than ``high``, and returns them; one that would leave less than ``low`` is passed over."""
        out = []
        while (total := self.total()) > high and self.kept.sum() > 1:
            order = self.drop_order()
            free = order[self.score[order] < KEY_SCORE]
            order = free if free.size else order
            fits = order[total - self.ms[order] >= low]
            if not fits.size and total * 100 <= high * (100 + OVERRUN_PCT):
                break
            u = fits[0] if fits.size else order[np.abs(2 * (total - self.ms[order]) - high - low).argmin()]
            self.kept[u] = False
            out.append(u)
        return np.array(out, int)

    def refill(self, pool: np.ndarray, high: int, low: int) -> np.ndarray:
        """Takes units of the pool, the best first, while the plan is shorter than ``low`` and they fit; returns what is left of the pool."""
        total = self.total()
        for u in self.keep_order(pool):
            if total >= low:
                break
            if total + self.ms[u] <= high:
                self.kept[u] = True
                total += int(self.ms[u])
        return pool[~self.kept[pool]]

    def swap(self, pool: np.ndarray, high: int, low: int) -> np.ndarray:
        """Replaces units that have too much of a share by units of the pool that don't, while less of the plan violates; returns the pool."""
        excess = lambda: int(self.ms[self.kept & (self.violations() > 0)].sum())
        for _ in range(SWAPS):
            before, bad = excess(), np.flatnonzero(self.kept & (self.violations() > 0))
            for u in bad[np.lexsort([self.unit[bad], self.ms[bad], -self.priority[bad], self.core[bad]])]:
                if (found := self._replacement(u, pool, high, low, before)) is not None:
                    pool = np.append(pool[~np.isin(pool, found)], u)
                    break
            else:
                return pool
        return pool

    def _replacement(self, u: int, pool: np.ndarray, high: int, low: int, before: int) -> list[int] | None:
        """Units of the pool that take the place of ``u``, and now do; or None, and nothing is changed."""
        was = self.kept.copy()
        self.kept[u] = False
        present = set(self.topic[self.kept])  # units without a topic are a topic of their own here
        is_new = np.array([t not in present for t in self.topic[pool]], bool)
        allowed = (self.violations()[pool] == 0) & (self.core[pool] | ~self.core[u] | (is_new & (self.topic[pool] >= 0)))
        order = self.keep_order(pool[allowed])
        order = order[np.argsort(~np.isin(order, pool[is_new]), kind="stable")]
        total, taken = self.total(), []
        for c in order:
            if total + self.ms[c] <= high:
                taken.append(int(c))
                total += int(self.ms[c])
                if total >= low:
                    break
        self.kept[taken] = True
        if total >= low and int(self.ms[self.kept & (self.violations() > 0)].sum()) < before:
            return taken
        self.kept = was
        return None


def _per_plan(units: DataFrame, columns: list[str], run: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit", ignore_index=True)
        return pdf[["plan_id", "unit"]].assign(kept=run(pdf))

    return units.select(*columns).groupBy("plan_id").applyInPandas(fold, "plan_id bigint, unit bigint, kept boolean")


def fit_and_refill(
    units: DataFrame, target_ms: int, *, tolerance_pct: int = 3, by_speaker: bool = False, by_topic: bool = False, by_chapter: bool = False, swap: bool = False
) -> DataFrame:
    """(plan_id, unit, kept): units that make up the target within ``tolerance_pct``, as far as they can.

    ``units`` has plan_id, unit, dur_ms, speaker, topic, chapter, core, score (4:
    first or concluding), priority and off_topic.  A first pass shortens the plan
    to 1.5 to 1.6 times the target; units that are off topic go then; a second
    pass shortens it to the range; what it dropped, then the best
    :data:`SECOND_CHOICE` on topic of what the first pass dropped, come back
    while the plan is too short and they fit.  What goes first: not core, of a
    speaker, topic or chapter with more than its fair share (speakers 5, topics
    10 points more, chapters one unit), of a lower score, a higher priority number,
    shorter, earlier.  With ``swap`` units with too much of a share are replaced,
    at last, by those of the pool without.
    """
    high, low = target_ms * (100 + tolerance_pct) // 100, -(-target_ms * (100 - tolerance_pct) // 100)

    def run(pdf: pd.DataFrame) -> np.ndarray:
        s = Selection(pdf, by_speaker=by_speaker, by_topic=by_topic, by_chapter=by_chapter)
        off = pdf.off_topic.to_numpy(bool)
        early = s.trim(target_ms * 16 // 10, target_ms * 15 // 10)
        s.kept &= ~off
        pool = s.refill(s.trim(high, low), high, low)
        if s.total() < low and early.size:
            second = s.keep_order(early)[:SECOND_CHOICE]
            pool = np.append(pool, s.refill(second[~off[second]], high, low))
        if swap:
            s.swap(pool, high, low)
        return s.kept

    return _per_plan(units, [*UNITS, "off_topic"], run)


def balanced(units: DataFrame, target_ms: int, *, tolerance_pct: int = 3, by_speaker: bool = True, by_topic: bool = True, by_chapter: bool = False) -> DataFrame:
    """(plan_id, unit, kept): a plan whose shares are nearer to fair ones, by swaps with the units beside it.

    ``units`` has the columns of :func:`fit_and_refill` without off_topic, and
    ``kept``: in the plan, else in the pool.  A swap takes one unit out and as
    many in as fill the range again; it stands only if the units with too much
    of a share get less of the plan's time, at most :data:`SWAPS` times.  A core
    unit gives way to core units, or to a topic that the plan has nothing of.
    """
    high, low = target_ms * (100 + tolerance_pct) // 100, -(-target_ms * (100 - tolerance_pct) // 100)

    def run(pdf: pd.DataFrame) -> np.ndarray:
        s = Selection(pdf, by_speaker=by_speaker, by_topic=by_topic, by_chapter=by_chapter)
        s.swap(np.flatnonzero(~s.kept), high, low)
        return s.kept

    return _per_plan(units, [*UNITS, "kept"], run)


def has_number(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMBERS), F.lit(False))


def with_mandatory(units: DataFrame, chapters: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, unit, kept, score): a selection that misses no key chapter.

    ``units`` (plan_id, unit, chapter, dur_ms, host, number, picked, score),
    ``chapters`` (plan_id, chapter, concluding) and ``plans`` (plan_id,
    target_ms, trailer).  If nothing picked is from a concluding chapter, units
    of these are added from the end while they fit a fifth of the target, but
    not for a trailer.  For each other key chapter that is missing one unit of
    at most a fifth of the target comes in, none of the host's: the first with a
    number, else the longest.  A selection that reaches half the target stands:
    its first unit and its last concluding one (or its last) get score 4, others
    3; else all units are kept as they are, as where nothing is picked.
    """
    p = W.partitionBy("plan_id")
    x = units.join(chapters.select("plan_id", "chapter", F.col("concluding").alias("_end"), F.lit(True).alias("_key")), ["plan_id", "chapter"], "left")
    x = x.join(plans, "plan_id").withColumns({"_end": F.coalesce("_end", F.lit(False)), "_key": F.coalesce("_key", F.lit(False))})
    x = x.withColumn("_any", F.max("picked").over(p)).withColumn("_ended", F.max(F.col("picked") & F.col("_end")).over(p))
    # From the end while the rest of the budget holds the unit: one running value over a plan's concluding units.
    ends = x.filter("_end and _any and not _ended and not trailer").groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("unit", "dur_ms")), asc=False).alias("u"), F.first("target_ms").alias("t"))

    def one(acc: Column, u: Column) -> Column:
        fits = u["dur_ms"] <= acc["left"]
        return F.struct(F.when(fits, acc["left"] - u["dur_ms"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["units"], F.array(u["unit"]))).otherwise(acc["units"]).alias("units"))

    start = F.struct(F.floor(F.col("t") / 5).cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("units"))
    ends = ends.select("plan_id", F.explode(F.aggregate("u", start, one)["units"]).alias("unit"), F.lit(True).alias("_added"))
    x = x.join(ends, ["plan_id", "unit"], "left")
    of = W.partitionBy("plan_id", "chapter")
    may = F.col("_key") & ~F.col("_end") & F.col("_any") & ~F.max("picked").over(of) & ~F.col("host") & (F.col("dur_ms") * 5 <= F.col("target_ms"))
    x = x.withColumn("_may", may)
    place = F.row_number().over(of.orderBy(F.desc("_may"), F.desc("number"), F.when(F.col("number"), F.lit(0)).otherwise(-F.col("dur_ms")), "unit"))
    x = x.withColumn("_sel", F.col("picked") | F.coalesce("_added", F.lit(False)) | (F.col("_may") & (place == 1)))
    x = x.withColumn("_ok", F.col("_any") & (F.sum(F.when(F.col("_sel"), F.col("dur_ms")).otherwise(0)).over(p) * 2 >= F.col("target_ms")))
    first = F.min(F.when(F.col("_sel"), F.col("unit"))).over(p)
    last = F.coalesce(F.max(F.when(F.col("_sel") & F.col("_end"), F.col("unit"))).over(p), F.max(F.when(F.col("_sel"), F.col("unit"))).over(p))
    score = F.when(F.col("unit").isin(first, last), KEY_SCORE).otherwise(3)
    return x.select("plan_id", "unit", (F.col("_sel") | ~F.col("_ok")).alias("kept"), F.when(F.col("_ok"), score).otherwise(F.col("score")).cast("int").alias("score"))

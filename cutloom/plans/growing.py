"""Queries of units that grow and shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutloom.operators import growth
from cutloom.plans.registry import Tables, query

# Sentences with the marks that texts of the archive have, here by their numbers; runs of chosen sentences are units.
MARKS = """, sm AS (SELECT media_id, seg_id, start_ms, end_ms, text, speaker, (seg_id + media_id) % 4 = 2 AS goes_on, (seg_id * 3 + media_id) % 5 = 1 AS points_back, (seg_id + media_id) % 4 = 2 AND media_id % 3 > 0 AS low,
  seg_id % 6 = 5 AS filler, speaker = 'system' AS excluded, (seg_id + media_id) % 3 = 0 AS dependent, seg_id % 7 = 6 AS off_topic FROM segments),
pu AS (SELECT plan_id, media_id, seg_id, CAST(sum(n) OVER (PARTITION BY plan_id ORDER BY seg_id) AS BIGINT) AS unit FROM (
  SELECT *, CASE WHEN seg_id = lag(seg_id) OVER (PARTITION BY plan_id ORDER BY seg_id) + 1 AND seg_id % 4 > 0 THEN 0 ELSE 1 END AS n FROM picks WHERE (seg_id + media_id) % 5 <> 3)),
g0 AS (SELECT s.*, p.plan_id, u.unit FROM sm s JOIN (SELECT DISTINCT plan_id, media_id FROM pu) p USING (media_id) LEFT JOIN pu u ON u.plan_id = p.plan_id AND u.media_id = s.media_id AND u.seg_id = s.seg_id)
"""


def marks(t: Tables) -> DataFrame:
    i, m = F.col("seg_id"), F.col("media_id")
    on = (i + m) % 4 == 2
    return t.segments.select(
        "media_id", "seg_id", "start_ms", "end_ms", "text", "speaker", on.alias("goes_on"), ((i * 3 + m) % 5 == 1).alias("points_back"), (on & (m % 3 > 0)).alias("low"),
        (i % 6 == 5).alias("filler"), (F.col("speaker") == "system").alias("excluded"), ((i + m) % 3 == 0).alias("dependent"), (i % 7 == 6).alias("off_topic"),
        ((i * 7 + m) % 5 < 2).alias("pause"), (i % 9 == 4).alias("trails"),
    )


def plan_units(t: Tables) -> DataFrame:
    w = W.partitionBy("plan_id").orderBy("seg_id")
    p = t.picks.filter("(seg_id + media_id) % 5 <> 3")
    goes_on = (F.col("seg_id") == F.lag("seg_id").over(w) + 1) & (F.col("seg_id") % 4 > 0)
    return p.withColumn("_n", F.when(goes_on, 0).otherwise(1)).select("plan_id", "media_id", "seg_id", F.sum("_n").over(w).alias("unit"))


def _grown(source: str, name: str) -> str:
    near = "n.start_ms - s.end_ms < 2500 AND s.end_ms - s.start_ms < 9000 AND NOT s.filler"
    return f""", {name} AS (SELECT s.* EXCLUDE (unit), coalesce(s.unit, CASE WHEN p.speaker = s.speaker AND s.low THEN p.unit END,
  CASE WHEN NOT s.excluded AND (n.goes_on OR (n.points_back AND n.speaker = s.speaker AND {near})) THEN n.unit END) AS unit FROM {source} s
  LEFT JOIN {source} p ON p.plan_id = s.plan_id AND p.media_id = s.media_id AND p.seg_id = s.seg_id - 1 LEFT JOIN {source} n ON n.plan_id = s.plan_id AND n.media_id = s.media_id AND n.seg_id = s.seg_id + 1)"""


CONTEXT = MARKS + "".join(_grown(f"g{k}", f"g{k + 1}") for k in range(4)) + """
SELECT g4.plan_id, g4.media_id, g4.seg_id, g4.unit, g0.unit IS NULL AS added FROM g4 JOIN g0 USING (plan_id, media_id, seg_id) WHERE g4.unit IS NOT NULL"""  # fmt: skip


@query("p06_attached_context", CONTEXT)
def p06(t: Tables) -> DataFrame:
    return growth.attach_context(plan_units(t), marks(t))


# A chain is walked from every unit's first sentence; merged units take the name that the walk over them ends with.
DEPENDENT = MARKS + """, fi AS (SELECT plan_id, media_id, unit, min(seg_id) AS f FROM pu GROUP BY ALL),
wa AS (SELECT f.plan_id, f.media_id, f.unit, f.f, p.unit AS pv FROM fi f JOIN g0 s ON s.plan_id = f.plan_id AND s.media_id = f.media_id AND s.seg_id = f.f
  JOIN g0 p ON p.plan_id = f.plan_id AND p.media_id = f.media_id AND p.seg_id = f.f - 1 WHERE s.dependent AND NOT s.off_topic AND p.speaker = s.speaker AND NOT p.excluded)
SELECT * FROM (WITH RECURSIVE front AS (
  SELECT plan_id, media_id, unit, f - 1 AS seg_id, 0 AS k FROM wa WHERE pv IS NULL
  UNION ALL SELECT r.plan_id, r.media_id, r.unit, p.seg_id, r.k + 1 FROM front r JOIN g0 h ON h.plan_id = r.plan_id AND h.media_id = r.media_id AND h.seg_id = r.seg_id
    JOIN g0 p ON p.plan_id = r.plan_id AND p.media_id = r.media_id AND p.seg_id = r.seg_id - 1 WHERE r.k < 3 AND h.goes_on AND p.unit IS NULL AND NOT p.excluded
), named AS (
  SELECT plan_id, media_id, unit, unit AS root FROM fi
  UNION ALL SELECT n.plan_id, n.media_id, n.unit, w.pv FROM named n JOIN wa w ON w.plan_id = n.plan_id AND w.media_id = n.media_id AND w.unit = n.root WHERE w.pv IS NOT NULL
), roots AS (SELECT plan_id, media_id, unit, min(root) AS root FROM named GROUP BY ALL),
held AS (SELECT plan_id, media_id, seg_id, unit, false AS added FROM pu UNION ALL SELECT plan_id, media_id, seg_id, unit, true FROM front)
SELECT h.plan_id, h.media_id, h.seg_id, r.root AS unit, h.added FROM held h JOIN roots r USING (plan_id, media_id, unit))"""  # fmt: skip


@query("p14_dependent_units", DEPENDENT)
def p14(t: Tables) -> DataFrame:
    return growth.join_dependent(plan_units(t), marks(t))


def plan_budgets(t: Tables) -> DataFrame:
    """Seconds by plan; every fourth plan has no budget."""
    p = t.picks.select("plan_id").distinct().filter("plan_id % 4 > 0")
    return p.select("plan_id", (F.col("plan_id") % 9 * 4000).alias("budget_ms"))


@query("p09_snapped_to_pauses")
def p09(t: Tables) -> DataFrame:
    return growth.snap_to_pauses(plan_units(t), marks(t), plan_budgets(t))

"""Queries of plans within their length, their shares and their chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.operators import balance
from cutloom.plans.registry import Tables, query

TARGET = 60_000


def plan_units(t: Tables) -> DataFrame:
    """Four recordings' sentences as one plan's units, with what an outline says of them."""
    m, i = F.col("media_id"), F.col("seg_id")
    unit = (m % 4) * 1000 + i
    return t.segments.select(
        F.floor(m / 4).alias("plan_id"), unit.alias("unit"), (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"),
        F.when((i + m) % 7 == 0, F.lit(None)).otherwise(F.col("speaker")).alias("speaker"),
        F.when((i * 5 + m) % 3 > 0, F.concat(F.lit("t"), (i * 5 + m) % 3)).alias("topic"),
        (m % 4 * 3 + F.floor(i / 3)).alias("chapter"), ((i + m) % 4 > 0).alias("core"), (2 + F.when((i * 3 + m) % 11 == 0, 2).otherwise((i + m) % 2)).alias("score"),
        (1 + F.col("n_words") % 3).alias("priority"), ((i * 7 + m) % 9 == 4).alias("off_topic"), ((i * 11 + m) % 5 < 2).alias("kept"), balance.has_number(F.col("text")).alias("number"),
    )


@query("p07_refilled_plan")
def p07(t: Tables) -> DataFrame:
    return balance.fit_and_refill(plan_units(t).drop("kept"), TARGET, by_speaker=True, by_topic=True)


@query("p08_balanced_plan")
def p08(t: Tables) -> DataFrame:
    return balance.balanced(plan_units(t), TARGET)


# What comes from the end is a walk over a plan's concluding units.
MANDATORY = """, ma AS (SELECT media_id // 4 AS plan_id, media_id % 4 * 1000 + seg_id AS unit, end_ms - start_ms AS dur_ms, media_id % 4 * 3 + seg_id // 3 AS chapter, 2 + CASE WHEN (seg_id * 3 + media_id) % 11 = 0 THEN 2 ELSE (seg_id + media_id) % 2 END AS score,
  regexp_matches(text, '(?i)\\d|milion|tisíc|procent') OR seg_id % 5 = 4 AS number, coalesce(speaker = 'system', false) AS host, (seg_id * 11 + media_id) % 5 = 0 AND media_id % 8 <> 5 AS picked FROM segments),
mk AS (SELECT *, chapter % 3 <> 1 AS is_key, chapter % 3 = 2 AND chapter > 5 AS is_end, plan_id % 5 = 3 AS trailer, 30000 + plan_id % 3 * 40000 AS target FROM ma),
mp AS (SELECT *, bool_or(picked) OVER p AS any_, bool_or(picked AND is_key AND is_end) OVER p AS ended, bool_or(picked) OVER (PARTITION BY plan_id, chapter) AS here FROM mk WINDOW p AS (PARTITION BY plan_id)),
me AS (SELECT plan_id, unit, dur_ms, target // 5 AS budget, row_number() OVER (PARTITION BY plan_id ORDER BY unit DESC) AS k FROM mp WHERE is_key AND is_end AND any_ AND NOT ended AND NOT trailer),
mo AS (SELECT plan_id, unit FROM (SELECT plan_id, unit, row_number() OVER (PARTITION BY plan_id, chapter ORDER BY NOT number, CASE WHEN number THEN 0 ELSE -dur_ms END, unit) AS k FROM mp
  WHERE is_key AND NOT is_end AND any_ AND NOT here AND NOT host AND dur_ms * 5 <= target) WHERE k = 1)
SELECT * FROM (WITH RECURSIVE walk AS (
  SELECT plan_id, k, unit, dur_ms <= budget AS added, CAST(CASE WHEN dur_ms <= budget THEN budget - dur_ms ELSE budget END AS BIGINT) AS left_ms FROM me WHERE k = 1
  UNION ALL SELECT m.plan_id, m.k, m.unit, m.dur_ms <= w.left_ms, CASE WHEN m.dur_ms <= w.left_ms THEN w.left_ms - m.dur_ms ELSE w.left_ms END FROM walk w JOIN me m ON m.plan_id = w.plan_id AND m.k = w.k + 1
), sel AS (
  SELECT mp.*, picked OR coalesce(added, false) OR mo.unit IS NOT NULL AS sel FROM mp LEFT JOIN walk w ON w.plan_id = mp.plan_id AND w.unit = mp.unit LEFT JOIN mo ON mo.plan_id = mp.plan_id AND mo.unit = mp.unit
), ok AS (
  SELECT *, any_ AND 2 * sum(CASE WHEN sel THEN dur_ms ELSE 0 END) OVER p >= target AS ok, min(unit) FILTER (WHERE sel) OVER p AS f, coalesce(max(unit) FILTER (WHERE sel AND is_key AND is_end) OVER p, max(unit) FILTER (WHERE sel) OVER p) AS l FROM sel WINDOW p AS (PARTITION BY plan_id)
) SELECT plan_id, unit, sel OR NOT ok AS kept, CAST(CASE WHEN NOT ok THEN score WHEN unit IN (f, l) THEN 4 ELSE 3 END AS INTEGER) AS score FROM ok)"""  # fmt: skip


@query("p13_mandatory_chapters", MANDATORY)
def p13(t: Tables) -> DataFrame:
    m, i = F.col("media_id"), F.col("seg_id")
    s = t.segments.select(
        F.floor(m / 4).alias("plan_id"), (m % 4 * 1000 + i).alias("unit"), (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"), (m % 4 * 3 + F.floor(i / 3)).alias("chapter"),
        (2 + F.when((i * 3 + m) % 11 == 0, 2).otherwise((i + m) % 2)).alias("score"), (balance.has_number(F.col("text")) | (i % 5 == 4)).alias("number"),
        F.coalesce(F.col("speaker") == "system", F.lit(False)).alias("host"), (((i * 11 + m) % 5 == 0) & (m % 8 != 5)).alias("picked"),
    )
    keys = s.filter("chapter % 3 <> 1").select("plan_id", "chapter").distinct().withColumn("concluding", (F.col("chapter") % 3 == 2) & (F.col("chapter") > 5))
    plans = s.select("plan_id").distinct().select("plan_id", (30000 + F.col("plan_id") % 3 * 40000).alias("target_ms"), (F.col("plan_id") % 5 == 3).alias("trailer"))
    return balance.with_mandatory(s, keys, plans)

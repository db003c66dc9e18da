"""Queries of teasers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutloom.operators import audio, teasers
from cutloom.plans.media import PAIRS, SILENCE, frames
from cutloom.plans.registry import Tables, query

UNITS = r""", tu0 AS (SELECT *, regexp_matches(w, '[.!?]$') AND NOT regexp_matches(w, '(\.\.\.|…)$') AS stop FROM words),
tu1 AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY media_id, seg_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM tu0),
tu2 AS (SELECT media_id, seg_id, min(pos) AS w0, max(pos) AS w1, min(s_ms) AS s_ms, max(e_ms) AS e_ms, string_agg(w, ' ' ORDER BY pos) AS text, min(spk) AS speaker, bool_or(stop) AS closed FROM tu1 GROUP BY media_id, seg_id, piece),
tu AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_id, w0) - 1 AS n, seg_id, w0, w1, s_ms, e_ms, text, speaker, closed, count(*) OVER (PARTITION BY media_id, seg_id) = 1 AS "full" FROM tu2)
"""
BORDERS = ", pp AS (SELECT media_id, n AS pair_no, e_ms AS a_ms, nx AS b_ms FROM (SELECT *, lead(s_ms) OVER (PARTITION BY media_id ORDER BY n) AS nx FROM tu) WHERE nx IS NOT NULL)"


@query("p02_teaser_units", UNITS + "SELECT * FROM tu")
def p02_units(t: Tables) -> DataFrame:
    return teasers.units(t.words)


def _candidates(most: int, pause: str, edge: str) -> str:
    return rf""", tp AS (SELECT tu.*, {pause} AS pause, {edge} AS edge, tu.speaker = 'system' AS out, seg_id % 13 = 5 AS avoid FROM tu{" LEFT JOIN silence s ON s.media_id = tu.media_id AND s.pair_no = tu.n" if "silence" in pause else ""}),
tc AS (SELECT a.*, NOT a.out AND NOT a.avoid AND regexp_matches(a.text, '^\P{{Ll}}') AND NOT regexp_matches(a.text, '{teasers.ANSWERS}') AND NOT regexp_matches(lower(a.text), '{teasers.OPENERS}') AND coalesce(b.pause, true) AS starts,
  a.closed AND a.pause AND NOT coalesce(c.speaker IS NOT DISTINCT FROM a.speaker AND regexp_matches(c.text, '^\p{{Ll}}'), false) AS ends, coalesce(b.edge, 500) AS edge0
  FROM tp a LEFT JOIN tp b ON b.media_id = a.media_id AND b.n = a.n - 1 LEFT JOIN tp c ON c.media_id = a.media_id AND c.n = a.n + 1)
SELECT media_id, n, last_n, dur_ms, edge_ms, text, coalesce((SELECT string_agg(x.text, ' ' ORDER BY x.n) FROM tu x WHERE x.media_id = r.media_id AND x.n BETWEEN r.n - 2 AND r.n - 1), '') AS before,
  coalesce((SELECT string_agg(x.text, ' ' ORDER BY x.n) FROM tu x WHERE x.media_id = r.media_id AND x.n BETWEEN last_n + 1 AND last_n + 2), '') AS after, speaker FROM (
  SELECT a.media_id, a.n, z.n AS last_n, z.e_ms - a.s_ms AS dur_ms, least(a.edge0, z.edge) AS edge_ms, string_agg(m.text, ' ' ORDER BY m.n) AS text, a.speaker FROM tc a
  JOIN tc z ON z.media_id = a.media_id AND z.n BETWEEN a.n AND a.n + {most - 1} JOIN tc m ON m.media_id = a.media_id AND m.n BETWEEN a.n AND z.n
  WHERE a.starts AND z.ends AND z.e_ms - a.s_ms BETWEEN 1200 AND CASE WHEN z.n = a.n THEN 8000 ELSE 9000 END
  GROUP BY a.media_id, a.n, z.n, z.e_ms, a.s_ms, a.edge0, z.edge, a.speaker HAVING bool_and(m.speaker IS NOT DISTINCT FROM a.speaker AND NOT m.avoid)) r"""


GAP = "coalesce(lead(s_ms) OVER (PARTITION BY media_id ORDER BY n) - e_ms >= 120, true)"
LAST = "lead(tu.n) OVER (PARTITION BY tu.media_id ORDER BY tu.n) IS NULL"


def _marks() -> dict:
    return {"excluded": F.col("speaker") == "system", "avoid": F.col("seg_id") % 13 == 5}


@query("p02_teaser_candidates", UNITS + _candidates(6, GAP, "500::BIGINT"))
def p02(t: Tables) -> DataFrame:
    return teasers.candidates(teasers.units(t.words), most_units=6, **_marks())


@query("p02_measured_candidates", SILENCE.replace(PAIRS, UNITS + BORDERS) + _candidates(2, f"{LAST} OR coalesce(silence_ms, 0) >= 70", f"CAST(CASE WHEN {LAST} THEN 500 ELSE coalesce(silence_ms, 0) END AS BIGINT)"))
def p02_measured(t: Tables) -> DataFrame:
    u = teasers.units(t.words)
    return teasers.candidates(u, audio.pauses(teasers.borders(u), frames(t), 50), **_marks())


# Sentences as candidates of a plan, some of two sentences, with points by their numbers.
RATED = """, ra AS (SELECT media_id // 4 AS plan_id, media_id % 4 * 100 + seg_id AS n, media_id % 4 * 100 + seg_id + (seg_id + media_id) % 2 AS last_n, 60 + (seg_id * 37 + media_id) % 200 AS edge_ms,
  (seg_id * 5 + media_id) % 4 AS hook, (n_words + media_id) % 4 AS alone, n_words % 4 AS force, end_ms - start_ms AS dur_ms FROM segments)
"""


def rated(t: Tables) -> DataFrame:
    m, i = F.col("media_id"), F.col("seg_id")
    n = m % 4 * 100 + i
    return t.segments.select(
        F.floor(m / 4).alias("plan_id"), n.alias("n"), (n + (i + m) % 2).alias("last_n"), (60 + (i * 37 + m) % 200).alias("edge_ms"), ((i * 5 + m) % 4).alias("hook"),
        ((F.col("n_words") + m) % 4).alias("alone"), (F.col("n_words") % 4).alias("force"), (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"),
    )


@query("k03_ranked_teasers", RATED + """, rs AS (SELECT plan_id, n, last_n, CAST(30 * hook + 20 * alone + 15 * force - CASE WHEN edge_ms < 150 THEN 15 ELSE 0 END AS BIGINT) AS score10 FROM ra),
rk AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY score10 DESC, n, last_n) AS k FROM rs)
SELECT * FROM (WITH RECURSIVE g AS (
  SELECT plan_id, k, n, last_n, score10, true AS taken, 1 AS rank, range(n, last_n + 1) AS used FROM rk WHERE k = 1
  UNION ALL SELECT plan_id, k, n, last_n, score10, free, rank + free::INT, CASE WHEN free THEN list_concat(used, range(n, last_n + 1)) ELSE used END FROM (
    SELECT r.*, g.rank, g.used, g.rank < 12 AND NOT list_has_any(g.used, range(r.n, r.last_n + 1)) AS free FROM g JOIN rk r ON r.plan_id = g.plan_id AND r.k = g.k + 1)
) SELECT plan_id, n, last_n, score10, rank FROM g WHERE taken)""")  # fmt: skip
def k03(t: Tables) -> DataFrame:
    return teasers.ranked(rated(t))


# A teaser is a list that grows and shrinks by one step of the recursion at a time.
ASSEMBLED = """, an AS (SELECT plan_id, n AS cand, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY 30 * hook + 20 * alone + 15 * force DESC, n) AS INTEGER) AS rank, dur_ms,
  CASE WHEN plan_id % 5 > 0 AND (n * 7 + plan_id) % 4 = 0 THEN (n * 13) % 50 END AS place, 15000 + plan_id % 4 * 9000 AS target FROM ra),
al AS (SELECT plan_id, target, list({'rank': rank, 'cand': cand, 'ms': dur_ms} ORDER BY rank) AS every, list({'rank': rank, 'cand': cand, 'ms': dur_ms} ORDER BY place, rank) FILTER (WHERE place IS NOT NULL) AS own FROM an GROUP BY ALL)
SELECT * FROM (WITH RECURSIVE cut AS (
  SELECT plan_id, target, every, coalesce(own, every[1:2]) AS own, 0 AS k FROM al
  UNION ALL SELECT plan_id, target, every, list_concat(own[1:i], own[i + 2:]), k + 1 FROM (
    SELECT *, list_position(list_transform(own[2:len(own) - 1], lambda x: x.ms), list_max(list_transform(own[2:len(own) - 1], lambda x: x.ms))) AS i FROM cut WHERE len(own) > 2 AND 10 * list_sum(list_transform(own, lambda x: x.ms)) > 12 * target)
), short AS (SELECT plan_id, target, every, arg_max(own, k) AS own FROM cut GROUP BY plan_id, target, every),
grow AS (
  SELECT plan_id, target, every, own, 1 AS k FROM short
  UNION ALL SELECT plan_id, target, every, CASE WHEN 100 * list_sum(list_transform(own, lambda x: x.ms)) < 85 * target AND NOT list_contains(list_transform(own, lambda x: x.cand), every[k].cand)
      AND 100 * (list_sum(list_transform(own, lambda x: x.ms)) + every[k].ms) <= 115 * target THEN list_concat(list_append(own[1:greatest(1, len(own) - 1)], every[k]), own[greatest(1, len(own) - 1) + 1:]) ELSE own END, k + 1
    FROM grow WHERE k <= len(every)
), done AS (SELECT plan_id, every, own FROM grow WHERE k = len(every) + 1)
SELECT plan_id, unnest(own).cand AS cand, CAST(unnest(range(1, len(own) + 1)) AS INTEGER) AS place, CAST(NULL AS INTEGER) AS spare FROM done
UNION ALL SELECT plan_id, cand, NULL, CAST(s AS INTEGER) FROM (SELECT plan_id, unnest(l).cand AS cand, unnest(range(1, len(l) + 1)) AS s FROM (SELECT plan_id, list_filter(every, lambda x: NOT list_contains(list_transform(own, lambda y: y.cand), x.cand))[1:6] AS l FROM done)))"""


def statements(t: Tables) -> DataFrame:
    r, n, p = rated(t), F.col("n"), F.col("plan_id")
    rank = F.row_number().over(W.partitionBy("plan_id").orderBy(F.desc(30 * F.col("hook") + 20 * F.col("alone") + 15 * F.col("force")), "n"))
    return r.select("plan_id", n.alias("cand"), rank.alias("rank"), F.when((p % 5 > 0) & ((n * 7 + p) % 4 == 0), (n * 13) % 50).alias("place"), "dur_ms")


def targets(t: Tables) -> DataFrame:
    return rated(t).select("plan_id").distinct().select("plan_id", (15000 + F.col("plan_id") % 4 * 9000).alias("target_ms"))


@query("p10_assembled_teaser", RATED + ASSEMBLED)
def p10(t: Tables) -> DataFrame:
    return teasers.assembled(statements(t), targets(t))


REPAIRED = """, tr AS (SELECT plan_id, n, [n, n + 1000] AS ids, dur_ms, (n * 7 + plan_id) % 4 AS kind, (n * 11 + plan_id) % 6 = 1 AS is_bad, (n * 5 + plan_id) % 3 > 0 AS clean, CASE WHEN plan_id % 7 <> 3 THEN 12000 + plan_id % 4 * 14000 END AS target FROM ra),
ta AS (SELECT plan_id, target, list({'ord': n, 'ids': ids, 'ms': dur_ms} ORDER BY n) FILTER (WHERE kind < 2) AS ranges, coalesce(list(n) FILTER (WHERE is_bad), []) AS bad,
  coalesce(list({'ord': n, 'ids': CASE WHEN n % 5 = 0 THEN [n, n - 1] ELSE ids END, 'ms': dur_ms, 'built': dur_ms + 230} ORDER BY n) FILTER (WHERE kind > 1 AND clean), []) AS spares FROM tr GROUP BY ALL),
tk AS (SELECT *, list_filter(ranges, lambda r: NOT list_has_any(r.ids, bad)) AS kept FROM ta WHERE ranges IS NOT NULL),
td AS (SELECT *, len(kept) < len(ranges) AND len(kept) >= 2 AND (target IS NULL OR 10 * list_sum(list_transform(kept, lambda r: r.ms)) >= 6 * target) AS drops FROM tk),
te AS (SELECT *, CASE WHEN drops THEN kept ELSE ranges END AS own FROM td)
SELECT * FROM (WITH RECURSIVE f AS (
  SELECT plan_id, target, bad, spares, own, drops, CAST(list_sum(list_transform(own, lambda r: r.ms)) AS BIGINT) AS total, flatten(list_transform(own, lambda r: r.ids)) AS used, [{'ids': [0::BIGINT], 'ms': 0::BIGINT, 'spare': 0::BIGINT}][2:] AS more, 1 AS k FROM te
  UNION ALL SELECT plan_id, target, bad, spares, own, drops, CASE WHEN fits THEN total + s.built ELSE total END, CASE WHEN fits THEN list_concat(used, s.ids) ELSE used END,
    CASE WHEN fits THEN list_append(more, {'ids': s.ids, 'ms': s.built, 'spare': s.ord}) ELSE more END, k + 1 FROM (
    SELECT *, spares[k] AS s, drops AND coalesce(100 * total < 85 * target AND 100 * (total + spares[k].ms) <= 115 * target, false) AND NOT list_has_any(spares[k].ids, bad) AND NOT list_has_any(spares[k].ids, used) AS fits FROM f WHERE k <= len(spares))
), o AS (SELECT plan_id, list_concat(list_concat(list_transform(own[1:len(own) - 1], lambda r: {'ids': r.ids, 'ms': r.ms, 'spare': NULL::BIGINT}), more), list_transform(own[len(own):], lambda r: {'ids': r.ids, 'ms': r.ms, 'spare': NULL::BIGINT})) AS x FROM f WHERE k = len(spares) + 1)
SELECT plan_id, CAST(i AS INTEGER) AS place, x.ids AS ids, x.ms AS dur_ms, x.spare AS spare FROM (SELECT plan_id, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS i FROM o))"""  # fmt: skip


@query("p11_repaired_teaser", RATED + REPAIRED)
def p11(t: Tables) -> DataFrame:
    r, n, p = rated(t), F.col("n"), F.col("plan_id")
    ids = F.array(n, n + 1000)
    x = r.select("plan_id", "n", "dur_ms", ids.alias("ids"), ((n * 7 + p) % 4).alias("kind"), ((n * 11 + p) % 6 == 1).alias("is_bad"), ((n * 5 + p) % 3 > 0).alias("clean"))
    ranges = x.filter("kind < 2").select("plan_id", n.alias("ord"), "ids", "dur_ms")
    spare_ids = F.when(n % 5 == 0, F.array(n, n - 1)).otherwise(F.col("ids"))
    spares = x.filter("kind > 1").select("plan_id", n.alias("ord"), spare_ids.alias("ids"), "dur_ms", (F.col("dur_ms") + 230).alias("range_ms"), "clean")
    goals = r.select("plan_id").distinct().select("plan_id", F.when(p % 7 != 3, 12000 + p % 4 * 14000).alias("target_ms"))
    return teasers.repaired(ranges, x.filter("is_bad").select("plan_id", n.alias("seg_id")), spares, goals)

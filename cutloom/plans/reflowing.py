"""Queries of texts cut into cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutloom.operators import reflow
from cutloom.plans.registry import Tables, query

LIMIT = 40
# What lone words and stops are, for the SQL.
_LONE = r"regexp_matches({0}, '^(\p{{L}}|\d+\.)$')"
_STOPS = r"""(regexp_matches({0}, '[,;:.!?…]["“”»]?$') AND NOT regexp_matches({0}, '^\d+\.$'))"""
# Borders as lengths before every word; a step of the recursion adds one cue to every text.
REFLOW = rf""", rt AS (SELECT media_id, seg_id, text, length(text) AS size, string_split(text, ' ') AS ws FROM segments),
ra AS (SELECT *, len(ws) AS n_words, list_transform(range(len(ws) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(ws[1:i], ' ')) + 1 END) AS pre FROM rt)
SELECT * FROM (WITH RECURSIVE greedy AS (
  SELECT media_id, seg_id, 0 AS k, 0::BIGINT AS j FROM ra WHERE size > {LIMIT} AND n_words > 1
  UNION ALL SELECT g.media_id, g.seg_id, g.k + 1, greatest(g.j + 1, list_max(list_filter(range(g.j + 1, n_words + 1), lambda i: pre[i + 1] - pre[g.j + 1] - 1 <= {LIMIT})))
  FROM greedy g JOIN ra USING (media_id, seg_id) WHERE g.j < n_words
), fewest AS (
  SELECT media_id, seg_id, greatest(max(k), CAST(ceil(any_value(size) / {LIMIT}) AS INTEGER)) AS n FROM greedy JOIN ra USING (media_id, seg_id) GROUP BY ALL
), whole AS (SELECT ra.*, n FROM ra JOIN fewest USING (media_id, seg_id) WHERE n <= n_words),
best AS (
  SELECT media_id, seg_id, 0 AS k, 0::BIGINT AS j, 0::BIGINT AS cost, [0::BIGINT] AS cuts FROM whole
  UNION ALL SELECT media_id, seg_id, k + 1, i, min(cost), arg_min(list_append(cuts, i), (cost, j)) FROM (
    SELECT media_id, seg_id, k, j, i, cuts, cost + (CAST(pre[i + 1] - pre[j + 1] - 1 AS BIGINT) * n - size) * (CAST(pre[i + 1] - pre[j + 1] - 1 AS BIGINT) * n - size)
      + CASE WHEN i = n_words THEN 0 ELSE 10 * n * n * (CASE WHEN {_LONE.format("ws[i]")} THEN 500 ELSE 0 END - CASE WHEN {_STOPS.format("ws[i]")} THEN 20 ELSE 0 END) END AS cost
    FROM (SELECT b.*, n, n_words, pre, ws, size, unnest(range(b.j + 1, least(b.j + {LIMIT // 2 + 2}, n_words + 1))) AS i FROM best b JOIN whole USING (media_id, seg_id) WHERE b.k < n)
    WHERE i = j + 1 OR pre[i + 1] - pre[j + 1] - 1 <= {LIMIT}
  ) GROUP BY media_id, seg_id, k, i
), done AS (SELECT media_id, seg_id, cuts FROM best JOIN whole USING (media_id, seg_id) WHERE k = n AND j = n_words),
parts AS (
  SELECT media_id, seg_id, CASE WHEN cuts IS NOT NULL THEN list_transform(range(1, len(cuts)), lambda i: array_to_string(ws[cuts[i] + 1:cuts[i + 1]], ' '))
    WHEN size <= {LIMIT} OR n_words < 2 THEN [text] ELSE ws END AS p FROM ra LEFT JOIN done USING (media_id, seg_id)
) SELECT media_id, seg_id, CAST(unnest(range(len(p))) AS INTEGER) AS part, unnest(p) AS text FROM parts)"""


@query("x08_reflow", REFLOW)
def x08(t: Tables) -> DataFrame:
    return t.segments.select("media_id", "seg_id", F.posexplode(reflow.reflowed(F.col("text"), LIMIT)).alias("part", "text"))


def groups(t: Tables) -> DataFrame:
    """Three sentences at a time as one text, their lengths as its weights."""
    g = t.segments.groupBy("media_id", F.floor((F.col("seg_id") - 1) / 3).alias("grp")).agg(F.array_sort(F.collect_list(F.struct("seg_id", "text", (F.col("end_ms") - F.col("start_ms")).alias("ms")))).alias("s"))
    field = lambda k: F.transform("s", lambda x: x[k])
    return g.select("media_id", "grp", F.array_join(field("text"), " ").alias("text"), field("ms").alias("weights"))


_WORTH = f"""1000 * CAST({_LONE.format("ws[i + 1]")} AS INT) - 12 * CAST({_STOPS.format("ws[i + 1]")} AS INT) - 8 * CAST(regexp_matches(ws[i + 2], '(?i)^({"|".join(reflow.JOINING)})$') AS INT)"""
SHARES = f""", sg AS (SELECT media_id, (seg_id - 1) // 3 AS grp, string_agg(text, ' ' ORDER BY seg_id) AS text, list(end_ms - start_ms ORDER BY seg_id) AS weights FROM segments GROUP BY ALL),
sw AS (SELECT *, string_split(text, ' ') AS ws, length(text) AS size, CAST(list_sum(weights) AS BIGINT) AS total FROM sg),
se AS (SELECT *, len(ws) AS n_words, list_transform(range(1, len(ws) + 1), lambda i: length(array_to_string(ws[1:i], ' '))) AS ends FROM sw)
SELECT * FROM (WITH RECURSIVE cut AS (
  SELECT media_id, grp, 0 AS k, 0::BIGINT AS prev, [0::BIGINT] AS cuts, 0::BIGINT AS given FROM se WHERE len(weights) > 1 AND n_words > 1
  UNION ALL SELECT media_id, grp, k + 1, least(n_words - 1, i + 1), list_append(cuts, least(n_words, i + 1)), given FROM (
    SELECT c.media_id, c.grp, c.k, c.cuts, c.given + weights[c.k + 1] AS given, n_words, CASE WHEN c.prev >= n_words - 1 THEN c.prev ELSE list_min(list_transform(range(c.prev, n_words - 1),
      lambda i: struct_pack(c := abs(ends[i + 1] * total - size * (c.given + weights[c.k + 1])) + total * ({_WORTH}), i := i))).i END AS i
    FROM cut c JOIN se USING (media_id, grp) WHERE c.k < len(weights) - 1
  )
), parts AS (
  SELECT media_id, grp, CASE WHEN cuts IS NULL THEN [text] ELSE list_transform(range(1, len(cuts) + 1), lambda i: array_to_string(ws[cuts[i] + 1:coalesce(cuts[i + 1], n_words)], ' ')) END AS p
  FROM se LEFT JOIN (SELECT c.* FROM cut c JOIN se USING (media_id, grp) WHERE k = len(weights) - 1) USING (media_id, grp)
) SELECT media_id, grp, CAST(unnest(range(len(p))) AS INTEGER) AS part, unnest(p) AS text FROM parts)"""


@query("x09_shared_out", SHARES)
def x09(t: Tables) -> DataFrame:
    return groups(t).select("media_id", "grp", F.posexplode(reflow.shared_out(F.col("text"), F.col("weights"))).alias("part", "text"))

"""Queries of refined edges, camera accuracy, name tags and spread captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutloom.operators import audio, captions, multicam
from cutloom.plans.media import FRAMES, frames
from cutloom.plans.registry import Tables, query


@query("n06_refined_edges", FRAMES + """, pt AS (
  SELECT media_id, seg_id * 2 AS point_no, end_ms - 40 AS at_ms, true AS at_end, 100 + seg_id % 5 * 100 AS extend_ms, 120 AS fallback_ms FROM segments
  UNION ALL SELECT media_id, seg_id * 2 + 1, start_ms + 40, false, 100 + seg_id % 4 * 100, 120 FROM segments),
met AS (SELECT p.*, frame_no, rms, frame_no * 50 AS ft, 20 * log10(greatest(rms, 1e-7)) AS db,
  CASE WHEN at_end THEN 1 ELSE -1 END * (frame_no - CAST(floor(at_ms / 50 + 0.5) AS BIGINT)) AS k
  FROM pt p JOIN frames f ON p.media_id = f.media_id AND frame_no * 50 BETWEEN at_ms - extend_ms - 1500 AND at_ms + extend_ms + 1450),
lev AS (SELECT media_id, point_no, quantile_cont(db, 0.1) AS lo, quantile_cont(db, 0.95) AS hi FROM met GROUP BY ALL),
low AS (SELECT m.*, db < lo + 0.25 * greatest(0, hi - lo) AS q FROM met m JOIN lev USING (media_id, point_no) WHERE k >= 0 AND k <= round(extend_ms / 50)),
three AS (SELECT a.media_id, a.point_no, min(a.k) AS k FROM low a JOIN low b ON a.media_id = b.media_id AND a.point_no = b.point_no AND b.k = a.k + 1
  JOIN low c ON a.media_id = c.media_id AND a.point_no = c.point_no AND c.k = a.k + 2 WHERE a.q AND b.q AND c.q GROUP BY ALL),
least_ AS (SELECT media_id, point_no, arg_min(ft, (rms, k)) AS ft FROM low WHERE k <= round(least(extend_ms, fallback_ms) / 50) GROUP BY ALL),
too AS (SELECT p.*, t.k IS NOT NULL AS clean, coalesce(l.ft + CASE WHEN p.at_end THEN 30 ELSE -30 END, q.ft + CASE WHEN p.at_end THEN 50 ELSE 0 END, p.at_ms) AS x FROM pt p
  LEFT JOIN three t ON p.media_id = t.media_id AND p.point_no = t.point_no
  LEFT JOIN low l ON p.media_id = l.media_id AND p.point_no = l.point_no AND l.k = t.k
  LEFT JOIN least_ q ON p.media_id = q.media_id AND p.point_no = q.point_no)
SELECT media_id, point_no, at_ms, CAST(CASE WHEN at_end THEN least(greatest(x, at_ms), at_ms + extend_ms) ELSE greatest(least(x, at_ms), at_ms - extend_ms) END AS BIGINT) AS time_ms, clean FROM too""")  # fmt: skip
def n06(t: Tables) -> DataFrame:
    s = t.segments
    ends = s.select("media_id", (F.col("seg_id") * 2).alias("point_no"), (F.col("end_ms") - 40).alias("at_ms"), F.lit(True).alias("at_end"), (100 + F.col("seg_id") % 5 * 100).alias("extend_ms"), F.lit(120).alias("fallback_ms"))
    starts = s.select("media_id", (F.col("seg_id") * 2 + 1).alias("point_no"), (F.col("start_ms") + 40).alias("at_ms"), F.lit(False).alias("at_end"), (100 + F.col("seg_id") % 4 * 100).alias("extend_ms"), F.lit(120).alias("fallback_ms"))
    return audio.refined_edges(ends.unionByName(starts), frames(t), 50).select("media_id", "point_no", "at_ms", "time_ms", "clean")


@query("m07_camera_accuracy", """, runs AS (SELECT media_id, CASE speaker WHEN 'user' THEN 1 ELSE 2 END AS cam, start_ms, end_ms, seg_id % 7 = 3 AS cutaway FROM segments),
said AS (SELECT media_id, k, count(DISTINCT speaker) AS n, min(speaker) AS s FROM (SELECT media_id, speaker, unnest(range(greatest(0, CAST(ceil(t_start / 100) AS BIGINT)), CAST(ceil(t_end / 100) AS BIGINT))) AS k FROM turns) GROUP BY ALL),
want AS (SELECT media_id, k, CASE WHEN n >= 2 THEN 0 WHEN s = 'user' THEN 1 WHEN s = 'assistant' THEN 2 ELSE -1 END AS want FROM said s
  WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.media_id = s.media_id AND (abs(t_start - k * 100) < 700 OR abs(t_end - k * 100) < 700)))
SELECT w.media_id, count(*) AS n, CAST(sum(CASE WHEN cam = want THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM want w LEFT JOIN runs r ON w.media_id = r.media_id AND k * 100 >= start_ms AND k * 100 < end_ms
WHERE NOT coalesce(cutaway, false) GROUP BY w.media_id""")  # fmt: skip
def m07(t: Tables) -> DataFrame:
    runs = t.segments.select("media_id", F.when(F.col("speaker") == "user", 1).otherwise(2).alias("cam"), "start_ms", "end_ms", (F.col("seg_id") % 7 == 3).alias("cutaway"))
    return multicam.camera_accuracy(t.turns, runs, {"user": 1, "assistant": 2})


TAGS = """, sh AS (SELECT media_id, CASE WHEN seg_id % 6 < 3 THEN 'a' ELSE 'b' END AS person, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY media_id ORDER BY seg_id) - seg_id % 4 * 40, end_ms) AS end_ms FROM segments),
tags AS (SELECT media_id, seg_id AS tag_no, CASE WHEN seg_id % 3 = 0 THEN 'a' ELSE 'b' END AS person, start_ms + seg_id % 5 * 900 AS t_ms FROM segments),
ref AS (SELECT media_id, tag_no, person, coalesce((SELECT min(start_ms) FROM sh WHERE sh.media_id = t.media_id AND sh.person = t.person AND start_ms BETWEEN t_ms - 1000 AND t_ms + 90000) + 100, t_ms) AS ref FROM tags t),
ch AS (SELECT *, coalesce(lag(person) OVER w <> person OR abs(lag(end_ms) OVER w - start_ms) >= 80, true) AS new FROM sh WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms)),
rn AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms) AS run FROM ch),
runs AS (SELECT media_id, person, min(start_ms) AS a, max(end_ms) AS b FROM rn GROUP BY media_id, person, run),
best AS (SELECT f.media_id, tag_no, min(a) AS a, arg_min(b, a) AS b FROM ref f JOIN runs r ON f.media_id = r.media_id AND f.person = r.person AND a >= ref - 3000 AND b - (greatest(a, ref - 500) + 120) >= 2000 GROUP BY ALL)
SELECT f.media_id, f.tag_no, person, CASE WHEN a IS NULL THEN ref ELSE greatest(a, ref - 500) + 120 END AS t_ms, CASE WHEN a IS NULL THEN 2500 ELSE least(3800, b - (greatest(a, ref - 500) + 120) - 50) END AS dur_ms
FROM ref f LEFT JOIN best b ON f.media_id = b.media_id AND f.tag_no = b.tag_no"""
# A host's tag goes to the first shot of all.
HOST = "coalesce((SELECT min(start_ms) FROM sh WHERE sh.media_id = t.media_id) + 200, t_ms)"


def name_tags_sql(*, hosts: bool) -> str:
    own = "coalesce((SELECT min(start_ms) FROM sh WHERE sh.media_id = t.media_id AND sh.person = t.person AND start_ms BETWEEN t_ms - 1000 AND t_ms + 90000) + 100, t_ms)"
    assert own in TAGS
    return TAGS.replace(own, f"CASE WHEN person = 'a' AND media_id % 2 = 0 THEN {HOST} ELSE {own} END") if hosts else TAGS


def name_tag_shots(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = t.segments
    nxt = F.lead("start_ms").over(W.partitionBy("media_id").orderBy("seg_id")) - F.col("seg_id") % 4 * 40
    shots = s.select("media_id", F.when(F.col("seg_id") % 6 < 3, "a").otherwise("b").alias("person"), "start_ms", F.coalesce(nxt, F.col("end_ms")).alias("end_ms"))
    tags = s.select("media_id", F.col("seg_id").alias("tag_no"), F.when(F.col("seg_id") % 3 == 0, "a").otherwise("b").alias("person"), (F.col("start_ms") + F.col("seg_id") % 5 * 900).alias("t_ms"))
    return tags, shots


@query("j16_name_tags", TAGS)
def j16(t: Tables) -> DataFrame:
    return multicam.name_tags(*name_tag_shots(t))


@query("x10_spread", """, ln AS (SELECT media_id, seg_id AS block_no, pos // 6 AS line_no, string_agg(w, ' ' ORDER BY pos) AS text FROM words GROUP BY ALL),
sp0 AS (SELECT media_id, seg_id AS block_no, min(s_ms) AS s_ms, max(e_ms) AS e_ms FROM words GROUP BY media_id, seg_id, pos // 4),
sp AS (SELECT *, CAST(sum(e_ms - s_ms) OVER (PARTITION BY media_id, block_no ORDER BY s_ms) AS BIGINT) AS u FROM sp0), al AS (SELECT media_id, block_no, max(u) AS a FROM sp GROUP BY ALL),
l1 AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY media_id, block_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p,
  CAST(sum(length(text) + 1) OVER (PARTITION BY media_id, block_no) - 1 AS BIGINT) AS w FROM ln),
l2 AS (SELECT l1.*, p * a // w AS v0, (p + length(text)) * a // w AS v1 FROM l1 JOIN al USING (media_id, block_no)),
at0 AS (SELECT l.media_id, l.block_no, line_no, min(e_ms - u) FILTER (u >= v0) + any_value(v0) AS t0_ms, min(e_ms - u) FILTER (u >= v1) + any_value(v1) AS t1_ms, any_value(text) AS text
  FROM l2 l JOIN sp s ON l.media_id = s.media_id AND l.block_no = s.block_no GROUP BY ALL)
SELECT media_id, block_no, line_no, text, t0_ms, t1_ms FROM at0""")  # fmt: skip
def x10(t: Tables) -> DataFrame:
    w = t.words.withColumn("block_no", F.col("seg_id"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "w")))
    lines = w.groupBy("media_id", "block_no", F.expr("pos div 6").alias("line_no")).agg(F.array_join(F.transform(ordered, lambda x: x["w"]), " ").alias("text"))
    spans = w.groupBy("media_id", "block_no", F.expr("pos div 4").alias("_s")).agg(F.min("s_ms").alias("s_ms"), F.max("e_ms").alias("e_ms")).drop("_s")
    return captions.spread(lines, spans)


@query("w18_fast_cues", """, wt AS (SELECT seq_id, clip_ix, s_ms + start_ms - in_ms AS t0, e_ms + start_ms - in_ms AS t1, w FROM words w JOIN clips c ON w.media_id = c.media_id AND s_ms >= in_ms - 10 AND e_ms <= out_ms + 10),
nw AS (SELECT *, row_number() OVER v AS i, coalesce(t0 - lag(t1) OVER v > 350 OR regexp_matches(lag(w) OVER v, '[.?!]$'), true) AS new FROM wt WINDOW v AS (PARTITION BY seq_id, clip_ix ORDER BY t0, t1, w)),
fc AS (SELECT * FROM (WITH RECURSIVE f AS (
  SELECT seq_id, clip_ix, i, i AS head, length(w) AS len FROM nw WHERE i = 1
  UNION ALL SELECT n.seq_id, n.clip_ix, n.i, CASE WHEN n.new OR n.i - f.head >= 3 OR f.len + 1 + length(n.w) > 17 THEN n.i ELSE f.head END,
    CASE WHEN n.new OR n.i - f.head >= 3 OR f.len + 1 + length(n.w) > 17 THEN length(n.w) ELSE f.len + 1 + length(n.w) END
  FROM f JOIN nw n ON n.seq_id = f.seq_id AND n.clip_ix = f.clip_ix AND n.i = f.i + 1) SELECT * FROM f)),
cu AS (SELECT f.seq_id, f.clip_ix, head, min(t0) AS t0, arg_max(t1, f.i) + 120 AS t1,
    upper(replace(string_agg(regexp_replace(CASE WHEN lower(regexp_replace(w, '[.,;:?!]+$', '')) = 'the' THEN 'THEE.' ELSE w END, '[.,;:]+$', ''), ' ' ORDER BY f.i), 'ß', 'SS')) AS text,
    bool_or(length(regexp_replace(w, '[^\\p{L}\\p{M}\\p{N}_]', '', 'g')) >= 9) AS large
  FROM fc f JOIN nw n ON f.seq_id = n.seq_id AND f.clip_ix = n.clip_ix AND f.i = n.i GROUP BY ALL),
cn AS (SELECT *, lead(t0) OVER (PARTITION BY seq_id ORDER BY clip_ix, t0) AS nx FROM cu)
SELECT seq_id, clip_ix, t0 AS t0_ms, CASE WHEN nx IS NULL THEN t1 WHEN least(t1, nx) - t0 < 220 THEN least(t0 + 220, nx) ELSE least(t1, nx) END AS t1_ms, text, large FROM cn""")  # fmt: skip
def w18(t: Tables) -> DataFrame:
    from cutloom.operators import timeline

    return captions.fast_cues(timeline.words_on_timeline(t.clips, t.words), {"the": "THEE."})


@query("m06_free_tracks", """, au AS (SELECT seq_id, clip_ix AS item_no, track, row_number() OVER (PARTITION BY seq_id ORDER BY clip_ix) AS i FROM clips),
ft AS (SELECT * FROM (WITH RECURSIVE f AS (
  SELECT seq_id, item_no, i, track AS got, track, [track] AS used FROM au WHERE i = 1
  UNION ALL SELECT a.seq_id, a.item_no, a.i, list_min(list_filter(range(a.track, a.track + len(f.used) + 1), lambda x: NOT list_contains(f.used, x))), a.track,
    list_append(f.used, list_min(list_filter(range(a.track, a.track + len(f.used) + 1), lambda x: NOT list_contains(f.used, x))))
  FROM f JOIN au a ON a.seq_id = f.seq_id AND a.i = f.i + 1) SELECT * FROM f))
SELECT seq_id, item_no, got AS track, got <> track AS moved FROM ft""")  # fmt: skip
def m06(t: Tables) -> DataFrame:
    return multicam.free_tracks(t.clips.select("seq_id", F.col("clip_ix").alias("item_no"), "track"))

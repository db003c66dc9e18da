"""Queries over clips, cuts, plans and ripple edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.operators import intervals, planning, timeline
from cutloom.plans.registry import Tables, query
from cutloom.plans.speech import PICKED, picked

CHOSEN = """, cho AS (SELECT *, max(kind = 'audio') OVER (PARTITION BY seq_id) AS a FROM clips WHERE NOT disabled),
chr0 AS (SELECT *, row_number() OVER (PARTITION BY seq_id, media_id, start_ms, in_ms ORDER BY clip_ix) AS r FROM cho WHERE kind = 'audio' OR NOT a)
"""


@query("f03_f04_speech_clips", CHOSEN + "SELECT seq_id, clip_ix, kind, start_ms FROM chr0 WHERE r = 1")
def f03(t: Tables) -> DataFrame:
    c = t.clips
    return timeline.speech_clips(c.unionByName(c.filter("clip_ix % 3 = 0").withColumn("clip_ix", F.col("clip_ix") + 1000))).select("seq_id", "clip_ix", "kind", "start_ms")


NARRATED = "(SELECT seq_id, clip_ix, CASE WHEN clip_ix % 4 = 1 THEN media_id + 1000 ELSE media_id END AS media_id, kind, start_ms, end_ms FROM clips)"


@query("f05_narration", f", n AS {NARRATED}, o AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY end_ms - start_ms DESC, clip_ix) AS r FROM n WHERE kind = 'audio' AND NOT EXISTS (SELECT 1 FROM n v WHERE v.kind = 'video' AND v.seq_id = n.seq_id AND v.media_id = n.media_id)) SELECT seq_id, clip_ix, media_id, start_ms, end_ms FROM o WHERE r = 1")
def f05(t: Tables) -> DataFrame:
    return timeline.narration(t.clips.withColumn("media_id", F.when(F.col("clip_ix") % 4 == 1, F.col("media_id") + 1000).otherwise(F.col("media_id"))))


@query("j02_words_on_timeline", "SELECT seq_id, clip_ix, seg_id, pos, s_ms + start_ms - in_ms AS t0_ms, e_ms + start_ms - in_ms AS t1_ms, w, spk FROM words w JOIN clips c ON w.media_id = c.media_id AND s_ms >= in_ms - 10 AND e_ms <= out_ms + 10")
def j02(t: Tables) -> DataFrame:
    return timeline.words_on_timeline(t.clips, t.words)


@query("j03_used_sentences", "SELECT DISTINCT seq_id, s.media_id, seg_id FROM segments s JOIN clips c ON s.media_id = c.media_id WHERE (least(s.end_ms, out_ms) - greatest(s.start_ms, in_ms)) * 100 > least(s.end_ms - s.start_ms, out_ms - in_ms) * 35")
def j03(t: Tables) -> DataFrame:
    return timeline.used_sentences(t.clips, t.segments)


@query("j04_clip_words", "SELECT seq_id, clip_ix, string_agg(w, ' ' ORDER BY s_ms, e_ms, w) AS text, count(*) AS n FROM words w JOIN clips c ON w.media_id = c.media_id WHERE (least(e_ms, out_ms) - greatest(s_ms, in_ms)) * 2 > e_ms - s_ms GROUP BY seq_id, clip_ix")
def j04(t: Tables) -> DataFrame:
    return timeline.clip_words(t.clips, t.words)


EDGES = ", ed AS (SELECT seq_id, clip_ix, media_id, 'in' AS edge, in_ms AS t_ms FROM clips UNION ALL SELECT seq_id, clip_ix, media_id, 'out', out_ms FROM clips)\n"
CROSSED = EDGES + """, ej AS (SELECT e.seq_id, e.clip_ix, e.edge, e.t_ms, w, row_number() OVER (PARTITION BY e.seq_id, e.clip_ix, e.edge ORDER BY s_ms, e_ms, w) AS r
  FROM ed e LEFT JOIN words w ON e.media_id = w.media_id AND s_ms < t_ms - 10 AND e_ms > t_ms + 10), ec AS (SELECT seq_id, clip_ix, edge, t_ms, w FROM ej WHERE r = 1)
"""


@query("u01_edges", EDGES + "SELECT * FROM ed")
def u01(t: Tables) -> DataFrame:
    return timeline.edges(t.clips)


@query("j05_edges_in_words", CROSSED + "SELECT * FROM ec")
def j05(t: Tables) -> DataFrame:
    return timeline.edges_in_words(timeline.edges(t.clips), t.words)


@query("q03_cut_report", CROSSED + "SELECT seq_id, count(*) AS n_edges, count(w) AS n_crossing, count(*) - count(w) AS n_clean FROM ec GROUP BY seq_id")
def q03(t: Tables) -> DataFrame:
    e = timeline.edges_in_words(timeline.edges(t.clips), t.words)
    return e.groupBy("seq_id").agg(F.count("*").alias("n_edges"), F.count("w").alias("n_crossing"), F.count_if(F.col("w").isNull()).alias("n_clean"))


@query("j08_snap_to_cuts", PICKED + """, sr AS (SELECT plan_id, ord, media_id, a_ms AS in_ms, b_ms AS out_ms FROM pr),
sc AS (SELECT r.plan_id, r.ord, r.media_id, r.in_ms, r.out_ms, min(CASE WHEN t_ms > in_ms + 40 AND t_ms <= in_ms + 1500 THEN t_ms END) AS ci, max(CASE WHEN t_ms >= out_ms - 1500 AND t_ms < out_ms - 40 THEN t_ms END) AS co
  FROM sr r LEFT JOIN cuts c ON r.media_id = c.media_id GROUP BY ALL),
sx AS (SELECT *, EXISTS (SELECT 1 FROM words w WHERE w.media_id = sc.media_id AND s_ms < ci AND e_ms > in_ms) AS wi, EXISTS (SELECT 1 FROM words w WHERE w.media_id = sc.media_id AND s_ms < out_ms AND e_ms > co) AS wo FROM sc)
SELECT plan_id, ord, CASE WHEN wi THEN in_ms ELSE coalesce(ci, in_ms) END AS new_in_ms, CASE WHEN wo THEN out_ms ELSE coalesce(co, out_ms) END AS new_out_ms, wi AS warn_in, wo AS warn_out FROM sx""")  # fmt: skip
def j08(t: Tables) -> DataFrame:
    return timeline.snap_to_cuts(picked(t).withColumnsRenamed({"a_ms": "in_ms", "b_ms": "out_ms"}), t.cuts, t.words)


@query("t03_razor", """, rt AS (SELECT media_id AS seq_id, t_ms FROM cuts),
rb AS (SELECT c.seq_id, clip_ix, start_ms AS b FROM clips c UNION SELECT seq_id, clip_ix, end_ms FROM clips UNION SELECT c.seq_id, clip_ix, t_ms FROM clips c JOIN rt ON c.seq_id = rt.seq_id AND t_ms > start_ms AND t_ms < end_ms),
rp AS (SELECT *, lead(b) OVER (PARTITION BY seq_id, clip_ix ORDER BY b) AS e, row_number() OVER (PARTITION BY seq_id, clip_ix ORDER BY b) AS part FROM rb)
SELECT p.seq_id, p.clip_ix, part, b AS start_ms, e AS end_ms, in_ms + b - start_ms AS in_ms, in_ms + e - start_ms AS out_ms FROM rp p JOIN clips c ON p.seq_id = c.seq_id AND p.clip_ix = c.clip_ix WHERE e IS NOT NULL""")  # fmt: skip
def t03(t: Tables) -> DataFrame:
    return timeline.razor(t.clips, t.cuts.withColumnRenamed("media_id", "seq_id"))


HOLES = ", holes AS (SELECT media_id AS seq_id, t_ms AS h_start, t_ms + 700 AS h_end FROM cuts WHERE (t_ms // 100) % 3 = 0)\n"


def holes(t: Tables) -> DataFrame:
    c = t.cuts.filter("floor(t_ms / 100) % 3 = 0")
    return c.select(F.col("media_id").alias("seq_id"), F.col("t_ms").alias("h_start"), (F.col("t_ms") + 700).alias("h_end"))


UNITED = HOLES + """, hm AS (SELECT *, CASE WHEN h_start <= max(h_end) OVER (PARTITION BY seq_id ORDER BY h_start, h_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM holes),
hi AS (SELECT *, sum(n) OVER (PARTITION BY seq_id ORDER BY h_start, h_end) AS i FROM hm), hu AS (SELECT seq_id, min(h_start) AS h_start, max(h_end) AS h_end FROM hi GROUP BY seq_id, i)
"""


@query("u05_united_windows", UNITED + "SELECT * FROM hu")
def u05(t: Tables) -> DataFrame:
    return intervals.merged(holes(t), ["seq_id"], "h_start", "h_end", 0)


@query("t04_remove_ranges", UNITED + """, hb AS (SELECT seq_id, clip_ix, start_ms AS b FROM clips UNION SELECT c.seq_id, clip_ix, h_end FROM clips c JOIN hu ON c.seq_id = hu.seq_id AND h_end > start_ms AND h_end < end_ms),
hp AS (SELECT b.seq_id, b.clip_ix, b, in_ms, start_ms, end_ms, coalesce((SELECT min(h_start) FROM hu WHERE hu.seq_id = b.seq_id AND h_end > b AND h_start < end_ms), end_ms) AS e,
  (SELECT coalesce(sum(least(h_end, b) - h_start), 0) FROM hu WHERE hu.seq_id = b.seq_id AND h_start < b) AS lost FROM hb b JOIN clips c ON b.seq_id = c.seq_id AND b.clip_ix = c.clip_ix)
SELECT seq_id, clip_ix, CAST(b - lost AS BIGINT) AS start_ms, CAST(e - lost AS BIGINT) AS end_ms, in_ms + b - start_ms AS in_ms FROM hp WHERE e > b""")  # fmt: skip
def t04(t: Tables) -> DataFrame:
    return timeline.remove_ranges(t.clips, holes(t))


@query("t06_ripple_map", UNITED + """SELECT c.seq_id, c.clip_ix, CAST(c.start_ms - coalesce((SELECT sum(least(h_end, c.start_ms) - h_start) FROM hu WHERE hu.seq_id = c.seq_id AND h_start < c.start_ms), 0) AS BIGINT) AS at_ms FROM clips c""")
def t06(t: Tables) -> DataFrame:
    united = intervals.merged(holes(t), ["seq_id"], "h_start", "h_end", 0)
    r = intervals.removed_before(t.clips.select("seq_id", "clip_ix", "start_ms"), united, ["seq_id"], "start_ms", "h_start", "h_end")
    return r.select("seq_id", "clip_ix", (F.col("start_ms") - F.col("removed_ms")).alias("at_ms"))


@query("t05_remove_clips", """, g AS (SELECT *, CASE WHEN clip_ix % 4 = 2 THEN end_ms - start_ms END AS d FROM clips),
l AS (SELECT *, CAST(coalesce(sum(d) OVER (PARTITION BY seq_id, track ORDER BY start_ms, clip_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lost FROM g)
SELECT seq_id, clip_ix, track, start_ms - lost AS start_ms, end_ms - lost AS end_ms FROM l WHERE d IS NULL""")
def t05(t: Tables) -> DataFrame:
    return timeline.remove_clips(t.clips, t.clips.filter("clip_ix % 4 = 2"))


@query("t02_close_gaps", ", n AS (SELECT *, lead(start_ms) OVER (PARTITION BY seq_id, track ORDER BY start_ms, clip_ix) AS nx FROM clips) SELECT seq_id, clip_ix, CASE WHEN nx - end_ms > 0 AND nx - end_ms <= 80 THEN nx ELSE end_ms END AS end_ms FROM n")
def t02(t: Tables) -> DataFrame:
    return timeline.close_gaps(t.clips)


@query("w19_jump_cuts", ", j AS (SELECT seq_id, clip_ix, in_ms - lag(out_ms) OVER (PARTITION BY seq_id ORDER BY start_ms, clip_ix) AS jump_ms FROM clips) SELECT * FROM j WHERE abs(jump_ms) > 300")
def w19(t: Tables) -> DataFrame:
    return timeline.jump_cuts(t.clips)


@query("a20_fingerprint", "SELECT seq_id, count(*) AS n, substr(sha1(string_agg(concat_ws(':', media_id, start_ms, end_ms, in_ms), '|' ORDER BY clip_ix)), 1, 16) AS print FROM clips GROUP BY seq_id")
def a20(t: Tables) -> DataFrame:
    return timeline.fingerprint(t.clips)


@query("j13_placed_points", """, pj AS (SELECT k.media_id, k.t_ms, c.seq_id, c.start_ms + k.t_ms - c.in_ms AS at_ms, row_number() OVER (PARTITION BY k.media_id, k.t_ms, c.seq_id ORDER BY clip_ix) AS r FROM cuts k JOIN clips c ON k.media_id = c.media_id AND k.t_ms >= in_ms - 20 AND k.t_ms < out_ms)
SELECT media_id, t_ms, seq_id, at_ms FROM pj WHERE r = 1""")
def j13(t: Tables) -> DataFrame:
    return timeline.place(t.cuts, t.clips)


@query("p04_units", """, us AS (SELECT p.plan_id, p.ord, p.seg_id, s.start_ms, s.end_ms, s.speaker FROM picks p JOIN segments s ON p.media_id = s.media_id AND p.seg_id = s.seg_id),
um AS (SELECT *, CASE WHEN seg_id = lag(seg_id) OVER w + 1 AND speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS n FROM us WINDOW w AS (PARTITION BY plan_id ORDER BY ord)),
ui AS (SELECT *, CAST(sum(n) OVER (PARTITION BY plan_id ORDER BY ord) AS BIGINT) AS unit FROM um)
SELECT plan_id, unit, min(seg_id) AS first_id, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS dur_ms, min(speaker) AS speaker FROM ui GROUP BY plan_id, unit""")  # fmt: skip
def p04(t: Tables) -> DataFrame:
    return planning.units(t.picks, t.segments)


CANDS = """, cands AS (SELECT media_id AS plan_id, seg_id AS cand_no, n_words, end_ms - start_ms AS dur_ms, start_ms, (seg_id * 3 + media_id) % 4 AS indep, (seg_id * 5 + n_words) % 4 AS strength, n_words % 4 AS point, (media_id + n_words) % 4 AS brief, seg_id % 7 = 3 AS linking, (seg_id + media_id) % 4 AS score FROM segments)
"""
RANKED = CANDS + """, sc AS (SELECT *, 20 * indep + 20 * strength + 15 * point + 20 * brief - CASE WHEN linking OR n_words <= 2 THEN 30 ELSE 0 END - CASE WHEN dur_ms * 100 > 115 * 8000 OR dur_ms * 100 < 75 * 8000 THEN 15 ELSE 0 END AS score10 FROM cands),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY score10 DESC, abs(dur_ms - 8000), cand_no) AS INTEGER) AS rank FROM sc)
"""


def cands(t: Tables) -> DataFrame:
    s, i = t.segments, F.col("seg_id")
    return s.select(
        F.col("media_id").alias("plan_id"), i.alias("cand_no"), "n_words", (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"), "start_ms",
        ((i * 3 + F.col("media_id")) % 4).alias("indep"), ((i * 5 + F.col("n_words")) % 4).alias("strength"), (F.col("n_words") % 4).alias("point"),
        ((F.col("media_id") + F.col("n_words")) % 4).alias("brief"), (i % 7 == 3).alias("linking"), ((i + F.col("media_id")) % 4).alias("score"),
    )


@query("k01_ranked_passages", RANKED + "SELECT plan_id, cand_no, score10, rank FROM rk")
def k01(t: Tables) -> DataFrame:
    return planning.ranked_passages(cands(t), 8000).select("plan_id", "cand_no", "score10", "rank")


@query("k02_finalists", RANKED + """, nr AS (SELECT *, max(score10) OVER (PARTITION BY plan_id) AS b FROM rk), nn AS (SELECT *, max(indep > 0) OVER (PARTITION BY plan_id) AS f, row_number() OVER (PARTITION BY plan_id, indep > 0 ORDER BY rank) AS p, row_number() OVER (PARTITION BY plan_id ORDER BY rank) AS q FROM nr WHERE score10 >= b - 80)
SELECT plan_id, cand_no, score10, rank FROM nn WHERE f AND indep > 0 AND p <= 5 OR NOT f AND q <= 4""")
def k02(t: Tables) -> DataFrame:
    return planning.finalists(planning.ranked_passages(cands(t), 8000))


@query("k05_chapter_choice", CANDS + ", b AS (SELECT plan_id, cand_no AS chapter, score, least(2, max(score) OVER (PARTITION BY plan_id)) AS b FROM cands) SELECT plan_id, chapter, score FROM b WHERE score >= b OR b < 1")
def k05(t: Tables) -> DataFrame:
    return planning.chapter_choice(cands(t).select("plan_id", F.col("cand_no").alias("chapter"), "score"))


@query("k04_capped_candidates", CANDS + ", r AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, start_ms, cand_no) AS r FROM cands) SELECT plan_id, cand_no, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY start_ms, cand_no) AS INTEGER) AS place FROM r WHERE r <= 3")
def k04(t: Tables) -> DataFrame:
    return planning.capped_candidates(cands(t), 3).select("plan_id", "cand_no", "place")


@query("u03_unused", "SELECT media_id, seg_id FROM segments s WHERE speaker <> 'system' AND NOT EXISTS (SELECT 1 FROM picks p WHERE p.media_id = s.media_id AND p.seg_id = s.seg_id)")
def u03(t: Tables) -> DataFrame:
    return planning.unused(t.segments, t.picks, ["system"])


@query("j18_voice_over", """, vt AS (SELECT media_id AS job_id, seg_id AS ord, start_ms, max(end_ms) OVER (PARTITION BY media_id) AS total_ms FROM segments),
va AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY ord) = 1 THEN 0 ELSE greatest(0, start_ms - 250) END AS at_ms FROM vt),
vd AS (SELECT *, coalesce(lead(at_ms) OVER (PARTITION BY job_id ORDER BY ord), total_ms) - at_ms AS dur_ms FROM va) SELECT job_id, ord, at_ms, dur_ms FROM vd WHERE dur_ms > 50""")
def j18(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    s = t.segments.select(F.col("media_id").alias("job_id"), F.col("seg_id").alias("ord"), "start_ms", F.max("end_ms").over(W.partitionBy("media_id")).alias("total_ms"))
    return planning.voice_over(s)


@query("p07_fit_to_length", """, uf AS (SELECT media_id AS plan_id, seg_id AS unit, end_ms - start_ms AS dur_ms, row_number() OVER (PARTITION BY media_id ORDER BY n_words, seg_id) AS k, sum(end_ms - start_ms) OVER (PARTITION BY media_id) AS total FROM segments), uff AS (SELECT * FROM uf) SELECT * FROM (WITH RECURSIVE f AS (
  SELECT plan_id, unit, k, dur_ms, CAST(total AS BIGINT) AS t, total > 21800 AND total - dur_ms >= 18200 AS dropped FROM uff WHERE k = 1
  UNION ALL SELECT n.plan_id, n.unit, n.k, n.dur_ms, CASE WHEN f.dropped THEN f.t - f.dur_ms ELSE f.t END,
    CASE WHEN f.dropped THEN f.t - f.dur_ms ELSE f.t END > 21800 AND CASE WHEN f.dropped THEN f.t - f.dur_ms ELSE f.t END - n.dur_ms >= 18200 FROM f JOIN uff n ON n.plan_id = f.plan_id AND n.k = f.k + 1
) SELECT plan_id, unit, NOT dropped AS kept FROM f)""")  # fmt: skip
def p07(t: Tables) -> DataFrame:
    u = t.segments.select(F.col("media_id").alias("plan_id"), F.col("seg_id").alias("unit"), (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"), (F.col("n_words") * 100_000 + F.col("seg_id")).alias("prio"))
    return planning.fit_to_length(u, 20_000)

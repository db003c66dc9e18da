"""Queries of units as an outline has them, reports over rounds and runs, shares, and structures fixed by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.operators import planning, quality, timeline
from cutloom.plans.registry import Tables, query

OUTLINE = """, op AS (SELECT DISTINCT plan_id, media_id, seg_id, seg_id % 3 + 1 AS priority, seg_id % 4 = 1 AS core, CASE WHEN seg_id % 3 > 0 THEN 't' || seg_id % 3 END AS topic, seg_id * 7 % 4 AS score FROM picks),
os AS (SELECT media_id, seg_id, end_ms - start_ms AS ms, CASE WHEN seg_id % 8 = 5 THEN NULL ELSE speaker END AS speaker, (seg_id + media_id) % 3 = 0 AS question, seg_id % 5 = 2 AS goes_on FROM segments),
oj AS (SELECT *, CASE WHEN seg_id = lag(seg_id) OVER w + 1 AND (lag(question) OVER w OR goes_on) THEN 0 ELSE 1 END AS new FROM op JOIN os USING (media_id, seg_id) WINDOW w AS (PARTITION BY plan_id, media_id ORDER BY seg_id)),
ou AS (SELECT *, CAST(sum(new) OVER (PARTITION BY plan_id, media_id ORDER BY seg_id) AS BIGINT) AS unit FROM oj),
ot AS (SELECT plan_id, media_id, unit, coalesce(speaker, '') AS who, sum(ms) AS t, min(seg_id) AS i FROM ou GROUP BY ALL), ow AS (SELECT plan_id, media_id, unit, arg_max(who, (t, -i)) AS speaker FROM ot GROUP BY ALL)
SELECT plan_id, media_id, unit, min(seg_id) AS first_id, count(*) AS n, CAST(sum(ms) AS BIGINT) AS dur_ms, min(priority) AS priority, bool_or(core) AS core, arg_min(topic, seg_id) FILTER (WHERE topic IS NOT NULL) AS topic, arg_min(score, seg_id) AS score, any_value(ow.speaker) AS speaker
FROM ou JOIN ow USING (plan_id, media_id, unit) GROUP BY plan_id, media_id, unit"""


@query("p04_outline_units", OUTLINE)
def p04(t: Tables) -> DataFrame:
    i = F.col("seg_id")
    picks = t.picks.select("plan_id", "media_id", "seg_id", (i % 3 + 1).alias("priority"), (i % 4 == 1).alias("core"), F.when(i % 3 > 0, F.concat(F.lit("t"), i % 3)).alias("topic"), (i * 7 % 4).alias("score")).distinct()
    s = t.segments.select("media_id", "seg_id", "start_ms", "end_ms", F.when(i % 8 != 5, F.col("speaker")).alias("speaker"), ((i + F.col("media_id")) % 3 == 0).alias("question"), (i % 5 == 2).alias("goes_on"))
    return planning.outline_units(picks, s)


@query("a17_measure_ranges", "SELECT user_id AS plan_id, event_type AS measure, count(DISTINCT event_id % 4) AS rounds, avg(v) AS mean, min(v) AS least, max(v) AS most FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY user_id, event_type", base=False)
def a17(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("plan_id"), (F.col("event_id") % 4).alias("round"), F.col("event_type").alias("measure"), F.round(F.col("value") * 100).cast("bigint").alias("value"))
    return quality.measure_ranges(e)


RUNS = """SELECT event_type AS model, count(*) AS runs, count(len) AS made, CAST(count_if(len IS NOT NULL AND clean) AS BIGINT) AS clean, CAST(coalesce(floor(avg(CASE WHEN len IS NOT NULL THEN overlap END) + 0.5), 0) AS BIGINT) AS overlap,
CAST(coalesce(floor(avg(abs(len - target) * 100.0::DOUBLE / target) + 0.5), 0) AS BIGINT) AS off_pct FROM (SELECT event_type, CASE WHEN event_id % 5 > 0 THEN 100 + user_id % 90 END AS len, 120 AS target, CASE WHEN event_id % 3 > 0 THEN event_id % 101 END AS overlap, event_id % 2 = 0 AS clean FROM events) GROUP BY event_type"""


@query("a19_run_summary", RUNS, base=False)
def a19(t: Tables) -> DataFrame:
    i = F.col("event_id")
    runs = t.events.select(
        F.col("event_type").alias("model"), F.when(i % 5 > 0, 100 + F.col("user_id") % 90).alias("length"), F.lit(120).alias("target"), F.when(i % 3 > 0, i % 101).alias("overlap"), (i % 2 == 0).alias("clean")
    )
    return quality.run_summary(runs, ["model"])


@query("a18_speaker_share", """, us AS (SELECT DISTINCT seq_id, s.media_id, seg_id FROM segments s JOIN clips c ON s.media_id = c.media_id WHERE (least(s.end_ms, out_ms) - greatest(s.start_ms, in_ms)) * 100 > least(s.end_ms - s.start_ms, out_ms - in_ms) * 35),
sh AS (SELECT seq_id, coalesce(speaker, '?') AS speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms FROM us JOIN segments USING (media_id, seg_id) GROUP BY ALL) SELECT seq_id, speaker, ms, CAST(ms * 100 // sum(ms) OVER (PARTITION BY seq_id) AS BIGINT) AS pct FROM sh""")  # fmt: skip
def a18(t: Tables) -> DataFrame:
    return timeline.speaker_share(timeline.used_sentences(t.clips, t.segments), t.segments)


@query("j13_unplaced_points", "SELECT DISTINCT media_id, t_ms FROM cuts k WHERE NOT EXISTS (SELECT 1 FROM clips c WHERE c.media_id = k.media_id AND t_ms >= in_ms - 20 AND t_ms < out_ms)")
def j13(t: Tables) -> DataFrame:
    return timeline.unplaced(t.cuts, t.clips)


# Fixes by hand, some a little off, some of no clip; sounds and titles lie across clips.
FIXES = """, fx AS (SELECT seq_id, clip_ix AS fix_no, in_ms + clip_ix % 5 * 20 AS old_ms, in_ms + clip_ix % 5 * 20 - 300 - clip_ix AS new_ms FROM clips WHERE clip_ix % 2 = 1),
mf AS (SELECT f.seq_id, fix_no, min(clip_ix) AS clip_ix, any_value(old_ms - new_ms) AS l FROM fx f JOIN clips c ON c.seq_id = f.seq_id AND abs(in_ms - old_ms) < 60 GROUP BY f.seq_id, fix_no),
mp AS (SELECT mf.*, c.start_ms AS pos FROM mf JOIN clips c USING (seq_id, clip_ix))
"""


def fixes(t: Tables) -> DataFrame:
    c, k = t.clips, F.col("clip_ix")
    old = F.col("in_ms") + k % 5 * 20
    return timeline.matched_fixes(c, c.filter("clip_ix % 2 = 1").select("seq_id", k.alias("fix_no"), old.alias("old_ms"), (old - 300 - k).alias("new_ms")))


@query("s13_matched_fixes", FIXES + "SELECT f.seq_id, f.fix_no, mp.clip_ix, pos AS pos_ms, CASE WHEN mp.clip_ix IS NOT NULL THEN old_ms - new_ms END AS more_ms FROM fx f LEFT JOIN mp ON mp.seq_id = f.seq_id AND mp.fix_no = f.fix_no")
def s13(t: Tables) -> DataFrame:
    return fixes(t)


@query("s13_shifted_sounds", FIXES + """, th AS (SELECT seq_id, clip_ix AS thing_no, start_ms + clip_ix % 4 * 700 - 5 AS a, end_ms + clip_ix % 3 * 2500 AS b, clip_ix % 3 = 2 AS title FROM clips),
tm AS (SELECT th.*, coalesce((SELECT sum(l) FROM mp WHERE mp.seq_id = th.seq_id AND a >= pos + 10), 0) AS ma, coalesce((SELECT sum(l) FROM mp WHERE mp.seq_id = th.seq_id AND (a >= pos + 10 OR (NOT title AND b > pos))), 0) AS mb FROM th)
SELECT seq_id, thing_no, CAST(a + ma AS BIGINT) AS start_ms, CAST(b + mb AS BIGINT) AS end_ms, CASE WHEN NOT title THEN CAST(a + 100 + ma AS BIGINT) || ' ' || CAST(b + ma AS BIGINT) END AS keys FROM tm""")  # fmt: skip
def s13_sounds(t: Tables) -> DataFrame:
    k = F.col("clip_ix")
    things = t.clips.select("seq_id", k.alias("thing_no"), (F.col("start_ms") + k % 4 * 700 - 5).alias("start_ms"), (F.col("end_ms") + k % 3 * 2500).alias("end_ms"))
    key = lambda c: F.struct(c.alias("t"), F.lit(-20.0).alias("v"))
    things = things.withColumn("keys", F.when(F.col("thing_no") % 3 != 2, F.array(key(F.col("start_ms") + 100), key(F.col("end_ms")))))
    done = timeline.shifted_by(things, fixes(t))
    return done.withColumn("keys", F.when(F.col("keys").isNotNull(), F.concat_ws(" ", F.transform("keys", lambda x: x["t"].cast("string")))))

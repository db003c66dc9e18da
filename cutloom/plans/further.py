"""Queries of sound beds, pictures under a voice, pairs of question and answer, hosts' tags and phrase fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutloom.operators import assembly, captions, multicam, planning, timeline
from cutloom.plans.assembly import _round
from cutloom.plans.edges import name_tag_shots, name_tags_sql
from cutloom.plans.registry import Tables, query

SOUNDS = [("lav.wav", -1200, 0), ("boom.wav", 2500, 1), ("cam.wav", 40_000, None)]
BEDS = f""", sd AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {o}, {'NULL' if k is None else k})" for s, o, k in SOUNDS)}) x(source, off, track)),
rg AS (SELECT media_id, seg_id, start_ms AS a, end_ms - seg_id % 3 * 200 AS z FROM segments WHERE (seg_id + media_id) % 3 > 0),
rp AS (SELECT *, coalesce(sum(z - a) OVER (PARTITION BY media_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM rg),
bd AS (SELECT media_id, seg_id, source, coalesce(track, 0) AS track, a - off AS i, pos, z - a AS d FROM rp, sd)
SELECT media_id, seg_id AS range_no, source, CAST(track AS INTEGER) AS track, i + greatest(0, -i) AS in_ms, CAST(pos + greatest(0, -i) AS BIGINT) AS at_ms, d - greatest(0, -i) AS dur_ms FROM bd WHERE d - greatest(0, -i) > 20"""


@query("m05_audio_beds", BEDS)
def m05(t: Tables) -> DataFrame:
    s = t.segments.filter("(seg_id + media_id) % 3 > 0")
    spans = s.select("media_id", F.col("seg_id").alias("range_no"), "start_ms", (F.col("end_ms") - F.col("seg_id") % 3 * 200).alias("end_ms"))
    sound = F.array(*[F.struct(F.lit(n).alias("source"), F.lit(o).cast("bigint").alias("offset_ms"), F.lit(k).cast("int").alias("track")) for n, o, k in SOUNDS])
    sounds = s.select("media_id").distinct().select("media_id", F.explode(sound).alias("x")).select("media_id", "x.*")
    return multicam.audio_beds(spans, sounds)


VOICED = """, vs AS (SELECT media_id AS job_id, seg_id AS ord, 'm' || seg_id % 4 AS source, seg_id * 977 % 30000 AS i, CASE WHEN seg_id % 6 = 5 THEN start_ms + 700 END AS at_, CASE WHEN seg_id % 7 < 6 THEN start_ms END AS st, max(end_ms) OVER (PARTITION BY media_id) AS total, CASE WHEN seg_id % 4 < 3 THEN 20000 + seg_id % 4 * 9000 END AS media FROM segments),
va AS (SELECT *, coalesce(at_, greatest(0, st - 250)) AS a FROM vs WHERE coalesce(at_, st) IS NOT NULL),
vb AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE a END AS b, coalesce(lead(a) OVER w, total) AS z FROM va WINDOW w AS (PARTITION BY job_id ORDER BY a, ord))
SELECT job_id, ord, source, CASE WHEN i + z - b > media THEN greatest(0, media - (z - b)) ELSE i END AS in_ms, b AS at_ms, z - b AS dur_ms FROM vb WHERE z - b > 50"""


@query("j18_voice_over_segments", VOICED)
def j18(t: Tables) -> DataFrame:
    i = F.col("seg_id")
    s = t.segments.select(
        F.col("media_id").alias("job_id"), i.alias("ord"), F.concat(F.lit("m"), i % 4).alias("source"), (i * 977 % 30000).alias("in_ms"), F.when(i % 6 == 5, F.col("start_ms") + 700).alias("at_ms"),
        F.when(i % 7 < 6, F.col("start_ms")).alias("start_ms"), F.max("end_ms").over(W.partitionBy("media_id")).alias("total_ms"), F.when(i % 4 < 3, 20000 + i % 4 * 9000).alias("media_ms"),
    )
    return planning.voice_over_segments(s)


# Questions by number; the walk upwards goes from what was picked, or came in as a question.
PAIRS = """, sq AS (SELECT media_id, seg_id, CASE WHEN seg_id % 6 = 4 THEN NULL ELSE speaker END AS speaker, seg_id % 5 < 3 AS mark FROM segments),
qs AS (SELECT a.media_id, a.seg_id, a.speaker, a.mark AND b.seg_id IS NOT NULL AND (a.speaker <> b.speaker OR (a.speaker IS NULL AND b.speaker IS NULL)) AS q FROM sq a LEFT JOIN sq b ON b.media_id = a.media_id AND b.seg_id = a.seg_id + 1),
qq AS (SELECT media_id, seg_id, coalesce(q, false) AS q, coalesce(speaker = 'system', false) AS out FROM qs),
pp AS (SELECT DISTINCT plan_id, media_id, seg_id FROM picks WHERE (seg_id + media_id) % 4 <> 2),
pb AS (SELECT * FROM pp UNION SELECT p.plan_id, p.media_id, p.seg_id - 1 FROM pp p JOIN qq ON qq.media_id = p.media_id AND qq.seg_id = p.seg_id - 1 WHERE q AND NOT out),
up AS (SELECT * FROM (WITH RECURSIVE u AS (SELECT * FROM pb UNION SELECT u.plan_id, u.media_id, u.seg_id + 1 FROM u JOIN qq a ON a.media_id = u.media_id AND a.seg_id = u.seg_id JOIN qq b ON b.media_id = u.media_id AND b.seg_id = u.seg_id + 1 WHERE a.q AND NOT b.out) SELECT * FROM u))
"""


def asked(t: Tables) -> DataFrame:
    i = F.col("seg_id")
    return t.segments.select(
        "media_id", "seg_id", F.when(i % 6 != 4, F.col("speaker")).alias("speaker"), F.concat(F.regexp_replace("text", r"\?\s*$", "."), F.when(i % 5 < 3, "?").otherwise("")).alias("text"),
        (i % 3 == 2).alias("low"), ((i % 3 == 2) | (i % 7 == 3)).alias("goes_on"),
    )


def with_pairs(t: Tables) -> DataFrame:
    s = asked(t)
    return planning.with_pairs(t.picks.filter("(seg_id + media_id) % 4 <> 2"), s, s.filter("speaker = 'system'").select("media_id", "speaker"))


@query("p05_pairs", PAIRS + "SELECT up.*, NOT EXISTS (SELECT 1 FROM pp WHERE pp.plan_id = up.plan_id AND pp.media_id = up.media_id AND pp.seg_id = up.seg_id) AS added FROM up")
def p05(t: Tables) -> DataFrame:
    return with_pairs(t)


WHOLE = """, sn AS (SELECT media_id, seg_id, goes_on, lead(seg_id) OVER w = seg_id + 1 AND lead(speaker) OVER w = speaker AND lead(low) OVER w AS nx, coalesce(lag(seg_id) OVER w = seg_id - 1 AND coalesce(lag(speaker) OVER w <> 'system', true), false) AS pv
  FROM (SELECT *, seg_id % 3 = 2 AS low, seg_id % 3 = 2 OR seg_id % 7 = 3 AS goes_on FROM sq) WINDOW w AS (PARTITION BY media_id ORDER BY seg_id))
"""


@query("p05_pairs_completed", PAIRS + WHOLE + _round("up", "r1") + _round("r1", "r2") + "SELECT * FROM r2")
def p05_completed(t: Tables) -> DataFrame:
    s = asked(t)
    return assembly.completed(with_pairs(t).drop("added"), s, s.filter("speaker = 'system'").select("media_id", "speaker").distinct())


PHRASES = [("THE ", "TÉ "), ("É", "E"), ("ST", "Š")]
FIXES = {"the": "THEE.", "són": "song", "son": "sun", "reré": "Reh,"}


@query("w18_phrase_fixes")
def w18(t: Tables) -> DataFrame:
    return captions.fast_cues(timeline.words_on_timeline(t.clips, t.words), FIXES, PHRASES)


@query("j16_host_tags", name_tags_sql(hosts=True))
def j16(t: Tables) -> DataFrame:
    tags, shots = name_tag_shots(t)
    return multicam.name_tags(tags, shots, tags.filter("person = 'a' and media_id % 2 = 0").select("media_id", "person"))

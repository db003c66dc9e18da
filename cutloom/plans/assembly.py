"""Queries of briefs, plans, teasers, picture tracks, voices and levels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutloom.functions import text as X
from cutloom.operators import assembly, audio, quality, shots, speakers, timeline
from cutloom.plans.media import FRAME_DIFFS, FRAMES, frame_diffs, frames
from cutloom.plans.registry import Tables, query

# What briefs say beside the words of a turn.
PHRASES = [
    "bez otázek moderátora", "třicetisekundová upoutávka", "dvě minuty a půl o tom, co je strašné", "2,5 min pro každého hosta", "přehled všech témat", "do 90 sekund",
    "tříminutový sestřih", "film 3 minuty bez otázek", "půl minuty",
]
BRIEFS = f", br AS (SELECT conv_id AS media_id, turn + 1 AS seg_id, {PHRASES!r}[1 + (conv_id + turn) % {len(PHRASES)}] || '. ' || text AS brief FROM conversations WHERE text IS NOT NULL)"


def briefs(t: Tables) -> DataFrame:
    c = t.conversations.filter("text is not null")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (1 + (F.col("conv_id") + F.col("turn")) % len(PHRASES)).cast("int"))
    return c.select(F.col("conv_id").alias("media_id"), (F.col("turn") + 1).alias("seg_id"), F.concat(phrase, F.lit(". "), "text").alias("brief"))


def _says(pattern: str) -> str:
    return f"regexp_matches(brief, '(?i){pattern}')"


def _numbers(words: dict[str, float]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {float(v)}::DOUBLE" for k, v in words.items()) + "}"


LENGTHS = BRIEFS + rf""", lo AS (SELECT *, lower(brief) AS low FROM br),
l0 AS (SELECT *, regexp_extract(low, '{assembly.ADJECTIVE}', 1) AS aw, regexp_extract(low, '{assembly.ADJECTIVE}', 2) AS au, regexp_extract(low, '{assembly.UNIT}', 1) AS uw,
  regexp_extract(low, '{assembly.UNIT}', 2) AS uu, regexp_extract(low, '{assembly.UNIT}', 3) AS uh, length(regexp_extract(low, '(?s)^(.*?){assembly.UNIT}', 1)) AS ub,
  regexp_extract(low, '{assembly.DIGITS}', 1) AS dn, regexp_extract(low, '{assembly.DIGITS}', 2) AS du FROM lo),
le AS (SELECT *, CAST(coalesce(
  CASE WHEN au <> '' THEN floor(coalesce({_numbers(assembly.IN_ADJECTIVES)}[aw], 1) * CASE WHEN au LIKE 'm%' THEN 60 ELSE 1 END + 0.5) END,
  CASE WHEN uu <> '' AND NOT regexp_matches(substr(low, greatest(1, ub - 5), least(ub, 6) + 1), '\d') THEN floor((coalesce({_numbers(assembly.BEFORE_UNITS)}[uw], 1) + CASE WHEN uh <> '' THEN 0.5 ELSE 0 END) * CASE WHEN uu LIKE 'm%' THEN 60 ELSE 1 END + 0.5) END,
  CASE WHEN dn <> '' THEN floor(CAST(replace(dn, ',', '.') AS DOUBLE) * CASE WHEN du LIKE 'm%' THEN 60 ELSE 1 END + 0.5) END) AS BIGINT) AS target_s FROM l0)
"""  # fmt: skip


@query("x11_target_length", LENGTHS + "SELECT media_id, seg_id, target_s FROM le")
def x11(t: Tables) -> DataFrame:
    return briefs(t).select("media_id", "seg_id", assembly.target_length(F.col("brief")).alias("target_s"))


@query("f10_brief_flags", LENGTHS + f"""SELECT media_id, seg_id, {_says(assembly.NO_HOST)} AS no_host, {_says(assembly.TEASER)} AS teaser, {_says(assembly.TEASER)} AND coalesce(target_s <= 40, false) AS short_teaser,
coalesce(target_s <= 60, false) AND NOT {_says(assembly.TEASER)} AND NOT {_says(assembly.OVERVIEW)} AS passage, {_says(assembly.INTENSE)} AS intense, {_says(assembly.BALANCE)} AS balance FROM le""")
def f10(t: Tables) -> DataFrame:
    b = briefs(t)
    length = assembly.target_length(F.col("brief"))
    flags = assembly.brief_flags(F.col("brief"), length) | {"short_teaser": assembly.short_teaser(F.col("brief"), length)}
    return b.select("media_id", "seg_id", *[c.alias(n) for n, c in flags.items()])


@query("f13_without_host", """, u AS (SELECT media_id, seg_id AS unit, CASE WHEN seg_id % 5 = 0 THEN 'guest' ELSE speaker END AS speaker, text || CASE WHEN seg_id % 3 = 0 THEN '?' ELSE '' END AS text FROM segments),
o AS (SELECT *, speaker = 'user' AND NOT contains(text, '?') AS out FROM u), n AS (SELECT media_id, count(DISTINCT speaker) AS n, count_if(NOT out) AS k FROM o GROUP BY media_id)
SELECT o.media_id, unit, speaker FROM o JOIN n USING (media_id) WHERE NOT out OR n < 3 OR k < 4""")  # fmt: skip
def f13(t: Tables) -> DataFrame:
    i = F.col("seg_id")
    u = t.segments.select("media_id", i.alias("unit"), F.when(i % 5 == 0, "guest").otherwise(F.col("speaker")).alias("speaker"), F.concat("text", F.when(i % 3 == 0, "?").otherwise("")).alias("text"))
    hosts = u.select("media_id").distinct().withColumn("speaker", F.lit("user"))
    return assembly.without_host(u, hosts).select("media_id", "unit", "speaker")


@query("f16_voice_over", """, n AS (SELECT seq_id, CASE WHEN clip_ix % 4 = 1 THEN media_id + 1000000 ELSE media_id END AS media_id, kind FROM clips), na AS (SELECT DISTINCT seq_id FROM n a WHERE kind = 'audio' AND NOT EXISTS (SELECT 1 FROM n v WHERE v.kind = 'video' AND v.seq_id = a.seq_id AND v.media_id = a.media_id)),
wc AS (SELECT media_id, count(*) AS n FROM words WHERE media_id % 3 <> 0 GROUP BY media_id), h AS (SELECT seq_id, coalesce(sum(wc.n), 0) AS w FROM (SELECT DISTINCT seq_id, media_id FROM n WHERE kind = 'video') v LEFT JOIN wc USING (media_id) GROUP BY seq_id)
SELECT seq_id, seq_id % 7 = 0 OR w < 20 AS voice_over FROM na JOIN h USING (seq_id)""")  # fmt: skip
def f16(t: Tables) -> DataFrame:
    c = t.clips.withColumn("media_id", F.when(F.col("clip_ix") % 4 == 1, F.col("media_id") + 1000000).otherwise(F.col("media_id")))
    words = t.words.filter("media_id % 3 <> 0").groupBy("media_id").agg(F.count("*").alias("n"))
    said = c.select("seq_id").distinct().withColumn("said", F.col("seq_id") % 7 == 0)
    return assembly.voice_over(c, timeline.narration(c), words, said)


@query("a06_sample_times", ", d AS (SELECT media_id, max(end_ms) AS d FROM segments GROUP BY media_id) SELECT media_id, CAST(k AS BIGINT) AS k, CAST(floor(d * (40 + 75 * k) / 400) AS BIGINT) AS t_ms FROM d, range(5) r(k)")
def a06_times(t: Tables) -> DataFrame:
    return assembly.sample_times(t.segments.groupBy("media_id").agg(F.max("end_ms").alias("duration_ms")))


@query("a14_unit_median", """, u AS (SELECT media_id, CASE WHEN media_id % 10 <> 0 THEN end_ms - start_ms END AS v FROM segments), r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY v) AS p, count(*) OVER (PARTITION BY media_id) AS n FROM u WHERE v IS NOT NULL)
SELECT m.media_id, coalesce(v, 8000) AS median FROM (SELECT DISTINCT media_id FROM u) m LEFT JOIN r ON m.media_id = r.media_id AND p = n // 2 + 1""")  # fmt: skip
def a14_units(t: Tables) -> DataFrame:
    u = t.segments.select("media_id", F.when(F.col("media_id") % 10 != 0, F.col("end_ms") - F.col("start_ms")).alias("v"))
    return assembly.upper_median(u, "media_id", "v", 8000)


@query("a19_run_table", "SELECT event_type AS model, count(*) AS runs, round(avg(value), 4) AS sec, round(avg(value * 3), 4) AS cost, round(avg(100 + user_id % 90), 4) AS length, round(avg(abs(100 + user_id % 90 - 120) * 100 / 120), 4) AS off_pct, CAST(sum(event_id % 3) AS BIGINT) AS flaws FROM events GROUP BY event_type", base=False)
def a19(t: Tables) -> DataFrame:
    e = t.events
    runs = e.select(F.col("event_type").alias("model"), F.col("value").alias("sec"), (F.col("value") * 3).alias("cost"), (100 + F.col("user_id") % 90).alias("length"), F.lit(120).alias("target"), (F.col("event_id") % 3).alias("flaws"))
    r = assembly.run_table(runs)
    return r.select("model", "runs", *[F.round(c, 4).alias(c) for c in ("sec", "cost", "length", "off_pct")], "flaws")


@query("a21_music_levels", """SELECT event_id, list_transform(k, lambda x: round(CASE WHEN x > -40 THEN x + g - coalesce(list_max(list_filter(k, lambda y: y > -40)), -20) ELSE x END, 4)) AS db FROM (
SELECT event_id, [-(value % 60), -((value * 7) % 60), -45.0::DOUBLE] AS k, CASE WHEN contains(event_type, 'click') THEN -18 WHEN contains(event_type, 'c') THEN -25 ELSE -22 END AS g FROM events)""", base=False)  # fmt: skip
def a21(t: Tables) -> DataFrame:
    key = lambda i, x: F.struct(F.lit(i).alias("t"), x.cast("double").alias("db"))
    v = F.col("value")
    clips = t.events.select("event_id", F.col("event_type").alias("name"), F.array(key(0, -(v % 60)), key(1, -((v * 7) % 60)), key(2, F.lit(-45.0))).alias("keys"))
    done = assembly.levelled(clips, [("click", -18.0), ("c", -25.0)])
    return done.select("event_id", F.transform("keys", lambda k: F.round(k["db"], 4)).alias("db"))


def candidates(t: Tables) -> DataFrame:
    """Sentences of a recording in turn as units, some in parts that touch."""
    s, i = t.segments.filter("n_words >= 6"), F.col("seg_id")
    one = lambda k, w0, w1, full: F.struct(F.lit(k).alias("k"), w0.cast("bigint").alias("w0"), w1.cast("bigint").alias("w1"), F.lit(full).alias("full"))
    last = F.col("n_words") - 1
    parts = F.when(i % 3 == 0, F.array(one(0, F.lit(0), last, True))).when(i % 3 == 1, F.array(one(0, F.lit(0), F.lit(1), False), one(1, F.lit(2), last, False)))
    parts = parts.otherwise(F.array(one(0, F.lit(0), F.lit(1), False), one(1, F.lit(3), last, False)))
    return s.select(F.col("media_id").alias("cand"), "seg_id", F.explode(parts).alias("p")).select("cand", (i * 2 + F.col("p.k")).alias("ord"), "seg_id", "p.w0", "p.w1", "p.full")


@query("p03_teaser_picks", """, u AS (SELECT media_id AS cand, seg_id, n_words - 1 AS l, unnest(CASE seg_id % 3 WHEN 0 THEN [{'w0': 0, 'w1': n_words - 1, 'f': true}] WHEN 1 THEN [{'w0': 0, 'w1': n_words - 1, 'f': false}] ELSE [{'w0': 0, 'w1': 1, 'f': false}, {'w0': 3, 'w1': n_words - 1, 'f': false}] END) AS p FROM segments WHERE n_words >= 6)
SELECT cand, row_number() OVER (PARTITION BY cand ORDER BY seg_id, p.w0) AS pick, seg_id, CASE WHEN NOT p.f THEN p.w0 END AS from_word, CASE WHEN NOT p.f THEN p.w1 END AS to_word FROM u""")  # fmt: skip
def p03(t: Tables) -> DataFrame:
    return assembly.teaser_picks(candidates(t))


COMPLETE = """, sl AS (SELECT media_id, seg_id, speaker, seg_id % 3 = 2 AS low, seg_id % 3 = 2 OR seg_id % 7 = 3 AS goes_on FROM segments),
sn AS (SELECT *, lead(seg_id) OVER w = seg_id + 1 AND lead(speaker) OVER w = speaker AND lead(low) OVER w AS nx, coalesce(lag(seg_id) OVER w = seg_id - 1 AND lag(speaker) OVER w <> 'system', false) AS pv FROM sl WINDOW w AS (PARTITION BY media_id ORDER BY seg_id))
"""


def _round(source: str, name: str) -> str:
    return f""", {name}j AS (SELECT p.plan_id, p.media_id, p.seg_id, nx, pv, goes_on AND NOT EXISTS (SELECT 1 FROM {source} q WHERE q.plan_id = p.plan_id AND q.media_id = p.media_id AND q.seg_id = p.seg_id - 1) AS need FROM {source} p JOIN sn s ON p.media_id = s.media_id AND p.seg_id = s.seg_id),
{name} AS (SELECT plan_id, media_id, seg_id FROM {name}j WHERE NOT need OR pv UNION SELECT plan_id, media_id, seg_id - 1 FROM {name}j WHERE need AND pv UNION SELECT plan_id, media_id, seg_id + 1 FROM {name}j WHERE nx)
"""


@query("p05_complete_picks", COMPLETE + _round("picks", "r1") + _round("r1", "r2") + "SELECT * FROM r2")
def p05(t: Tables) -> DataFrame:
    i = F.col("seg_id")
    s = t.segments.select("media_id", "seg_id", "speaker", (i % 3 == 2).alias("low"), ((i % 3 == 2) | (i % 7 == 3)).alias("goes_on"))
    excluded = s.filter("speaker = 'system'").select("media_id", "speaker").distinct()
    return assembly.completed(t.picks, s, excluded)


@query("p12_picture_track", """, st AS (SELECT media_id AS track_id, seg_id, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE greatest(0, start_ms - 250) END AS a, max(end_ms) OVER (PARTITION BY media_id) AS total FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY seg_id)),
sb AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY track_id ORDER BY seg_id), total) AS b FROM st), sc AS (SELECT * , CASE WHEN seg_id % 3 = 1 THEN [seg_id % 5, seg_id % 4] WHEN seg_id % 3 = 2 THEN [seg_id % 5] END AS s FROM sb WHERE b - a >= 200),
sd AS (SELECT track_id, seg_id, a, b, coalesce(s, [coalesce(last_value(s[-1] IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)]) AS s FROM sc),
se AS (SELECT track_id, seg_id, a, (b - a) / len(s) AS d, unnest(s) AS shot, unnest(range(len(s))) AS k FROM sd)
SELECT track_id, seg_id, CAST(k AS INTEGER) AS k, shot, round(a + k * d, 3) AS at_ms, round(d, 3) AS dur_ms, round(shot * 1000 + coalesce(sum(d) OVER (PARTITION BY track_id, shot ORDER BY seg_id, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS in_ms FROM se""")  # fmt: skip
def p12(t: Tables) -> DataFrame:
    s, i = t.segments, F.col("seg_id")
    own = F.when(i % 3 == 1, F.array(i % 5, i % 4)).when(i % 3 == 2, F.array(i % 5))
    chosen = s.select(F.col("media_id").alias("track_id"), "seg_id", F.posexplode(own).alias("k", "shot"))
    shots_ = t.spark.range(5).select(F.col("id").alias("shot"), (F.col("id") * 1000).alias("from_ms"))
    total = F.max("end_ms").over(W.partitionBy("media_id"))
    track = assembly.picture_track(s.select(F.col("media_id").alias("track_id"), "seg_id", "start_ms", total.alias("total_ms")), chosen, shots_)
    return track.select("track_id", "seg_id", "k", "shot", *[F.round(c, 3).alias(c) for c in ("at_ms", "dur_ms", "in_ms")])


@query("s13_shift_fixes", """, f AS (SELECT *, CASE WHEN clip_ix % 3 = 2 THEN 400 + clip_ix ELSE 0 END AS l FROM clips)
SELECT seq_id, clip_ix, CAST(start_ms + m AS BIGINT) AS start_ms, CAST(end_ms + m + l AS BIGINT) AS end_ms, CAST(in_ms - l AS BIGINT) AS in_ms FROM (SELECT *, coalesce(sum(l) OVER (PARTITION BY seq_id ORDER BY clip_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM f)""")  # fmt: skip
def s13(t: Tables) -> DataFrame:
    fixes = t.clips.filter("clip_ix % 3 = 2").select("seq_id", "clip_ix", (400 + F.col("clip_ix")).alias("more_ms"))
    return assembly.extended_backwards(t.clips, fixes)


@query("s14_plan_listing", """, l AS (SELECT media_id, seg_id, CASE WHEN regexp_matches(tx, '^\\p{Ll}') THEN '~' ELSE '' END || printf('%d %s %d.%d s: %s', seg_id, speaker, (end_ms - start_ms + 50) // 1000, (end_ms - start_ms + 50) // 100 % 10, tx) AS line FROM (SELECT *, substr(text, 1 + seg_id % 2) AS tx FROM segments)),
o AS (SELECT plan_id, string_agg(line, chr(10) ORDER BY ord) AS listing FROM picks JOIN l USING (media_id, seg_id) GROUP BY plan_id),
r AS (SELECT s.media_id AS plan_id, l.*, row_number() OVER (PARTITION BY s.media_id ORDER BY s.seg_id * 7 % 11, s.seg_id) AS n FROM segments s JOIN l USING (media_id, seg_id)
  WHERE (s.seg_id * 3 + s.media_id) % 4 < 3 AND NOT EXISTS (SELECT 1 FROM picks q WHERE q.plan_id = s.media_id AND q.media_id = s.media_id AND q.seg_id = s.seg_id)),
a AS (SELECT plan_id, string_agg(line, chr(10) ORDER BY n) AS alternates FROM r WHERE n <= 15 GROUP BY plan_id),
k AS (SELECT media_id AS plan_id, CASE WHEN speaker = 'system' THEN 'moderator' ELSE 'off topic' END AS kind, seg_id FROM segments WHERE speaker = 'system' OR seg_id % 5 = 4),
x AS (SELECT plan_id, kind || ' ' || string_agg('#' || seg_id, ',' ORDER BY seg_id) AS x FROM k GROUP BY plan_id, kind), y AS (SELECT plan_id, string_agg(x, '; ' ORDER BY x) AS removed FROM x GROUP BY plan_id)
SELECT o.plan_id, listing, coalesce(alternates, '') AS alternates, coalesce(removed, '') AS removed FROM o LEFT JOIN a USING (plan_id) LEFT JOIN y USING (plan_id)""")  # fmt: skip
def s14(t: Tables) -> DataFrame:
    s, i = t.segments, F.col("seg_id")
    plan = F.col("media_id").alias("plan_id")
    alternates = s.filter((i * 3 + F.col("media_id")) % 4 < 3).select(plan, "media_id", (i * 7 % 11 * 100_000 + i).alias("ord"), "seg_id")
    kind = F.when(F.col("speaker") == "system", "moderator").when(i % 5 == 4, "off topic")
    removed = s.select(plan, kind.alias("kind"), "seg_id").filter("kind is not null")
    return assembly.plan_listing(t.picks, s.withColumn("text", F.expr("substr(text, cast(1 + seg_id % 2 as int))")), alternates, removed)


@query("w28_logo_bounds", """, fr AS (SELECT media_id, unnest(range(max(end_ms) // 100)) AS frame_no, max(end_ms) // 100 AS n FROM segments GROUP BY media_id), fl AS (SELECT *, frame_no < media_id % 12 OR frame_no >= n - media_id % 5 OR frame_no % 50 = 20 AS flagged FROM fr),
g AS (SELECT media_id, coalesce(min(CASE WHEN NOT flagged THEN frame_no END), max(frame_no) + 1) * 100 AS h, (coalesce(max(CASE WHEN NOT flagged THEN frame_no END), -1) + 1) * 100 AS tail_ms FROM fl GROUP BY media_id),
wp AS (SELECT media_id, s_ms, coalesce(lag(w) OVER (PARTITION BY media_id ORDER BY seg_id, pos) LIKE '%.', false) AS stop FROM words)
SELECT g.media_id, coalesce(min(CASE WHEN stop THEN s_ms END), min(s_ms), h) AS head_ms, tail_ms FROM g LEFT JOIN wp ON g.media_id = wp.media_id AND h > 450 AND s_ms >= h GROUP BY g.media_id, h, tail_ms""")  # fmt: skip
def w28(t: Tables) -> DataFrame:
    n = t.segments.groupBy("media_id").agg(F.floor(F.max("end_ms") / 100).alias("n"))
    f = n.select("media_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("frame_no"))
    flagged = (F.col("frame_no") < F.col("media_id") % 12) | (F.col("frame_no") >= F.col("n") - F.col("media_id") % 5) | (F.col("frame_no") % 50 == 20)
    stop = F.coalesce(F.lag("w").over(W.partitionBy("media_id").orderBy("seg_id", "pos")).endswith("."), F.lit(False))
    return assembly.clean_bounds(f.withColumn("flagged", flagged), t.words.select("media_id", "s_ms", stop.alias("after_stop")), 100)


@query("n05_edge_levels", FRAMES + """, ed AS (SELECT media_id, seg_id * 2 AS edge_no, start_ms AS t, -1 AS side FROM segments UNION ALL SELECT media_id, seg_id * 2 + 1, end_ms, 1 FROM segments),
m AS (SELECT e.media_id, edge_no, (frame_no * 50 - t) * side AS far, 20 * log10(greatest(rms, 1e-7)) AS db FROM ed e JOIN frames f ON e.media_id = f.media_id AND frame_no * 50 BETWEEN t - 2000 AND t + 2000)
SELECT media_id, edge_no, round(max(CASE WHEN far BETWEEN 0 AND 100 THEN db END) - quantile_cont(db, 0.9), 4) AS level_db FROM m GROUP BY media_id, edge_no""")  # fmt: skip
def n05(t: Tables) -> DataFrame:
    s = t.segments
    e = s.select("media_id", (F.col("seg_id") * 2).alias("edge_no"), F.col("start_ms").alias("t_ms"), F.lit(-1).alias("side"))
    e = e.unionByName(s.select("media_id", (F.col("seg_id") * 2 + 1).alias("edge_no"), F.col("end_ms").alias("t_ms"), F.lit(1).alias("side")))
    return assembly.edge_levels(e, frames(t), 50, 100).withColumn("level_db", F.round("level_db", 4))


@query("x10_spread_text", """, sp AS (SELECT media_id AS text_id, t_start AS a, t_end AS b FROM turns), sq AS (SELECT text_id, a, min(b) AS b FROM (SELECT text_id, a, least(b, coalesce(lead(a) OVER (PARTITION BY text_id ORDER BY a), b)) AS b FROM sp) WHERE b > a GROUP BY ALL),
ss AS (SELECT *, sum(b - a) OVER (PARTITION BY text_id ORDER BY a) AS hi, sum(b - a) OVER (PARTITION BY text_id) AS total FROM sq), tc AS (SELECT media_id AS text_id, seg_id * 100000 + pos AS pos, sum(length(w) + 1) OVER (PARTITION BY media_id ORDER BY seg_id, pos) - length(w) - 1 AS c, sum(length(w) + 1) OVER (PARTITION BY media_id) AS n FROM words)
SELECT text_id, pos, CAST(a + floor(c * total / n) - (hi - (b - a)) AS BIGINT) AS t_ms FROM tc JOIN ss USING (text_id) WHERE floor(c * total / n) >= hi - (b - a) AND floor(c * total / n) < hi""")  # fmt: skip
def x10(t: Tables) -> DataFrame:
    texts = t.words.select(F.col("media_id").alias("text_id"), (F.col("seg_id") * 100000 + F.col("pos")).alias("pos"), "w")
    w = W.partitionBy("media_id").orderBy("t_start")
    spans = t.turns.select(F.col("media_id").alias("text_id"), F.col("t_start").alias("a_ms"), F.least("t_end", F.coalesce(F.lead("t_start").over(w), "t_end")).alias("b_ms"))
    spans = spans.filter("b_ms > a_ms").groupBy("text_id", "a_ms").agg(F.min("b_ms").alias("b_ms"))
    return assembly.spread(texts, spans)


@query("x12_repaired_json")
def x12(t: Tables) -> DataFrame:
    @F.pandas_udf("string")
    def repaired(texts: pd.Series) -> pd.Series:
        return texts.map(assembly.repaired_json)

    whole = F.concat(F.lit('{"a": ['), "props", F.lit(', {"b": "}\\""}], "c": '), "props", F.lit("}"))
    e = t.events.select("event_id", whole.alias("raw")).withColumn("raw", F.expr("substr(raw, 1, cast(event_id % 60 + 1 as int))"))
    return e.select("event_id", repaired("raw").alias("json"))


LIBRARY = """WITH lib AS (SELECT 'Voice_' || label AS name, arg_min(embedding, vec_id) AS vec, count(*) AS n FROM embeddings WHERE label % 3 <> 0 GROUP BY label), new AS (SELECT 'VOICE_' || label AS name, arg_max(embedding, vec_id) AS vec FROM embeddings WHERE label % 3 <> 1 GROUP BY label)
"""


def library(t: Tables) -> DataFrame:
    e = t.embeddings.filter("label % 3 <> 0").groupBy("label").agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("vec"), F.count("*").alias("n"))
    return e.select(F.concat(F.lit("Voice_"), F.col("label").cast("string")).alias("name"), "vec", "n", F.array(F.lit("first")).alias("sources"))


@query("a09_enrolled", LIBRARY + """, j AS (SELECT coalesce(lib.name, new.name) AS name, n, lib.vec AS v, new.vec AS w FROM lib FULL JOIN new ON lower(lib.name) = lower(new.name)),
m AS (SELECT *, CASE WHEN v IS NULL THEN list_transform(w, lambda x: x::DOUBLE) WHEN w IS NULL THEN list_transform(v, lambda x: x::DOUBLE) ELSE list_transform(list_zip(v, w), lambda z: (z[1]::DOUBLE * n + z[2]::DOUBLE) / (n + 1)) END AS r FROM j)
SELECT name, coalesce(n, 0) + CASE WHEN w IS NULL THEN 0 ELSE 1 END AS n, CASE WHEN v IS NULL THEN 'second' WHEN w IS NULL THEN 'first' ELSE 'first,second' END AS sources, round(r[1] / CASE WHEN w IS NULL THEN 1 ELSE sqrt(list_sum(list_transform(r, lambda x: x * x))) END, 5) AS x FROM m""", base=False)  # fmt: skip
def a09(t: Tables) -> DataFrame:
    new = t.embeddings.filter("label % 3 <> 1").groupBy("label").agg(F.max_by("embedding", "vec_id").cast("array<double>").alias("vec"))
    new = new.select(F.concat(F.lit("VOICE_"), F.col("label").cast("string")).alias("name"), "vec", F.lit("second").alias("source"))
    return speakers.enrolled(library(t), new).select("name", "n", F.array_join("sources", ",").alias("sources"), F.round(F.get("vec", F.lit(0)), 5).alias("x"))


@query("a22_library", LIBRARY + "SELECT name, n, (SELECT count(*) FROM lib WHERE lower(name) = 'voice_4') AS removed FROM lib WHERE lower(name) <> 'voice_4'", base=False)
def a22(t: Tables) -> DataFrame:
    lib = library(t)
    left = speakers.forgotten(lib, "VOICE_4")
    counts = lib.agg(F.count("*").alias("_n")).join(left.agg(F.count("*").alias("_m")))  # one row each
    return left.join(F.broadcast(counts)).select("name", "n", (F.col("_n") - F.col("_m")).alias("removed"))


@query("n01_envelope", FRAME_DIFFS + "SELECT media_id, CAST(floor((frame_no - 1) / 10) AS BIGINT) AS frame_no, round(sqrt(avg(diff * diff)), 6) AS rms FROM f GROUP BY ALL HAVING count(*) = 10", base=False)
def n01(t: Tables) -> DataFrame:
    samples = frame_diffs(t).select("media_id", (F.col("frame_no") - 1).alias("i"), F.col("diff").alias("x"))
    return audio.envelope(samples, 10).withColumn("rms", F.round("rms", 6))


RULES = [(1, 1, "dark", 0.0, 0.3, "night"), (1, 2, "blue", 0.7, 1.0, "night"), (2, 1, "dark", 0.3, 0.5, "room"), (2, 1, "blue", 0.2, 0.8, "room"), (3, 1, "blue", 0.0, 0.5, "street")]


@query("v03_shot_types", f"""WITH r(ord, alt, feature, lo, hi, type) AS (VALUES {", ".join(map(str, RULES))}), f AS (SELECT user_id AS shot_id, quantile_cont((event_id % 50) / 100.0, 0.5) AS m FROM events GROUP BY user_id),
v AS (SELECT shot_id, 'dark' AS feature, (shot_id * 37) % 101 / 100.0 * 0.5 + m AS value FROM f UNION ALL SELECT shot_id, 'blue', (shot_id * 53) % 101 / 100.0 * 0.5 + m FROM f),
h AS (SELECT shot_id, ord, alt, type, count(*) AS n FROM v JOIN r USING (feature) WHERE value >= lo AND (value < hi OR hi = 1 AND value <= 1) GROUP BY ALL),
b AS (SELECT shot_id, arg_min(type, ord * 10 + alt) AS type FROM h JOIN (SELECT ord, alt, count(*) AS n FROM r GROUP BY ALL) z USING (ord, alt, n) GROUP BY shot_id)
SELECT f.shot_id, coalesce(type, 'other') AS type FROM f LEFT JOIN b USING (shot_id)""", base=False)  # fmt: skip
def v03(t: Tables) -> DataFrame:
    f = t.events.groupBy("user_id").agg(F.percentile(F.col("event_id") % 50 / 100.0, 0.5).alias("m"))
    value = lambda k: (F.col("user_id") * k) % 101 / 100.0 * 0.5 + F.col("m")
    long = f.select(F.col("user_id").alias("shot_id"), F.explode(F.create_map(F.lit("dark"), value(37), F.lit("blue"), value(53))).alias("feature", "value"))
    rules = t.spark.createDataFrame(RULES, "ord int, alt_no int, feature string, lo double, hi double, type string")
    return shots.first_rule(long, rules)


@query("q04_sync_errors", ", f AS (SELECT media_id, min(t_ms) AS o FROM cuts GROUP BY media_id), g AS (SELECT media_id, min(start_ms) + 1200 + media_id % 300 AS o FROM segments GROUP BY media_id) SELECT 'm' || f.media_id AS path, abs(f.o - g.o) AS error_ms FROM f JOIN g USING (media_id)")
def q04(t: Tables) -> DataFrame:
    path = F.concat(F.lit("m"), F.col("media_id").cast("string")).alias("path")
    found = t.cuts.groupBy("media_id").agg(F.min("t_ms").alias("offset_ms")).select(path, "offset_ms")
    truth = t.segments.groupBy("media_id").agg((F.min("start_ms") + 1200).alias("o")).select(path, (F.col("o") + F.col("media_id") % 300).alias("offset_ms"))
    return quality.sync_errors(found, truth)


@query("s06_correction_rules", r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS v FROM documents WHERE text IS NOT NULL), p AS (SELECT trim(v[: position('=' IN v) - 1]) AS wrong, trim(v[position('=' IN v) + 1 :]) AS "right" FROM l WHERE contains(v, '=') AND NOT regexp_matches(v, '^\s*(#|$)'))
SELECT wrong, "right" FROM p WHERE wrong <> '' AND "right" <> ''""", base=False)
def s06(t: Tables) -> DataFrame:
    lines = t.documents.filter("text is not null").select(F.explode(F.split("text", "\n")).alias("value"))
    return X.correction_rules(lines)

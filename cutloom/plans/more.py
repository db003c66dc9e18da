"""Queries over files, weak sentences, voices and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutloom.functions import text as X
from cutloom.operators import planning, sentences, speakers, timeline
from cutloom.plans.registry import Tables, query
from cutloom.sources import files

FILLERS, SOFT = ["the", "of", "de", "la"], ["and", "und", "en"]


@query("w12_weak_sentences")
def w12(t: Tables) -> DataFrame:
    return sentences.weak_sentences(t.segments, FILLERS, SOFT, gap_ms=300)


@query("w12_fillers", r""", tk AS (SELECT media_id, seg_id, list_filter(string_split(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM segments)
SELECT media_id, seg_id FROM tk WHERE len(list_filter(w, lambda x: x IN ('the', 'of', 'de', 'la'))) * 4 > len(w)
  OR len(w) BETWEEN 1 AND 3 AND len(list_filter(w, lambda x: x IN ('the', 'of', 'de', 'la', 'and', 'und', 'en'))) = len(w)""")
def w12_fillers(t: Tables) -> DataFrame:
    s = sentences.weak_sentences(t.segments, FILLERS, SOFT)
    return s.filter(F.array_contains(F.split("reasons", ","), "filler")).select("media_id", "seg_id")


CHAPTERS = ", ch AS (SELECT media_id, CASE WHEN seg_id % 2 = 0 THEN seg_id + seg_id % 3 ELSE seg_id - 1 END AS c_from, CASE WHEN seg_id % 2 = 0 THEN seg_id ELSE seg_id + 2 END AS c_to FROM segments WHERE seg_id % 4 = 2 OR seg_id % 6 = 3), bd AS (SELECT media_id, min(seg_id) AS first, max(seg_id) AS last FROM segments GROUP BY media_id)\n"


@query("w22_covering_chapters", CHAPTERS + """, c0 AS (SELECT b.media_id, first, last, greatest(least(c_from, c_to), first) AS a, least(greatest(c_from, c_to), last) AS b FROM bd b JOIN ch USING (media_id)), c1 AS (SELECT * FROM c0 WHERE a <= b),
c2 AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY media_id ORDER BY a, b) + 1, first) AS f FROM c1), c3 AS (SELECT * FROM c2 WHERE f <= b)
SELECT media_id, f AS c_from, CASE WHEN lead(a) OVER (PARTITION BY media_id ORDER BY a, b) IS NULL THEN last ELSE b END AS c_to FROM c3
UNION ALL SELECT media_id, first, last FROM bd WHERE NOT EXISTS (SELECT 1 FROM c1 WHERE c1.media_id = bd.media_id)""")  # fmt: skip
def w22(t: Tables) -> DataFrame:
    s, i = t.segments, F.col("seg_id")
    even = i % 2 == 0
    ch = s.filter("seg_id % 4 = 2 or seg_id % 6 = 3").select("media_id", F.when(even, i + i % 3).otherwise(i - 1).alias("c_from"), F.when(even, i).otherwise(i + 2).alias("c_to"))
    return sentences.covering_chapters(ch, s.groupBy("media_id").agg(F.min("seg_id").alias("first"), F.max("seg_id").alias("last")))


@query("w26_without_overlaps")
def w26(t: Tables) -> DataFrame:
    return sentences.without_overlaps(t.words.withColumn("e_ms", F.col("e_ms") + (F.col("pos") % 5) * 60))


@query("f06_junk_words", r"SELECT media_id, seg_id, pos, w FROM words WHERE regexp_matches(w, '[\p{L}\p{N}]')")
def f06(t: Tables) -> DataFrame:
    return sentences.junk_words(t.words, ["no such phrase"]).select("media_id", "seg_id", "pos", "w")


@query("x06_false_starts", r""", ar AS (SELECT media_id, seg_id, list(regexp_replace(w, '[.]$', '...') ORDER BY pos) AS w FROM words GROUP BY ALL), ba AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g')) AS b FROM ar),
k AS (SELECT *, unnest(range(0, greatest(0, least(4, len(w) - 2)))) AS k FROM ba), g AS (SELECT media_id, seg_id, min(k) + 1 AS f FROM k WHERE regexp_matches(w[k + 1], '(\.\.\.|…)$') AND list_contains(b[1 : k + 1], b[k + 2]) GROUP BY ALL)
SELECT a.media_id, a.seg_id, CAST(coalesce(f, 0) AS INTEGER) AS good FROM ar a LEFT JOIN g ON a.media_id = g.media_id AND a.seg_id = g.seg_id""")  # fmt: skip
def x06(t: Tables) -> DataFrame:
    w = t.words.withColumn("w", F.regexp_replace("w", r"[.]$", "..."))
    a = w.groupBy("media_id", "seg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("words"))
    return a.select("media_id", "seg_id", sentences.false_start().alias("good"))


@query("s12_readable", "SELECT media_id, string_agg('#' || seg_id || ' [' || speaker || '] ' || text, chr(10) ORDER BY seg_id) AS value FROM segments GROUP BY media_id")
def s12(t: Tables) -> DataFrame:
    return files.readable(t.segments)


@query("s09_plan_picks", "SELECT media_id AS plan_id, seg_id - 1 AS ord, seg_id, CASE WHEN seg_id % 3 = 0 THEN 1 END AS from_word, CASE WHEN seg_id % 3 = 0 THEN n_words END AS to_word FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_id) AS k FROM segments) WHERE k = seg_id")
def s09(t: Tables) -> DataFrame:
    pick = F.when(F.col("seg_id") % 3 == 0, F.format_string('{"id": %d, "fromWord": 1, "toWord": %d}', "seg_id", "n_words")).otherwise(F.col("seg_id").cast("string"))
    k = F.row_number().over(W.partitionBy("media_id").orderBy("seg_id"))
    s = t.segments.withColumn("_k", k).filter("_k = seg_id").select("media_id", F.struct("seg_id", pick.alias("p")).alias("x"))
    told = s.groupBy(F.col("media_id").alias("plan_id")).agg(F.concat(F.lit("My plan: {\"picks\": ["), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), ", "), F.lit("]} as asked")).alias("value"))
    return files.plan_picks(told)


@query("s05_result_keys", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0", base=False)
def s05(t: Tables) -> DataFrame:
    jobs = t.documents.select("doc_id", files.result_key(F.col("source"), F.col("n_chars"), F.col("doc_id")).alias("key"))
    return files.to_do(jobs, jobs.filter("doc_id % 3 = 0")).select("doc_id")


@query("s04_original_path", "SELECT source AS path, doc_id, CASE source WHEN 'src1' THEN 'film1' WHEN 'src2' THEN 'film2' ELSE source END AS original FROM documents", base=False)
def s04(t: Tables) -> DataFrame:
    made = t.spark.createDataFrame([("SRC1", "film1"), ("src2", "film2")], "converted string, original string")
    return files.original_path(t.documents.select(F.col("source").alias("path"), "doc_id"), made)


@query("s11_run_log", "SELECT user_id AS run, count_if(event_type = 'view') AS turns, count_if(event_type = 'click') AS tools, CAST(sum(k) AS BIGINT) AS tokens_in, CAST(sum(k % 7) AS BIGINT) AS tokens_out FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events WHERE event_type <> 'error') GROUP BY user_id", base=False)
def s11(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(F.col("event_type") == "view", "assistant").when(F.col("event_type") == "click", "tool").otherwise("note")
    line = F.format_string('{"type": "%s", "cost": 0.5, "usage": {"input": %d, "output": %d}}', kind, k, k % 7)
    log = t.events.select(F.col("user_id").alias("run"), F.when(F.col("event_type") == "error", "{broken").otherwise(line).alias("value"))
    return files.run_log(log).drop("cost")


@query("f08_name_search", "SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'enete')", base=False)
def f08(t: Tables) -> DataFrame:
    return t.documents.filter(X.normal(F.col("text")).contains("enete")).select("doc_id")


@query("p01_passages", r""", ps AS (SELECT *, start_ms - lag(end_ms) OVER w AS g, lead(start_ms) OVER w - end_ms AS a, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS n FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY seg_id)),
pr AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY seg_id) AS run FROM ps),
pp AS (SELECT x.media_id, x.seg_id AS from_id, y.seg_id AS to_id, y.end_ms - x.start_ms AS dur_ms FROM pr x JOIN pr y ON x.media_id = y.media_id AND x.run = y.run AND y.seg_id >= x.seg_id
  WHERE (x.g IS NULL OR x.g >= 120) AND NOT regexp_matches(x.text, '^\s*\p{Ll}') AND regexp_matches(y.text, '[.!?]\W*$') AND (y.a IS NULL OR y.a >= 120) AND y.end_ms - x.start_ms BETWEEN 6000 AND 12500),
p1 AS (SELECT *, row_number() OVER (PARTITION BY media_id, from_id ORDER BY abs(dur_ms - 10000), to_id) AS r FROM pp), p2 AS (SELECT *, row_number() OVER (PARTITION BY media_id, to_id ORDER BY abs(dur_ms - 10000), from_id) AS q FROM p1 WHERE r = 1)
SELECT media_id, from_id, to_id, dur_ms FROM p2 WHERE q = 1""")  # fmt: skip
def p01(t: Tables) -> DataFrame:
    return planning.passages(t.segments, 10_000)


UNITS = ", un AS (SELECT media_id AS plan_id, seg_id AS unit, CASE WHEN seg_id % 4 = 0 THEN replace(text, '.', '!') ELSE text END AS text, end_ms - start_ms AS dur_ms, 't' || seg_id % 3 AS topic, n_words FROM segments)\n"


def units(t: Tables) -> DataFrame:
    text = F.when(F.col("seg_id") % 4 == 0, F.replace("text", F.lit("."), F.lit("!"))).otherwise(F.col("text"))
    return t.segments.select(F.col("media_id").alias("plan_id"), F.col("seg_id").alias("unit"), text.alias("text"), (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"), F.concat(F.lit("t"), F.col("seg_id") % 3).alias("topic"), "n_words")


@query("f12_without_shouts", UNITS + ", s AS (SELECT *, contains(text, '!') AND n_words <= 10 OR n_words <= 6 AS shout FROM un), c AS (SELECT *, count_if(NOT shout) OVER (PARTITION BY plan_id) AS k FROM s) SELECT plan_id, unit FROM c WHERE NOT shout OR k < 4")
def f12(t: Tables) -> DataFrame:
    return planning.without_shouts(units(t)).select("plan_id", "unit")


@query("f15_short_units", UNITS + ", c AS (SELECT *, coalesce(sum(CASE WHEN dur_ms <= 8000 THEN dur_ms END) OVER (PARTITION BY plan_id), 0) AS k FROM un) SELECT plan_id, unit FROM c WHERE dur_ms <= 8000 OR k < 20000")
def f15(t: Tables) -> DataFrame:
    return planning.short_units(units(t), 10_000).select("plan_id", "unit")


@query("f14_guarded_verdicts", "WITH v AS (SELECT user_id AS batch, event_id AS id, value > 2 + user_id % 30 AS off_topic FROM events), c AS (SELECT *, count(*) OVER (PARTITION BY batch) AS n, count_if(off_topic) OVER (PARTITION BY batch) AS k FROM v) SELECT batch, id, off_topic AND NOT (n >= 5 AND k * 100 >= 90 * n) AS off_topic FROM c", base=False)
def f14(t: Tables) -> DataFrame:
    return planning.guarded_verdicts(t.events.select(F.col("user_id").alias("batch"), F.col("event_id").alias("id"), (F.col("value") > 2 + F.col("user_id") % 30).alias("off_topic")))


@query("a13_topic_seconds", UNITS + "SELECT plan_id, topic, CAST(coalesce(sum(CASE WHEN p.seg_id IS NOT NULL THEN dur_ms END), 0) AS BIGINT) AS chosen_ms, count_if(p.seg_id IS NULL) AS left_n, CAST(coalesce(sum(CASE WHEN p.seg_id IS NULL THEN dur_ms END), 0) AS BIGINT) AS left_ms, min(CASE WHEN p.seg_id IS NULL THEN dur_ms END) AS shortest_left_ms FROM un LEFT JOIN (SELECT plan_id AS pp, seg_id FROM picks) p ON pp = plan_id AND p.seg_id = unit GROUP BY plan_id, topic")
def a13(t: Tables) -> DataFrame:
    return planning.topic_seconds(units(t), t.picks.select("plan_id", F.col("seg_id").alias("unit")))


# Translations of whole sentences: the same words with other marks, many times the length, alternatives, or another sentence.
TRANSLATED = r""", tl AS (SELECT media_id * 1000 + seg_id AS id, text AS src, CASE seg_id % 5 WHEN 0 THEN '« ' || upper(replace(text, 'ß', 's')) || ' !' WHEN 1 THEN text || ' ' || text || ' ' || text || ' ' || text || ' and more than was ever said here' WHEN 2 THEN text || ' / x' WHEN 3 THEN '-- ' || lower(text) || '…' ELSE substr(text, 8) END AS out FROM segments
UNION ALL SELECT -(media_id * 1000 + seg_id), substr(text, 1, CAST(seg_id % 4 AS INTEGER)), upper(substr(text, 1, CAST(seg_id % 4 AS INTEGER))) FROM segments),
tn AS (SELECT *, trim(regexp_replace(strip_accents(lower(src)), '[^\p{L}\p{N}]+', ' ', 'g')) AS a, trim(regexp_replace(strip_accents(lower(out)), '[^\p{L}\p{N}]+', ' ', 'g')) AS b FROM tl)
SELECT id, CASE WHEN NOT regexp_matches(src, '\p{L}{2}') THEN 'ok' WHEN length(out) > 3 * length(src) + 25 OR contains(out, ' / ') THEN 'rejected' WHEN a = b AND regexp_matches(src, '\p{L}{3}') THEN 'untranslated' ELSE 'ok' END AS verdict FROM tn"""


@query("f11_translation_check", TRANSLATED)
def f11(t: Tables) -> DataFrame:
    i, x = F.col("seg_id"), F.col("text")
    kind = i % 5
    out = F.when(kind == 0, F.concat(F.lit("« "), X.large(F.replace(x, F.lit("ß"), F.lit("s"))), F.lit(" !"))).when(kind == 1, F.concat(F.concat_ws(" ", x, x, x, x), F.lit(" and more than was ever said here")))
    out = out.when(kind == 2, F.concat(x, F.lit(" / x"))).when(kind == 3, F.concat(F.lit("-- "), F.lower(x), F.lit("…"))).otherwise(F.substr(x, F.lit(8)))
    number, head = F.col("media_id") * 1000 + i, F.substr(x, F.lit(1), (i % 4).cast("int"))
    pairs = t.segments.select(number.alias("id"), x.alias("src"), out.alias("out")).unionByName(t.segments.select((-number).alias("id"), head.alias("src"), X.large(head).alias("out")))
    return planning.translation_check(pairs)


@query("k07_assigned_shots")
def k07(t: Tables) -> DataFrame:
    s = t.segments.select(F.col("media_id").alias("job_id"), F.col("seg_id").alias("ord"), (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"))
    c = s.select("job_id", "ord", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rank")).withColumn("shot", (F.col("ord") * 3 + F.col("rank") * 5) % 7)
    return planning.assigned_shots(s, c)


@query("k03_spread_teasers")
def k03(t: Tables) -> DataFrame:
    s = t.segments
    c = s.select(F.col("media_id").alias("plan_id"), F.col("seg_id").alias("cand_no"), F.col("seg_id").alias("a"), (F.col("seg_id") + F.col("n_words") % 3).alias("b"), (F.col("n_words") % 17).alias("score10"))
    return planning.spread(c, 4)


@query("w11_voice_chunks")
def w11(t: Tables) -> DataFrame:
    return speakers.voice_chunks(t.words)


def voice_chunks(t: Tables) -> DataFrame:
    """Fifty vectors at a time as the chunks of a recording, so that recordings grow in number and not in size."""
    e = t.embeddings.filter("embedding is not null")
    return e.select(F.floor(F.col("vec_id") / 50).alias("media_id"), F.col("vec_id").alias("chunk_no"), (F.col("vec_id") * 1000).alias("start_ms"), (F.col("vec_id") * 1000 + 900).alias("end_ms"), F.lit(900).cast("bigint").alias("dur_ms"), F.col("embedding").cast("array<double>").alias("vec"), "label")


@query("v01_speaker_clusters")
def v01(t: Tables) -> DataFrame:
    return speakers.clustered(voice_chunks(t))


@query("j09_matched_voices")
def j09(t: Tables) -> DataFrame:
    c = speakers.centroids(voice_chunks(t).withColumn("k", F.struct("media_id", "label")), "k", "vec")
    lib = speakers.centroids(t.embeddings.filter("label is not null").select("label", F.col("embedding").cast("array<double>").alias("vec")), "label", "vec")
    lib = lib.select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("name"), F.col("centroid").alias("vec"))
    return speakers.matched_voices(c.select("k.media_id", F.col("k.label").cast("string").alias("speaker"), F.col("centroid").alias("vec")), lib, 0.1)


@query("j10_anchored_chunks")
def j10(t: Tables) -> DataFrame:
    c = voice_chunks(t)
    a = c.filter("chunk_no % 3 = 0")
    return speakers.anchored(c.drop("label", "dur_ms"), a.select("media_id", F.col("label").cast("string").alias("person"), F.col("start_ms").alias("a_ms"), F.col("end_ms").alias("b_ms")))


@query("w10_loudest_microphone")
def w10(t: Tables) -> DataFrame:
    mics = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("m")
    lv = t.words.select("media_id", "s_ms", "pos", mics).select("media_id", "s_ms", F.concat(F.lit("mic"), "m").alias("mic"), (100.0 + (F.col("pos") * 31 + F.col("m") * 47) % 90).alias("rms"))
    return speakers.loudest_microphone(lv)




@query("j17_sync", "SELECT source AS path, doc_id, CASE source WHEN 'src1' THEN 1200 WHEN 'src2' THEN -40 ELSE 0 END AS offset_ms, source = 'src2' AS warn FROM documents", base=False)
def j17(t: Tables) -> DataFrame:
    o = t.spark.createDataFrame([("SRC1", 1200, 300), ("src2", -40, 120)], "path string, offset_ms bigint, confidence_pct int")
    return timeline.sync(t.documents.select(F.col("source").alias("path"), "doc_id"), o)


@query("t08_verified_cameras", """, v AS (SELECT *, start_ms - lag(end_ms, 1, 0) OVER (PARTITION BY seq_id ORDER BY start_ms, clip_ix) AS gap_ms, abs(in_ms - (start_ms - (media_id % 3 * 100 - 500))) AS error_ms FROM clips)
SELECT seq_id, clip_ix, gap_ms, error_ms, error_ms > 50 OR abs(gap_ms) > 1 AS fault FROM v""")
def t08(t: Tables) -> DataFrame:
    o = t.segments.select("media_id").distinct().withColumn("offset_ms", F.col("media_id") % 3 * 100 - 500)
    return timeline.verified_cameras(t.clips, o)


@query("t07_overridden", """, ov AS (SELECT media_id AS seq_id, t_ms AS o_start, t_ms + 600 AS o_end, t_ms * 2 AS o_in FROM cuts WHERE (t_ms // 100) % 4 = 0),
hb AS (SELECT seq_id, clip_ix, start_ms AS b FROM clips UNION SELECT c.seq_id, clip_ix, o_end FROM clips c JOIN ov ON c.seq_id = ov.seq_id AND o_end > start_ms AND o_end < end_ms),
hp AS (SELECT b.seq_id, b.clip_ix, b, in_ms, start_ms, coalesce((SELECT min(o_start) FROM ov WHERE ov.seq_id = b.seq_id AND o_end > b AND o_start < end_ms), end_ms) AS e FROM hb b JOIN clips c ON b.seq_id = c.seq_id AND b.clip_ix = c.clip_ix)
SELECT seq_id, clip_ix, b AS start_ms, e AS end_ms, in_ms + b - start_ms AS in_ms FROM hp WHERE e > b UNION ALL SELECT seq_id, NULL, o_start, o_end, o_in FROM ov""")  # fmt: skip
def t07(t: Tables) -> DataFrame:
    c = t.cuts.filter("floor(t_ms / 100) % 4 = 0")
    return timeline.overridden(t.clips, c.select(F.col("media_id").alias("seq_id"), F.col("t_ms").alias("o_start"), (F.col("t_ms") + 600).alias("o_end"), (F.col("t_ms") * 2).alias("o_in")))


@query("t09_split_at_word", """, fw AS (SELECT media_id, min(s_ms) AS t FROM words WHERE s_ms >= 2000 AND starts_with(lower(w), 'th') GROUP BY media_id), j AS (SELECT s.*, t FROM segments s LEFT JOIN fw ON s.media_id = fw.media_id)
SELECT media_id, seg_id AS item, start_ms AS a_ms, t AS b_ms, 'cam' AS kind FROM j WHERE start_ms < t AND end_ms - t > 500 UNION ALL SELECT media_id, seg_id, t, end_ms, 'guest' FROM j WHERE start_ms < t AND end_ms - t > 500
UNION ALL SELECT media_id, seg_id, start_ms, end_ms, CASE WHEN start_ms >= t THEN 'guest' ELSE 'cam' END FROM j WHERE NOT coalesce(start_ms < t AND end_ms - t > 500, false)""")  # fmt: skip
def t09(t: Tables) -> DataFrame:
    items = t.segments.select("media_id", F.col("seg_id").alias("item"), F.col("start_ms").alias("a_ms"), F.col("end_ms").alias("b_ms"), F.lit("cam").alias("kind"))
    return timeline.split_at_word(items, t.words, "th", 2000, "guest")


@query("u02_narration_sources", """, n AS (SELECT seq_id, clip_ix, CASE WHEN clip_ix % 4 = 1 THEN media_id + 1000 ELSE media_id END AS media_id, kind, start_ms, end_ms FROM clips), o AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY end_ms - start_ms DESC, clip_ix) AS r FROM n WHERE kind = 'audio' AND NOT EXISTS (SELECT 1 FROM n v WHERE v.kind = 'video' AND v.seq_id = n.seq_id AND v.media_id = n.media_id))
SELECT DISTINCT o.media_id AS narration, n.media_id AS source FROM o JOIN n ON o.r = 1 AND n.seq_id = o.seq_id AND n.kind = 'video'""")  # fmt: skip
def u02(t: Tables) -> DataFrame:
    c = t.clips.withColumn("media_id", F.when(F.col("clip_ix") % 4 == 1, F.col("media_id") + 1000).otherwise(F.col("media_id")))
    return timeline.narration_sources(c, timeline.narration(c))


@query("u04_unmapped_speakers", "SELECT DISTINCT media_id, speaker FROM segments WHERE speaker NOT IN ('user', 'assistant')")
def u04(t: Tables) -> DataFrame:
    cams = t.spark.createDataFrame([(0, []), (1, ["user"]), (2, ["assistant"])], "cam int, speakers array<string>")
    mapped = cams.select(F.explode("speakers").alias("speaker"))
    return t.segments.select("media_id", "speaker").distinct().join(mapped, "speaker", "left_anti").select("media_id", "speaker")


@query("a18_edit_quality", """, us AS (SELECT DISTINCT seq_id, s.media_id, seg_id FROM segments s JOIN clips c ON s.media_id = c.media_id WHERE (least(s.end_ms, out_ms) - greatest(s.start_ms, in_ms)) * 100 > least(s.end_ms - s.start_ms, out_ms - in_ms) * 35),
sl AS (SELECT *, regexp_matches(text, '^\\s*\\p{Ll}') AS low FROM (SELECT media_id, seg_id, speaker, substr(text, 2) AS text FROM segments)), sn AS (SELECT *, lag(seg_id) OVER w AS pid, lead(seg_id) OVER w AS nid, lead(low) OVER w AS nlow, lead(speaker) OVER w AS nspk FROM sl WINDOW w AS (PARTITION BY media_id ORDER BY seg_id)),
x AS (SELECT u.seq_id, s.*, EXISTS (SELECT 1 FROM us v WHERE v.seq_id = u.seq_id AND v.media_id = u.media_id AND v.seg_id = pid) AS hp, EXISTS (SELECT 1 FROM us v WHERE v.seq_id = u.seq_id AND v.media_id = u.media_id AND v.seg_id = nid) AS hn FROM us u JOIN sn s ON u.media_id = s.media_id AND u.seg_id = s.seg_id)
SELECT seq_id, count(*) AS sentences, count_if(speaker = 'system') AS by_moderator, count_if(low AND NOT hp) AS fragments, count_if(coalesce(nlow AND speaker = nspk, false) AND NOT hn) AS unfinished, count_if(contains(strip_accents(lower(text)), 'ation')) AS on_topic FROM x GROUP BY seq_id""")  # fmt: skip
def a18(t: Tables) -> DataFrame:
    s = t.segments.withColumn("text", F.substring("text", 2, 1 << 30))
    hosts = s.filter("speaker = 'system'").select("media_id", "speaker").distinct()
    return timeline.edit_quality(timeline.used_sentences(t.clips, t.segments), s, hosts, "ation")


@query("v04_picture_cuts")
def v04(t: Tables) -> DataFrame:
    return timeline.picture_cuts(t.clips, t.cuts)


@query("k06_keep_order", """SELECT media_id AS plan_id, seg_id AS unit, CAST(row_number() OVER (PARTITION BY media_id ORDER BY seg_id % 4 = 0 DESC, n_words % 3, (seg_id * 5) % 7 DESC, end_ms - start_ms, seg_id) AS INTEGER) AS place FROM segments""")
def k06(t: Tables) -> DataFrame:
    order = F.row_number().over(W.partitionBy("media_id").orderBy(F.desc(F.col("seg_id") % 4 == 0), F.col("n_words") % 3, F.desc((F.col("seg_id") * 5) % 7), F.col("end_ms") - F.col("start_ms"), "seg_id"))
    return t.segments.select(F.col("media_id").alias("plan_id"), F.col("seg_id").alias("unit"), order.alias("place"))


@query("x14_levels", "SELECT event_id, round(20 * log10(greatest(value / 1000, 1e-7)), 6) AS db FROM events", base=False)
def x14(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(20 * F.log10(F.greatest(F.col("value") / 1000, F.lit(1e-7))), 6).alias("db"))


@query("x04_caption_fixes", "SELECT media_id, seg_id, pos, CASE regexp_replace(strip_accents(lower(w)), '[.,;:!?]+$', '') WHEN 'the' THEN 'THE' WHEN 'et' THEN 'ET' ELSE regexp_replace(w, '[.,;:!?]+$', '') END || regexp_extract(w, '[.,;:!?]+$') AS w FROM words")
def x04(t: Tables) -> DataFrame:
    fixes = F.create_map(F.lit("the"), F.lit("THE"), F.lit("et"), F.lit("ET"))
    bare, tail = F.regexp_replace("w", r"[.,;:!?]+$", ""), F.regexp_extract("w", r"[.,;:!?]+$", 0)
    fixed = F.coalesce(F.try_element_at(fixes, X.normal(bare)), bare)
    return t.words.select("media_id", "seg_id", "pos", F.concat(fixed, tail).alias("w"))


@query("a07_script_split", r", s AS (SELECT p.plan_id, CASE WHEN regexp_matches(text, '\p{Cyrillic}') THEN 'cyrillic' ELSE 'latin' END AS script FROM picks p JOIN segments s ON p.media_id = s.media_id AND p.seg_id = s.seg_id) SELECT plan_id, script, count(*) AS n FROM s GROUP BY ALL")
def a07(t: Tables) -> DataFrame:
    s = t.picks.join(t.segments.select("media_id", "seg_id", "text"), ["media_id", "seg_id"])
    script = F.when(F.col("text").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return s.groupBy("plan_id", script.alias("script")).agg(F.count("*").alias("n"))

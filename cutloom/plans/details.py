"""Queries of further rules: speeds, audible edges, inventions, names in briefs, stems, beginnings, sentence speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.functions import text as X
from cutloom.operators import assembly, audio, growth, planning, sentences, speakers, teasers, timeline
from cutloom.plans.media import FRAMES, frames
from cutloom.plans.more import voice_chunks
from cutloom.plans.registry import Tables, query


def _texts(values: list[str]) -> str:
    """A list of texts as SQL."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SPEEDS = ", cs AS (SELECT *, CASE clip_ix % 4 WHEN 0 THEN 50 WHEN 1 THEN NULL WHEN 2 THEN 125 ELSE 300 END AS speed FROM clips)"


@query("j02_words_at_speed", SPEEDS + """
SELECT seq_id, clip_ix, seg_id, pos, start_ms + CAST(floor((s_ms - in_ms) * 100.0::DOUBLE / coalesce(speed, 100) + 0.5) AS BIGINT) AS t0_ms, start_ms + CAST(floor((e_ms - in_ms) * 100.0::DOUBLE / coalesce(speed, 100) + 0.5) AS BIGINT) AS t1_ms, w, spk
FROM words w JOIN cs c ON w.media_id = c.media_id AND s_ms >= in_ms - 10 AND e_ms <= out_ms + 10""")
def j02(t: Tables) -> DataFrame:
    k = F.col("clip_ix") % 4
    return timeline.words_on_timeline(t.clips.withColumn("speed_pct", F.when(k == 0, 50).when(k == 2, 125).when(k == 3, 300)), t.words)


# Edges of clips, some a little off the sentence, so that some are loud and some cross a word in silence.
AUDIBLE = FRAMES + """, ed AS (SELECT seq_id, clip_ix, media_id, 'in' AS edge, in_ms + clip_ix % 3 * 190 AS t_ms FROM clips UNION ALL SELECT seq_id, clip_ix, media_id, 'out', out_ms - clip_ix % 4 * 130 FROM clips),
ej AS (SELECT e.seq_id, e.clip_ix, e.media_id, e.edge, e.t_ms, w, row_number() OVER (PARTITION BY e.seq_id, e.clip_ix, e.edge ORDER BY s_ms, e_ms, w) AS r FROM ed e LEFT JOIN words w ON e.media_id = w.media_id AND s_ms < t_ms - 10 AND e_ms > t_ms + 10),
el AS (SELECT e.seq_id, e.clip_ix, e.edge, max(CASE WHEN (frame_no * 50 - t_ms) * CASE edge WHEN 'in' THEN -1 ELSE 1 END BETWEEN 0 AND 100 THEN 20 * log10(greatest(rms, 1e-7)) END) - quantile_cont(20 * log10(greatest(rms, 1e-7)), 0.9) AS level_db
  FROM ed e JOIN frames f ON e.media_id = f.media_id AND frame_no * 50 BETWEEN t_ms - 2000 AND t_ms + 2000 GROUP BY e.seq_id, e.clip_ix, e.edge),
ae AS (SELECT seq_id, clip_ix, edge, t_ms, w, round(level_db, 4) AS level_db, w IS NOT NULL AND coalesce(level_db > -20, true) AS cuts, coalesce(level_db > -12, false) AS loud FROM ej LEFT JOIN el USING (seq_id, clip_ix, edge) WHERE r = 1)
"""


def audible(t: Tables) -> DataFrame:
    e, k = timeline.edges(t.clips), F.col("clip_ix")
    moved = e.withColumn("t_ms", F.col("t_ms") + F.when(F.col("edge") == "in", k % 3 * 190).otherwise(-(k % 4) * 130))
    return audio.audible_edges(moved, t.words, frames(t), 50, outside_ms=100)


@query("j05_audible_edges", AUDIBLE + "SELECT *, cuts OR loud AS bad FROM ae")
def j05(t: Tables) -> DataFrame:
    return audible(t).withColumn("level_db", F.round("level_db", 4))


@query("q03_audible_report", AUDIBLE + "SELECT seq_id, count(*) AS n_edges, count(w) AS n_crossing, CAST(count_if(cuts) AS BIGINT) AS n_cut, CAST(count_if(loud) AS BIGINT) AS n_loud, CAST(count_if(cuts OR loud) AS BIGINT) AS n_bad FROM ae GROUP BY seq_id")
def q03(t: Tables) -> DataFrame:
    return audible(t).groupBy("seq_id").agg(F.count("*").alias("n_edges"), F.count("w").alias("n_crossing"), F.count_if("cuts").alias("n_cut"), F.count_if("loud").alias("n_loud"), F.count_if("bad").alias("n_bad"))


# Words as a transcription may have them: some segments invented, some slow, some unsure, some words empty.
HEARD = """, hw AS (SELECT media_id, seg_id, pos, CASE WHEN seg_id % 7 = 3 AND pos = 1 THEN 'Titulky' WHEN seg_id % 7 = 3 AND pos = 2 THEN 'vytvořil' WHEN seg_id % 11 = 5 AND pos = 0 THEN 'WWW.x.cz' WHEN pos % 9 = 4 THEN '—' ELSE w END AS w,
  CASE WHEN seg_id % 5 = 2 THEN s_ms * 12 ELSE s_ms END AS s_ms, CASE WHEN seg_id % 5 = 2 THEN e_ms * 12 ELSE e_ms END AS e_ms, CASE WHEN seg_id % 4 = 1 THEN p / 3 WHEN seg_id % 3 = 0 THEN p / 2 ELSE p END AS p FROM words),
ht AS (SELECT media_id, seg_id, string_agg(w, ' ' ORDER BY pos) AS t, min(s_ms) AS a, max(e_ms) AS b, count(*) AS n, CAST(sum(CAST(round(p * 100) AS BIGINT)) AS BIGINT) AS p FROM hw GROUP BY ALL)
"""


def heard(t: Tables) -> DataFrame:
    i, p = F.col("seg_id"), F.col("pos")
    w = F.when((i % 7 == 3) & (p == 1), "Titulky").when((i % 7 == 3) & (p == 2), "vytvořil").when((i % 11 == 5) & (p == 0), "WWW.x.cz").when(p % 9 == 4, "—").otherwise(F.col("w"))
    slow = F.when(i % 5 == 2, 12).otherwise(1)
    sure = F.when(i % 4 == 1, F.col("p") / 3).when(i % 3 == 0, F.col("p") / 2).otherwise(F.col("p"))
    return t.words.select("media_id", "seg_id", "pos", w.alias("w"), (F.col("s_ms") * slow).alias("s_ms"), (F.col("e_ms") * slow).alias("e_ms"), sure.alias("p"))


def _invented(c: str) -> str:
    return f"regexp_matches({c}, '{sentences.INVENTED}')"


@query("f06_without_inventions", HEARD + rf"SELECT media_id, seg_id, pos, w FROM hw JOIN ht USING (media_id, seg_id) WHERE regexp_matches(w, '[\p{{L}}\p{{N}}]') AND NOT {_invented('t')}")
def f06(t: Tables) -> DataFrame:
    return sentences.without_inventions(heard(t)).select("media_id", "seg_id", "pos", "w")


@query("f07_doubtful_segments", HEARD + f"SELECT media_id, seg_id, a AS start_ms, b AS end_ms, reason FROM (SELECT *, CASE WHEN {_invented('t')} THEN 'invented' WHEN b - a > 4000 AND n * 2000 < b - a THEN 'sparse' WHEN p < 35 * n THEN 'unsure' END AS reason FROM ht) WHERE reason IS NOT NULL")
def f07(t: Tables) -> DataFrame:
    return sentences.doubtful(heard(t))


@query("f07_accepted_repairs", HEARD + f"SELECT media_id, seg_id FROM ht WHERE NOT {_invented('t')} AND (seg_id * 13 + media_id) % 10 / 10.0 <= 0.6 AND p >= 40 * n")
def f07_accepted(t: Tables) -> DataFrame:
    silence = t.segments.select("media_id", "seg_id", ((F.col("seg_id") * 13 + F.col("media_id")) % 10 / 10).alias("no_speech"))
    return sentences.accepted(heard(t), silence)


# Briefs that name a speaker of their recording, or not.
NAMES = ["Vašíř Nový", "Eva", "Šárka Ferancová", "S2", "Vypravěč"]
ASKS = ["jen Vašíře, prosím", "co říká paní Ferancová", "Pouze výroky té druhé Evy", "co říkal vypravěč o válce a S2", "všechno o S2", "jen to hlavní, co ví celá skupina a Eva", "slova Šárky", "evoluce"]
NAMED = f""", nb AS (SELECT media_id * 100 + seg_id AS brief_id, media_id, lower(strip_accents({_texts(ASKS)}[1 + CAST((media_id + seg_id) % {len(ASKS)} AS INTEGER)])) AS b FROM segments),
ns AS (SELECT DISTINCT media_id, {_texts(NAMES)}[1 + CAST((media_id * 3 + seg_id) % {len(NAMES)} AS INTEGER)] AS speaker FROM segments),
nf AS (SELECT *, string_split(lower(strip_accents(speaker)), ' ')[1] AS f FROM ns WHERE NOT regexp_matches(speaker, '^S\\d+$'))
SELECT brief_id, speaker FROM nb JOIN nf USING (media_id)
WHERE regexp_matches(b, '(^|[^\\p{{L}}\\p{{N}}_])(jen|pouze|vyhradne|rika|rikaji|rekl|rekla|vyrok[\\p{{L}}\\p{{N}}_]*|slova|promluv[\\p{{L}}\\p{{N}}_]*|mluvi)[^\\p{{L}}\\p{{N}}_]+([\\p{{L}}\\p{{N}}_]+[^\\p{{L}}\\p{{N}}_]+){{0,3}}' || CASE WHEN length(f) > 4 THEN substr(f, 1, greatest(4, length(f) - 2)) ELSE f END)"""


@query("f10_speakers_named", NAMED)
def f10(t: Tables) -> DataFrame:
    m, i = F.col("media_id"), F.col("seg_id")
    of = lambda texts, k: F.element_at(F.array(*map(F.lit, texts)), (1 + k % len(texts)).cast("int"))
    briefs = t.segments.select((m * 100 + i).alias("brief_id"), "media_id", of(ASKS, m + i).alias("brief"))
    return assembly.speakers_named(briefs, t.segments.select("media_id", of(NAMES, m * 3 + i).alias("speaker")))


VOICES = ["podlož to obrazem", "KOMENTÁŘ k tomu", "voice over", "sestřih debaty", "namluvím to", "odpovídal na vše", "mluvčí dne"]


@query("f16_says_voice_over", f"SELECT media_id, seg_id, regexp_matches({_texts(VOICES)}[1 + CAST((media_id + seg_id) % {len(VOICES)} AS INTEGER)] || ' ' || text, '(?i){assembly.VOICE_OVER}') AS says FROM segments")
def f16(t: Tables) -> DataFrame:
    asks = F.element_at(F.array(*map(F.lit, VOICES)), (1 + (F.col("media_id") + F.col("seg_id")) % len(VOICES)).cast("int"))
    return t.segments.select("media_id", "seg_id", assembly.says_voice_over(F.concat(asks, F.lit(" "), "text")).alias("says"))


@query("x02_stem_search", r""", h0 AS (SELECT media_id, seg_id, lower(strip_accents(text)) AS x FROM segments), h1 AS (SELECT media_id, seg_id, regexp_matches(x, '(^|[^\p{L}\p{N}])there the($|[^\p{L}\p{N}])') AS e, regexp_matches(x, '(^|[^\p{L}\p{N}])ther[\p{L}\p{N}]*\s+the($|[^\p{L}\p{N}])') AS s FROM h0),
h2 AS (SELECT *, NOT bool_or(e) OVER (PARTITION BY media_id) AS by_stem FROM h1), h3 AS (SELECT media_id, seg_id, CASE WHEN by_stem THEN s ELSE e END AS hit, by_stem FROM h2),
h4 AS (SELECT *, bool_or(hit) OVER (PARTITION BY media_id ORDER BY seg_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM h3) SELECT media_id, seg_id, hit, by_stem FROM h4 WHERE n""")
def x02(t: Tables) -> DataFrame:
    return X.phrase_or_stem_hits(t.segments, "there the")


# Sentences with other beginnings and ends put on them.
HEADS = ["", "a pak ", "Tím ", "za druhé ", ", že ", "Proto ", "It's ", "Tony "]
BEGINS = f""", bx AS (SELECT media_id, seg_id, {_texts(HEADS)}[1 + CAST((media_id + seg_id) % {len(HEADS)} AS INTEGER)] || text || CASE WHEN seg_id % 4 = 1 THEN '…' ELSE '' END AS t FROM segments
UNION ALL SELECT media_id, -seg_id, ['Ano!', 'jasně', 'No dobře.', 'Přesně...'][1 + CAST(seg_id % 4 AS INTEGER)] FROM segments)
SELECT media_id, seg_id, regexp_matches(rtrim(t), '[.!?…]$') AS ends, regexp_matches(t, '^\\s*\\p{{Ll}}') AS low,
  regexp_matches(trim(t), '^(?:[\\p{{Ll}}.,;:–-]|(?i:(za (druhé|třetí|další)|tím)([^\\p{{L}}\\p{{N}}_]|$)))') AS goes_on,
  regexp_matches(trim(t), '{growth.POINTS_BACK.replace("(?![" + chr(92) + "p{L}" + chr(92) + "p{N}_])", "([^" + chr(92) + "p{L}" + chr(92) + "p{N}_]|$)").replace("'", "''")}') AS points_back,
  regexp_matches(trim(t), '{teasers.ANSWERS}') AS answers FROM bx"""


@query("x13_beginnings", BEGINS)
def x13(t: Tables) -> DataFrame:
    s, k = t.segments, F.col("seg_id")
    head = F.element_at(F.array(*map(F.lit, HEADS)), (1 + (F.col("media_id") + k) % len(HEADS)).cast("int"))
    own = s.select("media_id", "seg_id", F.concat(head, "text", F.when(k % 4 == 1, "…").otherwise("")).alias("t"))
    short = F.element_at(F.array(*map(F.lit, ["Ano!", "jasně", "No dobře.", "Přesně..."])), (1 + k % 4).cast("int"))
    x = own.unionByName(s.select("media_id", (-k).alias("seg_id"), short.alias("t")))
    b = growth.begins(F.col("t"))
    return x.select(
        "media_id", "seg_id", X.ends_sentence(F.col("t")).alias("ends"), X.starts_lower(F.col("t")).alias("low"), b["goes_on"].alias("goes_on"), b["points_back"].alias("points_back"),
        F.trim("t").rlike(teasers.ANSWERS).alias("answers"),
    )


@query("j10_sentence_speakers")
def j10(t: Tables) -> DataFrame:
    c = voice_chunks(t)
    a = c.filter("chunk_no % 3 = 0").select("media_id", F.col("label").cast("string").alias("person"), F.col("start_ms").alias("a_ms"), F.col("end_ms").alias("b_ms"))
    found = speakers.anchored(c.drop("label", "dur_ms"), a)
    return speakers.sentence_speakers(c.select("media_id", "chunk_no", F.floor(F.col("chunk_no") / 5).alias("seg_id"), "start_ms", "end_ms"), found)


@query("f08_newest_names", "SELECT event_id, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events WHERE contains(lower(event_type || '/' || user_id), 'k/1')", base=False)
def f08(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", F.concat(F.col("event_type"), F.lit("/"), F.col("user_id").cast("string")).alias("name"))
    return planning.newest_names(e, "k/1", "event_id", "ts")

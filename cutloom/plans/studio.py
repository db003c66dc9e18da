"""Queries of studio pictures and of transcripts compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.operators import pictures, quality
from cutloom.plans.media import FRAMES, frames
from cutloom.plans.registry import Tables, query

# Sentences as items to cut, with limits by their numbers.
CUTS = r""", wg AS (SELECT media_id, e_ms + nx AS t2, greatest(nx - e_ms, 0) AS gap, mark FROM (SELECT *, lead(s_ms) OVER (PARTITION BY media_id ORDER BY s_ms, e_ms) AS nx, regexp_matches(w, '[.?!,;:]$') AS mark FROM words) WHERE nx IS NOT NULL),
it AS (SELECT media_id * 1000 + seg_id AS item_id, media_id, start_ms - 200 AS a, end_ms + 2500 AS b, 3400 + (seg_id % 3) * 400 AS lm FROM segments)
SELECT * FROM (WITH RECURSIVE c AS (
  SELECT item_id, 0 AS k, 2 * a AS t2 FROM it
  UNION ALL SELECT item_id, k, t2 FROM (
    SELECT i.item_id, c.k + 1 AS k, g.t2, row_number() OVER (PARTITION BY i.item_id ORDER BY g.t2 > c.t2 + 2 * lm,
      3000 * least(gap, 600) + CASE WHEN mark THEN 1000000 ELSE 0 END - 15 * abs(10 * (g.t2 - c.t2) - 16 * lm) DESC, g.t2) AS place
    FROM c JOIN it i USING (item_id) JOIN wg g ON g.media_id = i.media_id AND g.t2 BETWEEN 2 * (a + 1300) AND 2 * (b - 900) AND g.t2 BETWEEN c.t2 + 2600 AND c.t2 + 2 * (lm + 2000)
    WHERE 2 * b - c.t2 > 2 * (lm + 800)
  ) WHERE place = 1
) SELECT item_id, k, t2 FROM c WHERE k > 0)"""


def items(t: Tables) -> DataFrame:
    m, i = F.col("media_id"), F.col("seg_id")
    return t.segments.select((m * 1000 + i).alias("item_id"), "media_id", (F.col("start_ms") - 200).alias("a_ms"), (F.col("end_ms") + 2500).alias("b_ms"), (3400 + (i % 3) * 400).alias("limit_ms"))


@query("w24_cut_points", CUTS)
def w24(t: Tables) -> DataFrame:
    return pictures.cut_points(items(t), t.words)


def key_frames(t: Tables) -> DataFrame:
    """A small picture at the end of every word, which changes slowly."""
    pixel = lambda j: 100 + (F.col("seg_id") * 3 + F.floor(F.col("pos") / 6) + j) % 7
    return t.words.select("media_id", F.col("e_ms").alias("t_ms"), F.array(*[pixel(j).cast("bigint") for j in range(14)]).alias("pixels"))


STILLS = """, kf AS (SELECT media_id, e_ms AS t, list_transform(range(14), lambda j: 100 + (seg_id * 3 + pos // 6 + j) % 7) AS px FROM words),
du AS (SELECT media_id, max(end_ms) + 100 AS dur, least(20000, greatest(6000, (max(end_ms) + 100) // 90)) AS step FROM segments GROUP BY media_id)
SELECT * FROM (WITH RECURSIVE sa AS (
  SELECT media_id, min(t) AS t, 1 AS k FROM kf GROUP BY media_id
  UNION ALL SELECT sa.media_id, min(kf.t), sa.k + 1 FROM sa JOIN du USING (media_id) JOIN kf ON kf.media_id = sa.media_id AND kf.t >= sa.t + step - 1 GROUP BY sa.media_id, sa.k
), pic AS (SELECT sa.media_id, k, sa.t, px FROM sa JOIN kf ON kf.media_id = sa.media_id AND kf.t = sa.t),
ke AS (
  SELECT media_id, k, t, px, 1 AS shot FROM pic WHERE k = 1
  UNION ALL SELECT media_id, k, t, CASE WHEN new THEN npx ELSE px END, shot + new::INT FROM (
    SELECT p.media_id, p.k, p.t, p.px AS npx, ke.px, ke.shot, 10 * list_sum(list_transform(list_zip(p.px, ke.px), lambda z: abs(z[1] - z[2]))) >= 25 * 14 AS new FROM ke JOIN pic p ON p.media_id = ke.media_id AND p.k = ke.k + 1)
), sh AS (SELECT media_id, shot, min(t) AS from_ms, max(t) + any_value(step) AS to_ms, count(*) AS n, any_value(dur) AS dur, max(shot) OVER (PARTITION BY media_id) AS last FROM ke JOIN du USING (media_id) GROUP BY media_id, shot)
SELECT media_id, shot, from_ms, CASE WHEN shot = last THEN least(to_ms, dur) ELSE to_ms END AS to_ms, CAST(n AS INTEGER) AS n FROM sh)"""


@query("w21_still_shots", STILLS)
def w21(t: Tables) -> DataFrame:
    k = key_frames(t)
    d = t.segments.groupBy("media_id").agg((F.max("end_ms") + 100).alias("duration_ms"))
    chosen = pictures.sampled(k.select("media_id", "t_ms"), d.select("media_id", pictures.sample_step(F.col("duration_ms")).alias("step_ms")))
    return pictures.still_shots(chosen.join(k.hint("merge"), ["media_id", "t_ms"]), d)


HEADS = """, de AS (SELECT media_id, s_ms // 500 * 500 AS t, (seg_id * 97 + pos * 41) % 1280 AS x, (pos * 53) % 720 AS y, 22 + length(w) * 7 AS wd FROM words),
hi AS (SELECT media_id * 1000 + seg_id AS item_id, media_id, start_ms AS a, CASE WHEN seg_id % 4 = 0 THEN start_ms + 1500 ELSE end_ms END AS b, CASE WHEN seg_id % 3 > 0 THEN (seg_id * 211) % 1280 END AS seat FROM segments),
hg AS (SELECT *, CASE WHEN b - a > 1600 THEN 4 ELSE 3 END AS m FROM hi), hk AS (SELECT *, unnest(range(m)) AS k FROM hg),
ht AS (SELECT *, (a + (b - a) * (2 * k + 1) // (2 * m)) // 500 * 500 AS t FROM hk),
hm AS (SELECT h.*, d.x, d.y, d.wd FROM ht h JOIN de d USING (media_id, t) WHERE seat IS NULL OR (abs(d.x - seat) <= 230 AND d.y BETWEEN 0 AND 600)),
hb AS (SELECT *, row_number() OVER (PARTITION BY item_id, k ORDER BY CASE WHEN seat IS NULL THEN -wd ELSE abs(x - seat) END, x, y) AS place FROM (SELECT *, max(wd) OVER (PARTITION BY item_id, k) AS widest FROM hm) WHERE seat IS NULL OR 10 * wd >= 6 * widest)
SELECT item_id, CAST(trunc(median(x)) AS INTEGER) AS x, CAST(trunc(median(y)) AS INTEGER) AS y, CAST(count(*) AS INTEGER) AS n FROM hb WHERE place = 1 GROUP BY item_id"""


@query("k08_head_positions", HEADS)
def k08(t: Tables) -> DataFrame:
    i, p = F.col("seg_id"), F.col("pos")
    found = t.words.select("media_id", (F.floor(F.col("s_ms") / 500) * 500).alias("t_ms"), ((i * 97 + p * 41) % 1280).alias("x"), ((p * 53) % 720).alias("y"), (22 + F.length("w") * 7).alias("width"))
    seat = F.when(i % 3 > 0, (i * 211) % 1280)
    end = F.when(i % 4 == 0, F.col("start_ms") + 1500).otherwise(F.col("end_ms"))
    x = t.segments.select((F.col("media_id") * 1000 + i).alias("item_id"), "media_id", F.col("start_ms").alias("a_ms"), end.alias("b_ms"), seat.alias("seat_x"), F.lit(0).alias("y0"), F.lit(600).alias("y1"))
    return pictures.head_positions(x, found, grid_ms=500)


SEATS = [(0, "user", 300), (0, "assistant", 900), (1, "assistant", 200), (1, "guest", 640), (1, "user", 1100), (2, "guest", 40)]
MOTION = FRAMES + f""", mo AS (SELECT media_id, frame_no AS f, list_transform(range(32), lambda j: (frame_no // 40 * 7 + j * 13 + CAST(rms AS BIGINT)) % 40) AS r FROM frames),
se AS (SELECT * FROM (VALUES {", ".join(map(str, SEATS))}) s(set_id, speaker, x)),
sp AS (SELECT media_id * 1000 + seg_id AS span_id, media_id, seg_id AS ord, CAST(seg_id % 3 AS INTEGER) AS set_id, start_ms // 50 AS a, CASE WHEN seg_id % 7 = 3 THEN start_ms // 50 + 2 ELSE end_ms // 50 END AS z,
  CASE WHEN seg_id % 4 = 1 THEN speaker END AS spoken, CASE WHEN seg_id % 5 > 0 THEN 'user' END AS presenter, seg_id % 2 = 0 AS wide FROM segments),
en AS (SELECT span_id, sp.set_id, wide, speaker, sum(list_sum(r[lo + 1:hi])) / sum(hi - lo)::DOUBLE AS energy, count(*) AS n FROM sp JOIN (SELECT *, greatest((x - 140) // 40, 0) AS lo, least(CAST(trunc((x + 140) / 40) AS BIGINT) + 1, 32) AS hi FROM se) s ON s.set_id = sp.set_id
  JOIN mo ON mo.media_id = sp.media_id AND f >= a AND f < z GROUP BY ALL),
ba AS (SELECT set_id, speaker, avg(energy) + 0.001 AS base FROM en WHERE wide GROUP BY ALL),
pr AS (SELECT sp.*, (SELECT list(speaker ORDER BY speaker) FROM se WHERE se.set_id = sp.set_id) AS seats FROM sp),
pq AS (SELECT *, CASE WHEN list_contains(seats, presenter) THEN presenter ELSE seats[1] END AS p FROM pr),
sc AS (SELECT pq.span_id, e.speaker, coalesce(energy, 0) / coalesce(base, 1.001) * CASE WHEN e.speaker = p THEN 2.5 ELSE 1.0 END AS m, n FROM pq JOIN se e USING (set_id) LEFT JOIN en ON en.span_id = pq.span_id AND en.speaker = e.speaker LEFT JOIN ba ON ba.set_id = pq.set_id AND ba.speaker = e.speaker),
st AS (SELECT span_id, list(m ORDER BY m DESC, speaker) AS ms, list(speaker ORDER BY m DESC, speaker) AS who, coalesce(max(n), 0) AS n FROM sc GROUP BY span_id),
sd AS (SELECT pq.*, who[1] AS best, CASE WHEN list_contains(seats, spoken) THEN spoken WHEN n < 3 THEN p WHEN NOT (len(ms) > 1 AND ms[1] < 1.25 * ms[2]) THEN who[1] END AS fixed, row_number() OVER (PARTITION BY media_id ORDER BY ord) AS k FROM pq JOIN st USING (span_id))
SELECT * FROM (WITH RECURSIVE h AS (
  SELECT media_id, k, span_id, coalesce(fixed, best) AS speaker FROM sd WHERE k = 1
  UNION ALL SELECT d.media_id, d.k, d.span_id, coalesce(d.fixed, CASE WHEN list_contains(d.seats, h.speaker) THEN h.speaker END, d.best) FROM h JOIN sd d ON d.media_id = h.media_id AND d.k = h.k + 1
) SELECT span_id, speaker FROM h)"""  # fmt: skip


@query("v05_moving_speakers", MOTION)
def v05(t: Tables) -> DataFrame:
    i = F.col("seg_id")
    row = F.array(*[((F.floor(F.col("frame_no") / 40) * 7 + j * 13 + F.col("rms").cast("bigint")) % 40).cast("bigint") for j in range(32)])
    motion = frames(t).select("media_id", "frame_no", row.alias("row"))
    seats = t.spark.createDataFrame(SEATS, "set_id int, speaker string, x int")
    spans = t.segments.select(
        (F.col("media_id") * 1000 + i).alias("span_id"), "media_id", F.col("media_id").alias("seq_id"), i.alias("ord"), (i % 3).cast("int").alias("set_id"), F.floor(F.col("start_ms") / 50).alias("from_frame"),
        F.when(i % 7 == 3, F.floor(F.col("start_ms") / 50) + 2).otherwise(F.floor(F.col("end_ms") / 50)).alias("to_frame"),
        F.when(i % 4 == 1, F.col("speaker")).alias("spoken"), F.when(i % 5 > 0, "user").alias("presenter"), (i % 2 == 0).alias("wide"),
    )
    energies = pictures.seat_energies(spans, motion, seats)
    base = pictures.baselines(energies, spans.filter("wide").select("span_id", "set_id"))
    return pictures.moving_speakers(spans.drop("media_id", "wide"), energies, seats, base)


@query("q02_word_deviations")
def q02(t: Tables) -> DataFrame:
    """Each recording against a hearing of it that misses words, mishears some and is a little late."""
    w, p = t.words, F.col("pos")
    heard = F.when(p % 11 == 6, F.concat("w", F.lit("a"))).when(p % 5 == 2, F.upper("w")).otherwise(F.col("w"))
    hyp = w.filter("pos % 9 <> 4").select("media_id", (F.col("seg_id") * 10_000 + p).alias("pos"), heard.alias("w"), (F.col("s_ms") + (p * 31) % 170).alias("s_ms"), (F.col("e_ms") + (p * 17) % 90).alias("e_ms"))
    return quality.word_deviations(w.select("media_id", (F.col("seg_id") * 10_000 + p).alias("pos"), "w", "s_ms", "e_ms"), hyp)

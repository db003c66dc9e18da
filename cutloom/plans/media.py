"""Queries over captions, cameras, audio, shots and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.operators import audio, captions, multicam, quality, shots, timeline
from cutloom.plans.registry import Tables, query

# Whole sentences as cues of 90 characters each: a table both engines can make.
CUES = """, cu0 AS (SELECT media_id, seg_id, start_ms, end_ms - start_ms AS dur, substr(text, 1 + (seg_id % 2)) AS text, greatest(1, (length(text) - seg_id % 2 + 89) // 90) AS n FROM segments),
cu1 AS (SELECT *, unnest(range(n)) AS k FROM cu0),
cues AS (SELECT media_id AS seq_id, seg_id * 1000 + k AS ord, start_ms + dur * k // n AS t0_ms, start_ms + dur * (k + 1) // n + CASE WHEN seg_id % 5 = 0 AND k = n - 1 THEN 700 ELSE 0 END AS t1_ms, substr(text, 1 + 90 * k, 90) AS text, 1 + (seg_id - 1) // 4 AS clip_ix FROM cu1),
cue_clips AS (SELECT seq_id, clip_ix, min(t0_ms) - 50 AS start_ms, max(t1_ms) + 300 AS end_ms FROM cues GROUP BY seq_id, clip_ix)
"""


def cues(t: Tables) -> DataFrame:
    i, dur = F.col("seg_id"), F.col("end_ms") - F.col("start_ms")
    s = t.segments.withColumn("text", F.substr("text", 1 + (i % 2).cast("int"))).withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("text") / 90)).cast("bigint"))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    part = lambda k: F.col("start_ms") + F.floor(dur * k / F.col("n"))
    return s.select(
        F.col("media_id").alias("seq_id"), (i * 1000 + F.col("k")).alias("ord"), part(F.col("k")).alias("t0_ms"),
        (part(F.col("k") + 1) + F.when((i % 5 == 0) & (F.col("k") == F.col("n") - 1), 700).otherwise(0)).alias("t1_ms"),
        F.substr("text", (1 + 90 * F.col("k")).cast("int"), F.lit(90)).alias("text"), (1 + F.floor((i - 1) / 4)).alias("clip_ix"),
    )


def cue_clips(t: Tables) -> DataFrame:
    return cues(t).groupBy("seq_id", "clip_ix").agg((F.min("t0_ms") - 50).alias("start_ms"), (F.max("t1_ms") + 300).alias("end_ms"))


@query("w13_w14_cues")
def w13(t: Tables) -> DataFrame:
    return captions.cues(timeline.words_on_timeline(t.clips, t.words))


@query("a10_cue_speaker", ", wt AS (SELECT seq_id, clip_ix, spk, sum(e_ms - s_ms) AS t FROM words w JOIN clips c ON w.media_id = c.media_id AND s_ms >= in_ms - 10 AND e_ms <= out_ms + 10 GROUP BY ALL) SELECT seq_id, clip_ix, arg_max(spk, (t, spk)) AS speaker, CAST(sum(t) AS BIGINT) AS ms FROM wt GROUP BY seq_id, clip_ix")
def a10(t: Tables) -> DataFrame:
    w = timeline.words_on_timeline(t.clips, t.words).groupBy("seq_id", "clip_ix", "spk").agg(F.sum(F.col("t1_ms") - F.col("t0_ms")).alias("t"))
    return w.groupBy("seq_id", "clip_ix").agg(F.max_by("spk", F.struct("t", "spk")).alias("speaker"), F.sum("t").alias("ms"))


@query("w16_capitalised", CUES + r"""SELECT seq_id, ord, CASE WHEN pt IS NULL OR regexp_matches(trim(pt), '[.!?…]$') OR pc <> clip_ix THEN upper(substr(trim(text), 1, 1)) || substr(trim(text), 2) ELSE text END AS text FROM (SELECT *, lag(text) OVER w AS pt, lag(clip_ix) OVER w AS pc FROM cues WINDOW w AS (PARTITION BY seq_id ORDER BY ord))""")
def w16(t: Tables) -> DataFrame:
    return captions.capitalised(cues(t)).select("seq_id", "ord", "text")


@query("w15_timed_cues", CUES + """, c1 AS (SELECT c.*, k.start_ms AS cs, k.end_ms AS ce, greatest(lag(t1_ms, 1, 0) OVER (PARTITION BY c.seq_id ORDER BY ord), k.start_ms, t0_ms - 120) AS n0 FROM cues c JOIN cue_clips k ON c.seq_id = k.seq_id AND c.clip_ix = k.clip_ix),
c2 AS (SELECT *, lead(n0) OVER (PARTITION BY seq_id ORDER BY ord) - 40 AS nx, greatest(1000, CAST(ceil(length(trim(text)) * 1000 / 17) AS BIGINT)) AS want FROM c1)
SELECT seq_id, ord, n0 AS t0_ms, CASE WHEN t1_ms - n0 < want THEN greatest(t1_ms, least(n0 + want, t1_ms + 1500, coalesce(nx, t1_ms + 1500), ce)) ELSE t1_ms END AS t1_ms FROM c2""")  # fmt: skip
def w15(t: Tables) -> DataFrame:
    return captions.timed(cues(t), cue_clips(t)).select("seq_id", "ord", "t0_ms", "t1_ms")


@query("w17_translation_groups", CUES + r""", g0 AS (SELECT *, coalesce(regexp_matches(lag(text) OVER w, '[.!?…]$') OR t0_ms - lag(t1_ms) OVER w >= 5000, true) AS nw FROM cues WINDOW w AS (PARTITION BY seq_id ORDER BY ord)),
g1 AS (SELECT *, sum(nw::INT) OVER (PARTITION BY seq_id ORDER BY ord) AS i FROM g0), g2 AS (SELECT *, (row_number() OVER (PARTITION BY seq_id, i ORDER BY ord) - 1) // 10 AS g FROM g1),
g3 AS (SELECT seq_id, min(ord) AS first_ord, count(*) AS n, string_agg(text, ' ' ORDER BY ord) AS text, sum(t1_ms - t0_ms) AS ms FROM g2 GROUP BY seq_id, i, g)
SELECT seq_id, first_ord, n, text, CAST(greatest(length(text) * 6 // 10, (ms + 500 * (n - 1)) * 17 // 1000) AS BIGINT) AS budget FROM g3""")  # fmt: skip
def w17(t: Tables) -> DataFrame:
    return captions.translation_groups(cues(t))


@query("x07_wrapped", CUES + r""", ws AS (SELECT seq_id, ord, trim(text) AS text, string_split(trim(text), ' ') AS w FROM cues),
wi AS (SELECT *, unnest(range(1, greatest(len(w), 2))) AS i FROM ws), wl AS (SELECT *, array_to_string(w[1:i], ' ') AS a, array_to_string(w[i+1:], ' ') AS b FROM wi),
wc AS (SELECT *, greatest(length(a), length(b)) + CASE WHEN greatest(length(a), length(b)) > 40 THEN 1000 ELSE 0 END + CASE WHEN regexp_matches(a, '(^|\s)\p{L}$') THEN 60 ELSE 0 END - CASE WHEN regexp_matches(a, '[,;:.!?…]$') THEN 8 ELSE 0 END AS c FROM wl),
wr AS (SELECT *, row_number() OVER (PARTITION BY seq_id, ord ORDER BY c, i) AS r FROM wc)
SELECT seq_id, ord, CASE WHEN length(text) <= 40 OR len(w) < 2 THEN text ELSE a || chr(10) || b END AS lines FROM wr WHERE r = 1""")  # fmt: skip
def x07(t: Tables) -> DataFrame:
    return cues(t).select("seq_id", "ord", captions.wrapped(F.col("text")).alias("lines"))


@query("s07_s08_srt_round_trip", CUES + r"SELECT seq_id, ord, t0_ms, t1_ms, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' ') AS text FROM cues")
def s08(t: Tables) -> DataFrame:
    parsed = captions.parsed_srt(captions.srt(cues(t)))
    return parsed.select("seq_id", "ord", "t0_ms", "t1_ms", F.array_join(F.filter(F.split(F.array_join("lines", " "), r"\s+"), lambda x: x != ""), " ").alias("text"))


@query("q01_caption_issues", CUES + r""", ql AS (SELECT *, text AS l1, t1_ms - t0_ms AS d, lag(text) OVER w AS pt, lag(t1_ms) OVER w AS pe FROM cues WINDOW w AS (PARTITION BY seq_id ORDER BY ord))
SELECT seq_id, ord, 'long line' AS issue FROM ql WHERE length(l1) > 40 UNION ALL SELECT seq_id, ord, 'ends with preposition' FROM ql WHERE regexp_matches(l1, '(?i)(^|\s)(v|s|z|k|o|u|a|i)$')
UNION ALL SELECT seq_id, ord, 'too short' FROM ql WHERE d < 700 UNION ALL SELECT seq_id, ord, 'too long' FROM ql WHERE d > 7500 UNION ALL SELECT seq_id, ord, 'too fast' FROM ql WHERE d > 0 AND length(l1) * 1000 > 21 * d
UNION ALL SELECT seq_id, ord, 'orphan' FROM ql WHERE len(regexp_split_to_array(trim(l1), '\s+')) = 1 AND NOT regexp_matches(l1, '[.!?…]$') UNION ALL SELECT seq_id, ord, 'overlap' FROM ql WHERE t0_ms < pe - 1
UNION ALL SELECT seq_id, ord, 'lower case' FROM ql WHERE regexp_matches(pt, '[.!?…]$') AND regexp_matches(l1, '^\p{Ll}')""")  # fmt: skip
def q01(t: Tables) -> DataFrame:
    return captions.issues(cues(t).withColumn("lines", F.array("text")))


CAMERAS = [multicam.Camera("wide.mp4", "wide", (), -2000), multicam.Camera("a.mp4", "close", ("user",), 300), multicam.Camera("b.mp4", "close", ("assistant",), 0)]


def spans(t: Tables) -> DataFrame:
    m = t.segments.groupBy("media_id").agg(F.max("end_ms").alias("d"))
    no = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("d") / 30_000)))
    return m.select("media_id", "d", no.alias("range_no")).select("media_id", "range_no", (F.col("range_no") * 30_000).alias("start_ms"), F.least("d", F.col("range_no") * 30_000 + 25_000).alias("end_ms")).filter("end_ms > start_ms")


@query("m01_m04_camera_runs")
def m01(t: Tables) -> DataFrame:
    return multicam.planned_runs(spans(t), t.turns, CAMERAS)


RUNS = """, runs AS (SELECT media_id, CAST(0 AS BIGINT) AS range_no, seg_id AS run, CASE speaker WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END AS cam, start_ms, end_ms FROM segments)
"""


def runs(t: Tables) -> DataFrame:
    cam = F.when(F.col("speaker") == "user", 1).when(F.col("speaker") == "assistant", 2).otherwise(0)
    return t.segments.select("media_id", F.lit(0).cast("bigint").alias("range_no"), F.col("seg_id").alias("run"), cam.alias("cam"), "start_ms", "end_ms")


@query("a11_camera_summary", RUNS + "SELECT media_id, cam, count(*) AS shots, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, CAST(floor(avg(end_ms - start_ms)) AS BIGINT) AS mean_ms, min(end_ms - start_ms) AS shortest_ms FROM runs GROUP BY GROUPING SETS ((media_id, cam), (media_id))")
def a11(t: Tables) -> DataFrame:
    return multicam.summary(runs(t))


@query("m05_placed_clips", RUNS + """, cam AS (SELECT * FROM (VALUES (0, 'wide.mp4', -2000), (1, 'a.mp4', 2300), (2, 'b.mp4', 0)) x(cam, source, off)),
p AS (SELECT r.media_id, range_no, run, source, r.start_ms - off AS i, r.start_ms - 500 AS a, r.end_ms - r.start_ms AS d FROM runs r JOIN cam USING (cam))
SELECT media_id, range_no, run, source, i + greatest(0, -i) AS in_ms, a + greatest(0, -i) AS at_ms, d - greatest(0, -i) AS dur_ms FROM p WHERE d - greatest(0, -i) > 20""")
def m05(t: Tables) -> DataFrame:
    cameras = t.spark.createDataFrame([(0, "wide.mp4", -2000), (1, "a.mp4", 2300), (2, "b.mp4", 0)], "cam int, source string, offset_ms bigint")
    one = t.segments.groupBy("media_id").agg(F.lit(0).cast("bigint").alias("range_no"), F.lit(500).cast("bigint").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return multicam.placed_clips(runs(t), one, cameras)


@query("j21_grid_accuracy", """, tg AS (SELECT media_id, unnest(range(CAST(ceil(start_ms / 100) AS BIGINT), CAST(ceil(end_ms / 100) AS BIGINT))) AS k, speaker AS l FROM segments),
gg AS (SELECT media_id, unnest(range(CAST(ceil(t_start / 100) AS BIGINT), CAST(ceil(t_end / 100) AS BIGINT))) AS k, 'g' || speaker AS l FROM turns),
t1 AS (SELECT media_id, k, min(l) AS t FROM tg GROUP BY media_id, k HAVING count(DISTINCT l) = 1), g1 AS (SELECT media_id, k, min(l) AS g FROM gg GROUP BY media_id, k HAVING count(DISTINCT l) = 1),
m AS (SELECT t1.media_id, g, t, count(*) AS n FROM t1 LEFT JOIN g1 ON t1.media_id = g1.media_id AND t1.k = g1.k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id, g ORDER BY n DESC, t) AS r FROM m)
SELECT media_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN r = 1 AND g IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS hits FROM r GROUP BY media_id""")  # fmt: skip
def j21(t: Tables) -> DataFrame:
    truth = t.segments.select("media_id", "start_ms", "end_ms", F.col("speaker").alias("label"))
    guess = t.turns.select("media_id", F.col("t_start").alias("start_ms"), F.col("t_end").alias("end_ms"), F.concat(F.lit("g"), "speaker").alias("label"))
    return multicam.grid_accuracy(truth, guess)


FRAMES = """, fr0 AS (SELECT media_id, unnest(range(0, max(e_ms) // 50 + 1)) AS frame_no FROM words GROUP BY media_id),
loud AS (SELECT DISTINCT media_id, unnest(range(s_ms // 50, e_ms // 50 + 1)) AS frame_no FROM words),
frames AS (SELECT f.media_id, f.frame_no, CAST(CASE WHEN l.frame_no IS NULL THEN 40 + (f.frame_no * 13) % 30 ELSE 2000 + (f.frame_no * 37) % 900 END AS DOUBLE) AS rms FROM fr0 f LEFT JOIN loud l ON f.media_id = l.media_id AND f.frame_no = l.frame_no)
"""


def frames(t: Tables) -> DataFrame:
    """Frames of 50 ms of every recording, loud where a word is heard.

    A word makes the frames after those of the words before it, up to its own
    last one, so each is made once, without a join of frames.
    """
    from pyspark.sql import Window as W

    first, last = F.floor(F.col("s_ms") / 50), F.floor(F.col("e_ms") / 50)
    before = F.max(last).over(W.partitionBy("media_id").orderBy("seg_id", "pos").rowsBetween(W.unboundedPreceding, -1))
    w = t.words.select("media_id", first.alias("_a"), last.alias("_b"), (F.coalesce(before, F.lit(-1)) + 1).alias("_new")).filter("_b >= _new")
    f = w.select("media_id", "_a", F.explode(F.sequence("_new", "_b")).alias("frame_no"))
    rms = F.when(F.col("frame_no") >= F.col("_a"), 2000 + (F.col("frame_no") * 37) % 900).otherwise(40 + (F.col("frame_no") * 13) % 30)
    return f.select("media_id", "frame_no", rms.cast("double").alias("rms"))


@query("n02_onsets", FRAMES + """, d AS (SELECT media_id, frame_no, greatest(0.0, coalesce(ln(1 + rms * 100) - lag(ln(1 + rms * 100)) OVER (PARTITION BY media_id ORDER BY frame_no), 0.0)) AS d FROM frames)
SELECT media_id, frame_no, round((d - avg(d) OVER (PARTITION BY media_id)) / (stddev_pop(d) OVER (PARTITION BY media_id) + 1e-9), 4) + 0.0 AS onset FROM d""")  # fmt: skip
def n02(t: Tables) -> DataFrame:
    return audio.onsets(frames(t)).withColumn("onset", F.round("onset", 4) + 0.0)


PAIRS = """, pairs AS (SELECT media_id, seg_id AS pair_no, end_ms AS a_ms, lead(start_ms) OVER (PARTITION BY media_id ORDER BY seg_id) AS b_ms FROM segments), pp AS (SELECT * FROM pairs WHERE b_ms IS NOT NULL)
"""


def sentence_pairs(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    nxt = F.lead("start_ms").over(W.partitionBy("media_id").orderBy("seg_id"))
    return t.segments.select("media_id", F.col("seg_id").alias("pair_no"), F.col("end_ms").alias("a_ms"), nxt.alias("b_ms")).filter("b_ms is not null")


SILENCE = FRAMES + PAIRS + """, pm AS (SELECT p.*, f.frame_no, f.frame_no * 50 AS ft, 20 * log10(greatest(rms, 1e-7)) AS db FROM pp p JOIN frames f ON p.media_id = f.media_id AND f.frame_no * 50 BETWEEN least(a_ms, b_ms) - 1500 AND greatest(a_ms, b_ms) + 1450),
pl AS (SELECT media_id, pair_no, quantile_cont(db, 0.1) AS lo, quantile_cont(db, 0.95) AS hi FROM pm GROUP BY media_id, pair_no),
pq AS (SELECT m.media_id, m.pair_no, frame_no, frame_no - row_number() OVER (PARTITION BY m.media_id, m.pair_no ORDER BY frame_no) AS r FROM pm m JOIN pl l ON m.media_id = l.media_id AND m.pair_no = l.pair_no
  WHERE ft >= least(a_ms, b_ms) - 150 AND ft <= greatest(a_ms, b_ms) + 300 AND db < lo + 0.25 * greatest(0, hi - lo)),
pr0 AS (SELECT media_id, pair_no, r, count(*) AS n FROM pq GROUP BY ALL), pr1 AS (SELECT media_id, pair_no, max(n) * 50 AS ms FROM pr0 GROUP BY ALL),
silence AS (SELECT p.*, coalesce(ms, 0) AS silence_ms, coalesce(ms, 0) >= 90 AS silent FROM pp p LEFT JOIN pr1 r ON p.media_id = r.media_id AND p.pair_no = r.pair_no)
"""  # fmt: skip


@query("n04_silences", SILENCE + "SELECT media_id, pair_no, a_ms, b_ms, silence_ms, silent FROM silence")
def n04(t: Tables) -> DataFrame:
    return audio.pauses(sentence_pairs(t), frames(t), 50)


@query("n07_sentence_pauses", SILENCE + "SELECT media_id, pair_no AS seg_id, b_ms - a_ms >= 120 AND silent AS pause FROM silence UNION ALL SELECT media_id, max(seg_id), true FROM segments GROUP BY media_id")
def n07(t: Tables) -> DataFrame:
    p = audio.pauses(sentence_pairs(t), frames(t), 50)
    last = t.segments.groupBy("media_id").agg(F.max("seg_id").alias("seg_id"), F.lit(True).alias("pause"))
    return p.select("media_id", F.col("pair_no").alias("seg_id"), ((F.col("b_ms") - F.col("a_ms") >= 120) & F.col("silent")).alias("pause")).unionByName(last)


@query("n03_offsets")
def n03(t: Tables) -> DataFrame:
    f = audio.onsets(frames(t))
    ids = f.select("media_id").distinct()
    pairs = ids.select((F.col("media_id") - F.col("media_id") % 4).alias("ref_id"), F.col("media_id").alias("other_id")).filter("ref_id <> other_id")
    return audio.offsets(pairs, f, max_lag=2000, guard=10)


@query("n08_resampled", """, k AS (SELECT media_id AS path_id, t_ms, CAST(t_ms % 300 AS DOUBLE) AS v FROM cuts WHERE t_ms % 3 <> 0), k1 AS (SELECT *, lead(t_ms) OVER w AS b, lead(v) OVER w AS vb, min(t_ms) OVER (PARTITION BY path_id) AS s FROM k WINDOW w AS (PARTITION BY path_id ORDER BY t_ms)),
g AS (SELECT path_id, unnest(range(min(t_ms), max(t_ms) + 1, 250)) AS t FROM k GROUP BY path_id)
SELECT g.path_id, g.t AS t_ms, round(k1.v + coalesce((vb - k1.v) * (g.t - k1.t_ms) / (b - k1.t_ms), 0), 6) AS v FROM g JOIN k1 ON g.path_id = k1.path_id AND g.t >= k1.t_ms AND (b IS NULL OR g.t < b)
UNION ALL SELECT path_id, t_ms, v FROM k1 WHERE b IS NULL AND (t_ms - s) % 250 <> 0""")  # fmt: skip
def n08(t: Tables) -> DataFrame:
    keys = t.cuts.filter("t_ms % 3 <> 0").select(F.col("media_id").alias("path_id"), "t_ms", (F.col("t_ms") % 300).cast("double").alias("v"))
    return audio.resampled(keys).withColumn("v", F.round("v", 6))


FRAME_DIFFS = "WITH f AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no, value AS diff FROM events)\n"


def frame_diffs(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select(F.col("user_id").alias("media_id"), n.cast("bigint").alias("frame_no"), F.col("value").alias("diff"))


@query("w20_shot_boundaries", FRAME_DIFFS + """, s0 AS (SELECT *, greatest(coalesce(lag(diff) OVER w, 0), coalesce(lead(diff) OVER w, 0)) AS beside FROM f WINDOW w AS (PARTITION BY media_id ORDER BY frame_no)),
s1 AS (SELECT *, sum((diff > 20 AND diff > 2 * beside)::INT) OVER (PARTITION BY media_id ORDER BY frame_no) AS s FROM s0), s2 AS (SELECT media_id, s, min(frame_no) AS a, max(frame_no) AS b FROM s1 GROUP BY media_id, s),
s3 AS (SELECT *, (b - a + 1 >= 3 OR row_number() OVER (PARTITION BY media_id ORDER BY a) = 1)::INT AS l FROM s2), s4 AS (SELECT *, CAST(sum(l) OVER (PARTITION BY media_id ORDER BY a) AS BIGINT) AS shot FROM s3)
SELECT media_id, shot, min(a) AS first_frame, max(b) AS last_frame FROM s4 GROUP BY media_id, shot""", base=False)  # fmt: skip
def w20(t: Tables) -> DataFrame:
    return shots.boundaries(frame_diffs(t))


@query("a14_median_features", FRAME_DIFFS + "SELECT media_id, CAST(floor(frame_no / 10) AS BIGINT) AS shot, quantile_cont(diff, 0.5) AS median FROM f GROUP BY ALL", base=False)
def a14(t: Tables) -> DataFrame:
    return frame_diffs(t).groupBy("media_id", F.floor(F.col("frame_no") / 10).alias("shot")).agg(F.percentile("diff", 0.5).alias("median"))


@query("w25_variants", "SELECT seq_id, clip_ix AS ord, CAST(row_number() OVER (PARTITION BY seq_id, track ORDER BY clip_ix) % 2 AS INTEGER) AS parity, CASE WHEN row_number() OVER (PARTITION BY seq_id ORDER BY clip_ix) % 5 = 0 THEN 'shake' WHEN row_number() OVER (PARTITION BY seq_id ORDER BY clip_ix) % 3 = 0 THEN 'punch' ELSE 'plain' END AS variant FROM clips")
def w25(t: Tables) -> DataFrame:
    return shots.variants(t.clips.select("seq_id", F.col("clip_ix").alias("ord"), F.col("track").alias("shot")))


@query("j14_on_screen", """, it AS (SELECT media_id, t_ms AS item, t_ms AS a_ms, t_ms + 2600 AS b_ms, CASE WHEN t_ms % 2 = 0 THEN 'two' ELSE 'one' END AS layout FROM cuts),
p AS (SELECT i.media_id, item, layout, speaker, sum(greatest(0, least(b_ms, end_ms) - greatest(a_ms, start_ms))) AS t FROM it i JOIN segments s ON i.media_id = s.media_id AND start_ms <= b_ms AND a_ms <= end_ms GROUP BY ALL HAVING t > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY media_id, item ORDER BY t DESC, speaker DESC) AS r FROM p) SELECT media_id, item, speaker FROM b WHERE r = 1 AND (layout = 'two' AND speaker <> 'system' OR speaker = 'user')""")  # fmt: skip
def j14(t: Tables) -> DataFrame:
    items = t.cuts.select("media_id", F.col("t_ms").alias("item"), F.col("t_ms").alias("a_ms"), (F.col("t_ms") + 2600).alias("b_ms"), F.when(F.col("t_ms") % 2 == 0, "two").otherwise("one").alias("layout"))
    seated = t.spark.createDataFrame([("two", "user"), ("two", "assistant"), ("one", "user")], "layout string, speaker string")
    return shots.on_screen(items, t.segments, seated)


@query("j15_borrowed_position", """, it AS (SELECT media_id AS seq_id, seg_id AS ord, start_ms AS t_ms, speaker, CASE WHEN seg_id % 3 = 1 THEN seg_id * 10 END AS x FROM segments),
b AS (SELECT i.seq_id, i.ord, g.x, row_number() OVER (PARTITION BY i.seq_id, i.ord ORDER BY abs(g.t_ms - i.t_ms), g.t_ms) AS r FROM it i JOIN it g ON i.x IS NULL AND g.x IS NOT NULL AND i.seq_id = g.seq_id AND i.speaker = g.speaker AND abs(g.t_ms - i.t_ms) <= 20000)
SELECT i.seq_id, i.ord, coalesce(i.x, b.x) AS x FROM it i LEFT JOIN b ON b.r = 1 AND i.seq_id = b.seq_id AND i.ord = b.ord""")
def j15(t: Tables) -> DataFrame:
    s = t.segments
    return shots.borrowed(s.select(F.col("media_id").alias("seq_id"), F.col("seg_id").alias("ord"), F.col("start_ms").alias("t_ms"), "speaker", F.when(F.col("seg_id") % 3 == 1, F.col("seg_id") * 10).alias("x")))


@query("s03_current_version", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", base=False)
def s03(t: Tables) -> DataFrame:
    return quality.current_version(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("a05_call_statistics", "SELECT coalesce(CASE WHEN event_type <> 'error' THEN event_type END, '-') AS phase, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS sec, CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS BIGINT) AS prompt FROM events GROUP BY 1", base=False)
def a05(t: Tables) -> DataFrame:
    calls = t.events.select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("phase"), F.round(F.col("value") * 100).cast("bigint").alias("sec"), F.get_json_object("props", "$.k").cast("bigint").alias("prompt"))
    return quality.call_statistics(calls)


@query("a06_language_vote", "SELECT media_id, arg_max(lang, (p, lang)) AS lang FROM (SELECT doc_id % 40 AS media_id, lang, CAST(sum(n_chars % 90) AS BIGINT) AS p FROM documents GROUP BY ALL) GROUP BY media_id", base=False)
def a06(t: Tables) -> DataFrame:
    return quality.language_vote(t.documents.select((F.col("doc_id") % 40).alias("media_id"), "lang", (F.col("n_chars") % 90).alias("p")))


@query("a16_best_overlap", """, p AS (SELECT plan_id, list(seg_id) AS ids FROM picks GROUP BY plan_id), r AS (SELECT media_id AS plan_id, seg_id % 3 AS ref_no, list(seg_id) AS ref FROM segments GROUP BY ALL)
SELECT plan_id, max(CAST(floor(len(list_intersect(ids, ref)) * 100 / len(list_distinct(list_concat(ids, ref)))) AS BIGINT)) AS best_pct FROM p JOIN r USING (plan_id) GROUP BY plan_id""")
def a16(t: Tables) -> DataFrame:
    refs = t.segments.groupBy(F.col("media_id").alias("plan_id"), (F.col("seg_id") % 3).alias("ref_no")).agg(F.collect_list("seg_id").alias("ids"))
    return quality.best_overlap(t.picks.groupBy("plan_id").agg(F.collect_list("seg_id").alias("ids")), refs)


@query("a17_stability", """, r AS (SELECT user_id AS plan_id, event_type AS round, CAST(floor(value / 5) AS BIGINT) AS id FROM events), n AS (SELECT plan_id, count(DISTINCT round) AS rounds, count(DISTINCT id) AS distinct_ids FROM r GROUP BY plan_id),
k AS (SELECT plan_id, id, count(DISTINCT round) AS k FROM r GROUP BY ALL) SELECT plan_id, rounds, distinct_ids, count_if(k = rounds) AS always FROM n JOIN k USING (plan_id) GROUP BY ALL""")
def a17(t: Tables) -> DataFrame:
    return quality.stability(t.events.select(F.col("user_id").alias("plan_id"), F.col("event_type").alias("round"), F.floor(F.col("value") / 5).alias("id")))


@query("q02_word_alignment")
def q02(t: Tables) -> DataFrame:
    ref = F.split("text", " ")
    return quality.word_alignment(t.segments.select("media_id", ref.alias("ref"), F.filter(ref, lambda x, i: i % 9 != 4).alias("hyp")))

"""From briefs and picks to an edit: flags and lengths of briefs, completed picks, teasers, picture tracks, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What briefs say, as patterns.
NO_HOST = r"(\bbez\b|vynech|nechci|žádn|nevybírej|nedávej)[^.;:(),]{0,60}?(moder|otázek|organiza)"
TEASER = r"upoutáv|upoutav|trailer|teaser|promo|pozvánk|pozvank"
VOICE_OVER = r"koment|dabing|voice.?over|namluv|mluvím|mluvim|podlo[žz]|odpovídal|odpovidal"
SAYS = r"(jen|pouze|vyhradne|rika|rikaji|rekl|rekla|vyrok[\p{L}\p{N}_]*|slova|promluv[\p{L}\p{N}_]*|mluvi)"
#: A teaser is at most so long, in seconds.
TEASER_S = 40
OVERVIEW = r"přehled|prehled|shrnut|víc témat|vic temat|všech"
INTENSE = r"otřes|strašn|pekeln|krut|drastic|brutál|šokuj|děsiv|hrůz|horor"
BALANCE = r"\b(ob(ou|a|ě)|všech|každ[\p{L}\p{N}_]*)\b[^.;:]{0,30}?(host|mluvčí|stran|účastník|kandidát|řečník)"
# Number words in adjectives, and before units.
IN_ADJECTIVES = {
    "půl": 0.5, "pul": 0.5, "jedno": 1, "dvou": 2, "tří": 3, "tri": 3, "čtyř": 4, "ctyr": 4, "pěti": 5, "peti": 5, "šesti": 6, "sesti": 6, "sedmi": 7, "osmi": 8,
    "devíti": 9, "deviti": 9, "desíti": 10, "desiti": 10, "patnácti": 15, "patnacti": 15, "dvaceti": 20, "pětadvaceti": 25, "třiceti": 30, "triceti": 30,
    "čtyřiceti": 40, "ctyriceti": 40, "pětačtyřiceti": 45, "padesáti": 50, "padesati": 50, "šedesáti": 60, "sedesati": 60, "devadesáti": 90, "devadesati": 90,
}
BEFORE_UNITS = {
    "půl": 0.5, "pul": 0.5, "jedna": 1, "jedné": 1, "jedne": 1, "jednu": 1, "jeden": 1, "dvě": 2, "dve": 2, "dva": 2, "dvou": 2, "tři": 3, "tri": 3, "tří": 3,
    "čtyři": 4, "ctyri": 4, "čtyř": 4, "pět": 5, "pet": 5, "pěti": 5, "šest": 6, "sest": 6, "sedm": 7, "osm": 8, "devět": 9, "deset": 10, "patnáct": 15,
    "patnact": 15, "dvacet": 20, "třicet": 30, "tricet": 30, "čtyřicet": 40, "ctyricet": 40, "padesát": 50, "padesat": 50, "šedesát": 60, "devadesát": 90,
}


def names(numbers: dict[str, float]) -> str:
    return "|".join(sorted(numbers, key=lambda w: (-len(w), w)))


ADJECTIVE = rf"({names(IN_ADJECTIVES)})?(minutov|sekundov|vteřinov|vterinov)"
UNIT = rf"(?:^|[^\p{{L}}])(?:({names(BEFORE_UNITS)})\s+)?(minut\p{{L}}*|sekund\p{{L}}*|vteřin\p{{L}}*|vterin\p{{L}}*)(\s+a\s+půl)?"
DIGITS = r"(\d+(?:[.,]\d+)?)\s*(minut|min\b|sekund|s\b|vte)"


def brief_flags(brief: Column, target_s: Column) -> dict[str, Column]:
    """What a brief asks for: no host, a teaser, one passage, intense moments, all speakers alike."""
    says = lambda p: F.coalesce(brief.rlike(f"(?iu){p}"), F.lit(False))
    passage = F.coalesce(target_s <= 60, F.lit(False)) & ~says(TEASER) & ~says(OVERVIEW)
    return {"no_host": says(NO_HOST), "teaser": says(TEASER), "passage": passage, "intense": says(INTENSE), "balance": says(BALANCE)}


def short_teaser(brief: Column, target_s: Column) -> Column:
    """Whether a brief asks for a teaser so short that it is planned without an outline."""
    return F.coalesce(brief.rlike(f"(?iu){TEASER}") & (target_s <= TEASER_S), F.lit(False))


def speakers_named(briefs: DataFrame, speakers: DataFrame) -> DataFrame:
    """(brief_id, speaker): the speakers (media_id, speaker) of a recording to whom its brief (brief_id, media_id, brief) is confined.

    After a word of saying, or only, and at most three others stands the first
    word of the name, or its stem: of more than four letters all but two, and
    four at least.  Both are in normal form; labels such as S1 are no names.
    """
    from cutloom.functions import text as X

    first = F.split(F.trim(X.normal(F.col("speaker"))), r"\s+")[0]
    stem = F.when(F.length(first) > 4, F.substring(first, F.lit(1), F.greatest(F.lit(4), F.length(first) - 2))).otherwise(first)
    s = speakers.filter(~F.col("speaker").rlike(r"^S\d+$")).select("media_id", "speaker", stem.alias("_stem")).filter("_stem <> ''").distinct()
    word, gap = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    pattern = F.concat(F.lit(rf"(?<!{word}){SAYS}{gap}+({word}+{gap}+){{0,3}}\Q"), "_stem", F.lit("\\E"))
    return briefs.join(s, "media_id").filter(F.regexp_like(X.normal(F.col("brief")), pattern)).select("brief_id", "speaker")


def target_length(brief: Column) -> Column:
    """Seconds that a brief asks for: an adjective, a number word before a unit, else digits; null if none.

    A number word counts only if no digit stands in the six characters before it.
    """
    low = F.lower(brief)
    number = lambda words, w: F.try_element_at(F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.lit(float(v)))]), w)
    part = lambda p, i: F.regexp_extract(low, p, i)
    seconds = lambda unit: F.when(unit.startswith("m"), 60).otherwise(1)
    whole = lambda x: F.floor(x + 0.5).cast("bigint")
    adjective = part(ADJECTIVE, 2)
    one = F.when(adjective != "", whole(F.coalesce(number(IN_ADJECTIVES, part(ADJECTIVE, 1)), F.lit(1.0)) * seconds(adjective)))
    unit, before = part(UNIT, 2), F.regexp_extract(low, f"(?s)^(.*?){UNIT}", 1)
    free = ~F.substring(low, F.greatest(F.lit(1), F.length(before) - 5), F.least(F.length(before), F.lit(6)) + 1).rlike(r"\d")
    half = F.when(part(UNIT, 3) != "", 0.5).otherwise(0.0)
    two = F.when((unit != "") & free, whole((F.coalesce(number(BEFORE_UNITS, part(UNIT, 1)), F.lit(1.0)) + half) * seconds(unit)))
    digits = F.regexp_replace(part(DIGITS, 1), ",", ".")
    three = F.when(digits != "", whole(digits.cast("double") * seconds(part(DIGITS, 2))))
    return F.coalesce(one, two, three)


def without_host(units: DataFrame, hosts: DataFrame, speakers: int = 3, least: int = 4) -> DataFrame:
    """``units`` (media_id, unit, speaker, text) without the host's statements, if enough speakers and units are left."""
    m = W.partitionBy("media_id")
    u = units.join(hosts.select("media_id", F.col("speaker").alias("_h")), "media_id", "left")
    out = F.coalesce((F.col("speaker") == F.col("_h")) & ~F.contains("text", F.lit("?")), F.lit(False))
    u = u.withColumn("_out", out).withColumn("_left", F.count_if(~F.col("_out")).over(m)).withColumn("_n", F.size(F.collect_set("speaker").over(m)))
    return u.filter(~F.col("_out") | (F.col("_n") < speakers) | (F.col("_left") < least)).select(*units.columns)


def says_voice_over(brief: Column) -> Column:
    """Whether a brief wants pictures under a voice."""
    return F.coalesce(brief.rlike(f"(?iu){VOICE_OVER}"), F.lit(False))


def voice_over(clips: DataFrame, narration: DataFrame, words: DataFrame, said: DataFrame, fewest: int = 20) -> DataFrame:
    """(seq_id, voice_over): sequences with a narration whose brief says so, or whose pictures hold hardly a word.

    ``words`` is (media_id, n), ``said`` (seq_id, said).
    """
    video = clips.filter("kind = 'video'").select("seq_id", "media_id").distinct().join(words, "media_id", "left")
    held = video.groupBy("seq_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_w"))
    found = narration.select("seq_id").distinct().join(held, "seq_id").join(said, "seq_id", "left")
    return found.select("seq_id", (F.coalesce("said", F.lit(False)) | (F.col("_w") < fewest)).alias("voice_over"))


def sample_times(media: DataFrame, n: int = 5) -> DataFrame:
    """(media_id, k, t_ms): ``n`` places from 10 to 85 percent of the duration."""
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("k")
    at = F.col("duration_ms") * (10 * (n - 1) + 75 * F.col("k"))
    return media.select("media_id", "duration_ms", k).select("media_id", "k", F.floor(at / (100 * (n - 1))).cast("bigint").alias("t_ms"))


def upper_median(rows: DataFrame, key: str, value: str, default: int) -> DataFrame:
    """(key, median): the upper one of two middles; ``default`` where there is none."""
    place = F.row_number().over(W.partitionBy(key).orderBy(value))
    n = F.count(value).over(W.partitionBy(key))
    mid = rows.filter(F.col(value).isNotNull()).select(key, value, place.alias("_p"), n.alias("_n")).filter(F.col("_p") == F.floor(F.col("_n") / 2) + 1)
    return rows.select(key).distinct().join(mid.select(key, F.col(value).alias("median")), key, "left").withColumn("median", F.coalesce("median", F.lit(default)))


def run_table(runs: DataFrame) -> DataFrame:
    """Runs (model, sec, cost, length, target, flaws) compared: means per model, the deviation in percent of the target."""
    off = F.abs(F.col("length") - F.col("target")) * 100 / F.col("target")
    return runs.groupBy("model").agg(
        F.count("*").alias("runs"), F.avg("sec").alias("sec"), F.avg("cost").alias("cost"), F.avg("length").alias("length"), F.avg(off).alias("off_pct"), F.sum("flaws").alias("flaws")
    )


def levelled(clips: DataFrame, rules: list[tuple[str, float]], default: float = -22.0, silent: float = -40.0, plain: float = -20.0) -> DataFrame:
    """Music clips (name, keys as array of (t, db)) with their plateau at the first matching rule's level; silent keys stay."""
    loud = F.filter("keys", lambda k: k["db"] > silent)
    plateau = F.coalesce(F.array_max(F.transform(loud, lambda k: k["db"])), F.lit(plain))
    target = F.coalesce(*[F.when(F.contains("name", F.lit(part)), F.lit(db)) for part, db in rules], F.lit(default))
    shift = target - plateau
    return clips.withColumn("keys", F.transform("keys", lambda k: F.struct(k["t"].alias("t"), F.when(k["db"] > silent, k["db"] + shift).otherwise(k["db"]).alias("db"))))


def teaser_picks(units: DataFrame) -> DataFrame:
    """Units of candidates (cand, ord, seg_id, w0, w1, full) as picks: whole sentences, and parts that touch as one range."""
    w = W.partitionBy("cand").orderBy("ord")
    part = ~F.col("full")
    goes_on = part & F.lag(part).over(w) & (F.lag("seg_id").over(w) == F.col("seg_id")) & (F.lag("w1").over(w) == F.col("w0") - 1)
    u = units.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("pick", F.sum("_new").over(w))
    g = u.groupBy("cand", "pick").agg(F.first("seg_id").alias("seg_id"), F.bool_and("full").alias("full"), F.min("w0").alias("w0"), F.max("w1").alias("w1"))
    return g.select("cand", "pick", "seg_id", F.when(~F.col("full"), F.col("w0")).alias("from_word"), F.when(~F.col("full"), F.col("w1")).alias("to_word"))


def completed(picks: DataFrame, segments: DataFrame, excluded: DataFrame, rounds: int = 2) -> DataFrame:
    """Picks (plan_id, media_id, seg_id) with what a cut within a sentence would lose.

    Each round adds the lower-case continuation of a pick by the same speaker,
    and before a pick that continues the sentence before; where that one's
    speaker is excluded (media_id, speaker), or there is none, the pick goes.
    ``segments`` need media_id, seg_id, speaker, low (starts in lower case) and goes_on (continues).
    """
    out = segments.join(excluded.select("media_id", "speaker", F.lit(True).alias("out")), ["media_id", "speaker"], "left")
    near = W.partitionBy("media_id").orderBy("seg_id")
    s = out.select(
        "media_id", "seg_id", "goes_on",
        F.when((F.lead("seg_id").over(near) == F.col("seg_id") + 1) & (F.lead("speaker").over(near) == F.col("speaker")) & F.lead("low").over(near), F.col("seg_id") + 1).alias("after"),
        F.when((F.lag("seg_id").over(near) == F.col("seg_id") - 1) & F.lag("out").over(near).isNull(), F.col("seg_id") - 1).alias("before"),
    )
    p = picks.select("plan_id", "media_id", "seg_id").distinct()
    for _ in range(rounds):
        with_next = p.join(s, ["media_id", "seg_id"])
        kept = p.select("plan_id", "media_id", (F.col("seg_id") + 1).alias("seg_id"), F.lit(True).alias("has"))
        j = with_next.join(kept, ["plan_id", "media_id", "seg_id"], "left")
        need = F.col("goes_on") & F.col("has").isNull()
        stays = j.filter(~need | F.col("before").isNotNull()).select("plan_id", "media_id", "seg_id")
        earlier = j.filter(need & F.col("before").isNotNull()).select("plan_id", "media_id", F.col("before").alias("seg_id"))
        later = j.filter("after is not null").select("plan_id", "media_id", F.col("after").alias("seg_id"))
        p = stays.unionByName(earlier).unionByName(later).distinct()
    return p


def picture_track(sentences: DataFrame, chosen: DataFrame, shots: DataFrame, lead_ms: int = 250, least_ms: int = 200) -> DataFrame:
    """A voice-over's pictures: (track_id, seg_id, k, shot, at_ms, dur_ms, in_ms).

    ``sentences`` (track_id, seg_id, start_ms, total_ms), ``chosen`` (track_id, seg_id, k, shot), ``shots`` (shot, from_ms).
    Pictures change just before a sentence; several share its time evenly, one
    without its own keeps the last, and a repeated shot goes on where it stopped.
    """
    w = W.partitionBy("track_id").orderBy("seg_id")
    start = F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("start_ms") - lead_ms))
    s = sentences.withColumn("_a", start).withColumn("_b", F.coalesce(F.lead("_a").over(w), F.col("total_ms"))).filter(F.col("_b") - F.col("_a") >= least_ms)
    own = chosen.groupBy("track_id", "seg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "shot"))), lambda x: x["shot"]).alias("_s"))
    s = s.join(own, ["track_id", "seg_id"], "left")
    held = F.last(F.element_at("_s", -1), True).over(w.rowsBetween(W.unboundedPreceding, -1))
    first = shots.agg(F.min("shot").alias("_first"))
    s = s.withColumn("_h", held).join(F.broadcast(first))  # one row
    s = s.withColumn("_s", F.coalesce("_s", F.array(F.coalesce("_h", "_first"))))
    each = s.select("track_id", "seg_id", "_a", ((F.col("_b") - F.col("_a")) / F.size("_s")).alias("dur_ms"), F.posexplode("_s").alias("k", "shot"))
    before = F.sum("dur_ms").over(W.partitionBy("track_id", "shot").orderBy("seg_id", "k").rowsBetween(W.unboundedPreceding, -1))
    return each.withColumn("_u", F.coalesce(before, F.lit(0.0))).join(shots, "shot").select(
        "track_id", "seg_id", "k", "shot", (F.col("_a") + F.col("k") * F.col("dur_ms")).alias("at_ms"), "dur_ms", (F.col("from_ms") + F.col("_u")).alias("in_ms")
    )


def extended_backwards(items: DataFrame, fixes: DataFrame) -> DataFrame:
    """Items (seq_id, clip_ix, start_ms, end_ms, in_ms) with fixes (seq_id, clip_ix, more_ms): a clip begins earlier, all after it move."""
    w = W.partitionBy("seq_id").orderBy("clip_ix").rowsBetween(W.unboundedPreceding, -1)
    j = items.join(fixes, ["seq_id", "clip_ix"], "left").withColumn("_l", F.coalesce("more_ms", F.lit(0)))
    j = j.withColumn("_m", F.coalesce(F.sum("_l").over(w), F.lit(0)))
    return j.select("seq_id", "clip_ix", (F.col("start_ms") + F.col("_m")).alias("start_ms"), (F.col("end_ms") + F.col("_m") + F.col("_l")).alias("end_ms"), (F.col("in_ms") - F.col("_l")).alias("in_ms"))


def plan_listing(picks: DataFrame, segments: DataFrame, alternates: DataFrame, removed: DataFrame, most: int = 15) -> DataFrame:
    """(plan_id, listing, alternates, removed): a plan's sentences in order and its alternates, a line each, and what was left out by rule.

    A line is number, speaker, length in tenths of a second (whole milliseconds,
    halves up) and text; ``~`` marks one that starts in lower case.
    ``alternates`` (plan_id, media_id, ord, seg_id) come in their order, those
    picked left out, at most ``most``; ``removed`` (plan_id, kind, seg_id) are
    listed by kind.
    """
    low = F.when(F.col("text").rlike(r"^\p{Ll}"), "~").otherwise("")
    tenths = F.floor((F.col("end_ms") - F.col("start_ms") + 50) / 100)
    line = F.concat(low, F.format_string("%d %s %d.%d s: %s", F.col("seg_id"), F.coalesce("speaker", F.lit("?")), F.floor(tenths / 10), tenths % 10, F.col("text")))
    s = segments.select("media_id", "seg_id", line.alias("line"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["line"]), "\n")
    own = picks.join(s, ["media_id", "seg_id"]).groupBy("plan_id").agg(joined(F.collect_list(F.struct("ord", "line"))).alias("listing"))
    rest = alternates.join(picks.select("plan_id", "media_id", "seg_id"), ["plan_id", "media_id", "seg_id"], "left_anti")
    place = F.row_number().over(W.partitionBy("plan_id").orderBy("ord"))
    rest = rest.withColumn("ord", place).filter(F.col("ord") <= most).join(s, ["media_id", "seg_id"])
    rest = rest.groupBy("plan_id").agg(joined(F.collect_list(F.struct("ord", "line"))).alias("alternates"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("seg_id")), lambda i: F.concat(F.lit("#"), i.cast("string"))), ",")
    gone = removed.groupBy("plan_id", "kind").agg(F.concat("kind", F.lit(" "), ids).alias("x")).groupBy("plan_id").agg(F.array_join(F.array_sort(F.collect_list("x")), "; ").alias("removed"))
    out = own.join(rest, "plan_id", "left").join(gone, "plan_id", "left")
    return out.select("plan_id", "listing", F.coalesce("alternates", F.lit("")).alias("alternates"), F.coalesce("removed", F.lit("")).alias("removed"))


def clean_bounds(frames: DataFrame, words: DataFrame, hop_ms: int, head_ms: int = 450) -> DataFrame:
    """Clips without their leading and trailing run of flagged frames (media_id, frame_no, flagged): media_id, head_ms, tail_ms.

    A head longer than ``head_ms`` goes on to the next word (media_id, s_ms, after_stop) after a stop, else to the next word.
    """
    g = frames.groupBy("media_id").agg(
        F.min(F.when(~F.col("flagged"), F.col("frame_no"))).alias("_a"), F.max(F.when(~F.col("flagged"), F.col("frame_no"))).alias("_b"), F.max("frame_no").alias("_n")
    )
    g = g.select("media_id", (F.coalesce("_a", F.col("_n") + 1) * hop_ms).alias("_h"), ((F.coalesce("_b", F.lit(-1)) + 1) * hop_ms).alias("tail_ms"))
    after = g.filter(F.col("_h") > head_ms).join(words, "media_id").filter("s_ms >= _h").groupBy("media_id")
    after = after.agg(F.min(F.when(F.col("after_stop"), F.col("s_ms"))).alias("_stop"), F.min("s_ms").alias("_any"))
    return g.join(after, "media_id", "left").select("media_id", F.coalesce("_stop", "_any", "_h").alias("head_ms"), "tail_ms")


def edge_levels(edges: DataFrame, frames: DataFrame, hop_ms: int, outside_ms: int, around_ms: int = 2000) -> DataFrame:
    """Edges (media_id, edge_no, t_ms, side: -1 for a start, 1 for an end) with the loudest frame just outside, relative to the speech around (90th percentile)."""
    from cutloom.operators import intervals

    f = frames.select("media_id", (F.col("frame_no") * hop_ms).alias("_ft"), (20 * F.log10(F.greatest(F.col("rms"), F.lit(1e-7)))).alias("db"))
    e = edges.withColumns({"_lo": F.col("t_ms") - around_ms, "_hi": F.col("t_ms") + around_ms})
    met = intervals.overlap_join(e, f, ["media_id"], "_lo", "_hi", "_ft", "_ft")
    far = (F.col("_ft") - F.col("t_ms")) * F.col("side")
    g = met.groupBy("media_id", "edge_no").agg(F.max(F.when((far >= 0) & (far <= outside_ms), F.col("db"))).alias("_d"), F.percentile("db", 0.9).alias("_p"))
    return g.select("media_id", "edge_no", (F.col("_d") - F.col("_p")).alias("level_db"))


def spread(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts' words (text_id, pos, w) over speech spans (text_id, a_ms, b_ms): text_id, pos, t_ms, by their share of characters, skipping pauses."""
    w = W.partitionBy("text_id").orderBy("pos")
    chars = F.length("w") + 1
    t = texts.select("text_id", "pos", (F.sum(chars).over(w) - chars).alias("_c"), F.sum(chars).over(W.partitionBy("text_id")).alias("_all"))
    by = W.partitionBy("text_id").orderBy("a_ms")
    size = F.col("b_ms") - F.col("a_ms")
    s = spans.filter(size > 0).select("text_id", "a_ms", size.alias("_size"), (F.sum(size).over(by) - size).alias("_x"))
    total = s.groupBy("text_id").agg(F.sum("_size").alias("_sum"))
    # Words and spans in the order of spoken time, one sorted union: a word lies in the last span that began.
    words = t.join(total, "text_id").select("text_id", "pos", F.floor(F.col("_c") * F.col("_sum") / F.col("_all")).alias("_x"))
    both = words.unionByName(s.select("text_id", "_x", (F.col("a_ms") - F.col("_x")).alias("_off")), allowMissingColumns=True)
    last = F.last("_off", True).over(W.partitionBy("text_id").orderBy("_x", F.col("pos").isNotNull()).rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("_o", last).filter("pos is not null").select("text_id", "pos", (F.col("_x") + F.col("_o")).alias("t_ms"))


def repaired_json(text: str | None) -> str:
    """Cut JSON as far as its last whole value, with the brackets closed; ``{}`` where there is none."""
    import json
    import re

    body = (text or "")[max(0, (text or "").find("{")) :]
    if not body.startswith("{"):
        return "{}"
    # Strings are one mark, so that brackets in them don't count.
    open_, best = "", None
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|$)|[][{}]', body, re.S):
        c = m[0]
        if c in "{[":
            open_ += c
        elif c in "}]":
            open_ = open_[:-1]
            best = m.end(), open_
    if best is None:
        return "{}"
    closed = body[: best[0]] + "".join({"{": "}", "[": "]"}[c] for c in reversed(best[1]))
    try:
        return json.dumps(json.loads(closed), ensure_ascii=False)
    except ValueError:
        return "{}"

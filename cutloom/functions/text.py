"""Text columns: normal forms, time codes, predicates, corrections."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The combining marks that a normal form drops.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def _decomposed() -> tuple[str, str]:
    """Every letter that is a letter with marks, and that letter: all of the basic plane by their decomposition."""
    found = {}
    for c in map(chr, range(0xA0, 0xD800)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and all(m in MARKS for m in marks):
            found[c] = base
    return "".join(found), "".join(found.values())


MARKED, PLAIN = _decomposed()

#: Letters of which Java makes several large ones, and the one large letter of each.
SPREADING = "".join(c for c in map(chr, range(0xDF, 0xD800)) if len(c.upper()) > 1) + "".join(map(chr, [*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18)]))
SINGLE = "".join({"ß": "ẞ"}.get(c, c.title() if len(c.title()) == 1 else c) for c in SPREADING)


def normal(text: Column) -> Column:
    """Lower case without marks, whether a letter holds them or they follow it."""
    return F.translate(F.lower(text), MARKED + MARKS, PLAIN)


def large(text: Column) -> Column:
    """Upper case letter by letter, so that none becomes two: a sharp s is a large sharp s."""
    one = lambda c: F.when(F.length(F.upper(c)) > 1, F.translate(c, SPREADING, SINGLE)).otherwise(F.upper(c))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def tokens(text: Column) -> Column:
    """Normal words: everything but letters and digits separates."""
    return F.filter(F.split(F.regexp_replace(normal(text), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def timecode(ms: Column) -> Column:
    """HH:MM:SS.cc"""
    return F.format_string("%02d:%02d:%02d.%02d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, F.floor(ms / 10) % 100)


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm"""
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def parse_srt_time(text: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm; null if it isn't one."""
    p = r"^\s*(\d+):(\d\d):(\d\d)[,.](\d{3})\s*$"
    part = lambda i: F.regexp_extract(text, p, i).cast("bigint")
    return F.when(text.rlike(p), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def ends_sentence(text: Column) -> Column:
    return F.rtrim(text).rlike(r"[.!?…]$")


def starts_lower(text: Column) -> Column:
    return text.rlike(r"^\s*\p{Ll}")


def default_title(text: Column, n: int = 6) -> Column:
    """The first ``n`` words, with an ellipsis if there are more."""
    words = F.split(F.trim(text), r"\s+")
    return F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, "…").otherwise(""))


def corrected(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Dictionary corrections of whole words, in order, whatever the case."""
    for wrong, right in rules:
        text = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])\Q{wrong}\E(?![\p{{L}}\p{{N}}])", right.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def correction_rules(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rules (wrong, right) of a dictionary text, one ``wrong = right`` a line; blanks and # lines don't count."""
    parts = F.split(value, "=", 2)
    t = lines.filter(~F.col(value).rlike(r"^\s*(#|$)") & F.contains(F.col(value), F.lit("=")))
    return t.select(F.trim(parts[0]).alias("wrong"), F.trim(parts[1]).alias("right")).filter("wrong <> '' and right <> ''")


def phrase_hits(segments: DataFrame, phrase: str, context: int = 1) -> DataFrame:
    """Sentences that hold a phrase on word boundaries (normal form), with their neighbours: media_id, seg_id, hit."""
    from pyspark.sql import Window as W

    hit = F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" ")).contains(f" {phrase} ")
    near = W.partitionBy("media_id").orderBy("seg_id").rowsBetween(-context, context)
    s = segments.select("media_id", "seg_id", hit.cast("int").alias("h")).withColumn("_n", F.max("h").over(near))
    return s.filter("_n = 1").select("media_id", "seg_id", (F.col("h") == 1).alias("hit"))


def stem_pattern(phrase: str) -> str:
    """A phrase whose longer words may end otherwise: of five letters or more the last two are free, four stay."""
    words = [rf"\Q{w[: max(4, len(w) - 2)]}\E[\p{{L}}\p{{N}}]*" if len(w) >= 5 else rf"\Q{w}\E" for w in phrase.split()]
    return r"\s+".join(words)


def phrase_or_stem_hits(segments: DataFrame, phrase: str, context: int = 1) -> DataFrame:
    """Sentences that hold a phrase (in normal form) between word borders, with their neighbours: media_id, seg_id, hit, by_stem.

    A recording without the phrase itself is searched by its stems.
    """
    from pyspark.sql import Window as W

    body = normal(F.col("text"))
    found = lambda p: body.rlike(rf"(?<![\p{{L}}\p{{N}}]){p}(?![\p{{L}}\p{{N}}])")
    m = W.partitionBy("media_id")
    s = segments.select("media_id", "seg_id", found(rf"\Q{phrase}\E").alias("_e"), found(stem_pattern(phrase)).alias("_s"))
    s = s.withColumn("by_stem", ~F.max("_e").over(m)).withColumn("hit", F.when(F.col("by_stem"), F.col("_s")).otherwise(F.col("_e")))
    near = m.orderBy("seg_id").rowsBetween(-context, context)
    return s.withColumn("_n", F.max("hit").over(near)).filter("_n").select("media_id", "seg_id", "hit", "by_stem")


def target_seconds(brief: Column) -> Column:
    """Target length in seconds that a brief names in digits; null if none."""
    t = F.lower(brief)
    minutes = F.regexp_extract(t, r"(\d+)\s*(?:min|m\b)", 1)
    seconds = F.regexp_extract(t, r"(\d+)\s*(?:s\b|sec|sek)", 1)
    m, s = F.when(minutes != "", minutes.cast("bigint")), F.when(seconds != "", seconds.cast("bigint"))
    return F.when(m.isNotNull() | s.isNotNull(), F.coalesce(m * 60, F.lit(0)) + F.coalesce(s, F.lit(0)))

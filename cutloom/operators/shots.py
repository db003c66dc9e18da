"""Frames and shots: boundaries, features, voices' places on screen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutloom.operators import intervals


def boundaries(frames: DataFrame, threshold: float = 20.0, shortest: int = 3) -> DataFrame:
    """Shots of clips (media_id, frame_no, diff): media_id, shot, first_frame, last_frame.

    A shot begins where the difference is over the threshold and over twice the
    larger of its neighbours; very short shots belong to the one before.
    """
    w = W.partitionBy("media_id").orderBy("frame_no")
    beside = F.greatest(F.coalesce(F.lag("diff").over(w), F.lit(0.0)), F.coalesce(F.lead("diff").over(w), F.lit(0.0)))
    new = (F.col("diff") > threshold) & (F.col("diff") > 2 * beside)
    s = frames.withColumn("_s", F.sum(F.when(new, 1).otherwise(0)).over(w))
    shots = s.groupBy("media_id", "_s").agg(F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"))
    v = W.partitionBy("media_id").orderBy("first_frame")
    long_ = (F.col("last_frame") - F.col("first_frame") + 1 >= shortest) | (F.row_number().over(v) == 1)
    kept = shots.withColumn("_l", long_.cast("int")).withColumn("shot", F.sum("_l").over(v))
    return kept.groupBy("media_id", "shot").agg(F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"))


def variants(items: DataFrame) -> DataFrame:
    """Items (seq_id, ord, shot) numbered: parity in the shot, every third a punch, every fifth a shake: seq_id, ord, parity, variant."""
    n = F.row_number().over(W.partitionBy("seq_id", "shot").orderBy("ord"))
    all_ = F.row_number().over(W.partitionBy("seq_id").orderBy("ord"))
    kind = F.when(all_ % 5 == 0, "shake").when(all_ % 3 == 0, "punch").otherwise("plain")
    return items.select("seq_id", "ord", (n % 2).alias("parity"), kind.alias("variant"))


def on_screen(items: DataFrame, segments: DataFrame, seated: DataFrame) -> DataFrame:
    """The speaker with most sentence time in an item (media_id, item, a_ms, b_ms), if seated (layout, speaker): media_id, item, speaker."""
    s = segments.select("media_id", "start_ms", "end_ms", "speaker")
    met = intervals.overlap_join(items, s, ["media_id"], "a_ms", "b_ms", "start_ms", "end_ms")
    time = F.greatest(F.lit(0), F.least("b_ms", "end_ms") - F.greatest("a_ms", "start_ms"))
    per = met.groupBy("media_id", "item", "layout", "speaker").agg(F.sum(time).alias("t")).filter("t > 0")
    best = per.groupBy("media_id", "item", "layout").agg(F.max_by("speaker", F.struct("t", "speaker")).alias("speaker"))
    return best.join(seated, ["layout", "speaker"], "left_semi").select("media_id", "item", "speaker")


def borrowed(items: DataFrame, far_ms: int = 20_000) -> DataFrame:
    """Missing positions (seq_id, ord, t_ms, speaker, x) from the nearest good item of the speaker: seq_id, ord, x."""
    good = items.filter("x is not null").select("seq_id", "speaker", F.col("t_ms").alias("_gt"), F.col("x").alias("_gx"))
    need = items.filter("x is null").select("seq_id", "speaker", "ord", "t_ms")
    met = intervals.overlap_join(need, good, ["seq_id", "speaker"], "t_ms", "t_ms", "_gt", "_gt", slack_ms=far_ms, bucket_ms=far_ms)
    found = met.groupBy("seq_id", "ord").agg(F.min_by("_gx", F.struct(F.abs(F.col("_gt") - F.col("t_ms")), "_gt")).alias("_b"))
    return items.join(found, ["seq_id", "ord"], "left").select("seq_id", "ord", F.coalesce("x", "_b").alias("x"))


def first_rule(features: DataFrame, rules: DataFrame, default: str = "other") -> DataFrame:
    """Shot types: the first rule (ord, alt_no, feature, lo, hi, type) of which one alternative holds wholly.

    ``features`` is long (shot_id, feature, value); bounds are lower inclusive, upper exclusive unless 1.
    """
    inside = (F.col("value") >= F.col("lo")) & ((F.col("value") < F.col("hi")) | (F.col("hi") == 1) & (F.col("value") <= 1))
    size = rules.groupBy("ord", "alt_no").agg(F.count("*").alias("_need"))
    met = features.join(F.broadcast(rules), "feature").filter(inside)  # a fixed table of rules
    whole = met.groupBy("shot_id", "ord", "alt_no", "type").agg(F.count("*").alias("_have")).join(F.broadcast(size), ["ord", "alt_no"]).filter("_have = _need")
    best = whole.groupBy("shot_id").agg(F.min_by("type", F.struct("ord", "alt_no")).alias("type"))
    return features.select("shot_id").distinct().join(best, "shot_id", "left").withColumn("type", F.coalesce("type", F.lit(default)))

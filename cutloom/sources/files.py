"""Readers and writers of the documents around recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom import schemas


def _ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("bigint")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript documents, one JSON file per recording: media_id (path), source, duration_ms, language, created_at, segments."""
    t = spark.read.schema(schemas.TRANSCRIPT).option("multiLine", True).json(path)
    return t.select(F.lower(F.replace("source", F.lit("\\"), F.lit("/"))).alias("media_id"), "source", _ms(F.col("duration")).alias("duration_ms"), "language", F.col("createdAt").alias("created_at"), "segments")


def transcript_words(documents: DataFrame) -> DataFrame:
    """media_id, seg_id, pos, w, s_ms, e_ms, p, spk; a word without speaker has its sentence's."""
    s = documents.select("media_id", F.explode("segments").alias("s"))
    w = s.select("media_id", F.col("s.id").cast("bigint").alias("seg_id"), F.col("s.speaker").alias("_spk"), F.posexplode("s.words").alias("pos", "w"))
    return w.select("media_id", "seg_id", F.col("pos").cast("bigint").alias("pos"), "w.w", _ms(F.col("w.s")).alias("s_ms"), _ms(F.col("w.e")).alias("e_ms"), "w.p", F.coalesce("w.spk", "_spk").alias("spk"))


def diarizations(spark: SparkSession, path: str) -> DataFrame:
    """Diarization documents: media_id, method, turns, centroids, speaking_time."""
    d = spark.read.schema(schemas.DIARIZATION).option("multiLine", True).json(path)
    return d.select(F.lower(F.replace("source", F.lit("\\"), F.lit("/"))).alias("media_id"), "method", "turns", "centroids", F.col("speakingTime").alias("speaking_time"))


def diarization_turns(documents: DataFrame) -> DataFrame:
    t = documents.select("media_id", F.explode("turns").alias("t"))
    return t.select("media_id", "t.speaker", _ms(F.col("t.start")).alias("t_start"), _ms(F.col("t.end")).alias("t_end"))


def original_path(files: DataFrame, conversions: DataFrame) -> DataFrame:
    """``files`` (path) with ``original``: what a converted file was made from, else itself (conversions: converted, original)."""
    c = conversions.select(F.lower("converted").alias("_c"), F.col("original").alias("_o"))
    return files.join(c, F.lower("path") == F.col("_c"), "left").withColumn("original", F.coalesce("_o", "path")).drop("_c", "_o")


def result_key(*columns: Column) -> Column:
    """First 12 hex digits of a hash over what a result depends on."""
    return F.substring(F.sha1(F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)]))), 1, 12)


def to_do(jobs: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Jobs without a result yet."""
    return jobs.join(done.select(key), key, "left_anti")


def plan_picks(texts: DataFrame, value: str = "value") -> DataFrame:
    """Picks in a free text (plan_id, value) with a JSON plan: plan_id, ord, seg_id, from_word, to_word.

    From the first brace to the last; a pick is a number or an object.  Texts without picks give no rows.
    """
    body = F.regexp_extract(value, r"(?s)\{.*\}", 0)
    picks = F.from_json(F.get_json_object(body, "$.picks"), "array<string>")
    p = texts.select("plan_id", F.posexplode(picks).alias("ord", "x"))
    field = lambda n: F.get_json_object("x", f"$.{n}").cast("bigint")
    plain = F.col("x").rlike(r"^\s*\d+\s*$")
    return p.select("plan_id", F.col("ord").cast("bigint").alias("ord"), F.when(plain, F.trim("x").cast("bigint")).otherwise(field("id")).alias("seg_id"), F.when(~plain, field("fromWord")).alias("from_word"), F.when(~plain, field("toWord")).alias("to_word"))


def append_feedback(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FEEDBACK).json(path)


def run_log(lines: DataFrame) -> DataFrame:
    """Agent runs (run, value: one JSON event a line) in numbers: run, turns, tools, tokens_in, tokens_out, cost; broken lines don't count."""
    e = lines.withColumn("_p", F.monotonically_increasing_id()).withColumn("e", F.from_json("value", schemas.RUN_EVENT)).filter("e.type is not null")
    return e.groupBy("run").agg(
        F.count_if(F.col("e.type") == "assistant").alias("turns"), F.count_if(F.col("e.type") == "tool").alias("tools"),
        F.sum("e.usage.input").alias("tokens_in"), F.sum("e.usage.output").alias("tokens_out"), F.max_by("e.cost", F.when(F.col("e.cost").isNotNull(), F.col("_p"))).alias("cost"),
    )


def readable(segments: DataFrame) -> DataFrame:
    """media_id, value: a transcript to read, one line per sentence."""
    line = F.concat(F.lit("#"), F.col("seg_id"), F.lit(" ["), F.coalesce("speaker", F.lit("-")), F.lit("] "), F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seg_id", line.alias("l")))), lambda x: x["l"])
    return segments.groupBy("media_id").agg(F.array_join(ordered, "\n").alias("value"))


def write_texts(texts: DataFrame, path: str, key: str) -> None:
    """One folder of text files per key."""
    texts.select(key, "value").write.mode("overwrite").partitionBy(key).text(path)

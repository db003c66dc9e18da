"""Schemas of the media tables.  Times are whole milliseconds (``*_ms``)."""

from __future__ import annotations

from pyspark.sql import types as T

WORD = T.StructType(
    [
        T.StructField("w", T.StringType()),
        T.StructField("s_ms", T.LongType()),
        T.StructField("e_ms", T.LongType()),
        T.StructField("p", T.DoubleType()),
        T.StructField("spk", T.StringType()),
    ]
)
SEGMENT = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField(
            "words",
            T.ArrayType(
                T.StructType(
                    [T.StructField(n, t) for n, t in (("w", T.StringType()), ("s", T.DoubleType()), ("e", T.DoubleType()), ("p", T.DoubleType()), ("spk", T.StringType()))]
                )
            ),
        ),
    ]
)
TRANSCRIPT = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("language", T.StringType()),
        T.StructField("multilingual", T.BooleanType()),
        T.StructField("model", T.StringType()),
        T.StructField("speakers", T.ArrayType(T.StringType())),
        T.StructField("createdAt", T.StringType()),
        T.StructField("wordCount", T.IntegerType()),
        T.StructField("segments", T.ArrayType(SEGMENT)),
    ]
)
DIARIZATION = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("numSpeakers", T.IntegerType()),
        T.StructField("speakingTime", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("centroids", T.MapType(T.StringType(), T.ArrayType(T.FloatType()))),
        T.StructField(
            "turns",
            T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("speaker", T.StringType())])),
        ),
    ]
)
FEEDBACK = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("rating", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("targetSec", T.DoubleType()),
        T.StructField("prompt", T.StringType()),
    ]
)
RUN_EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("usage", T.StructType([T.StructField("input", T.LongType()), T.StructField("output", T.LongType())])),
    ]
)

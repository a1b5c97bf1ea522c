"""Streaming ingest: texts as they arrive, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def text_stream(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """(path, text) of new files of a folder, whole texts."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"))


def ingest_stream(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Parse each micro-batch and append it to a folder of its own, so that a replayed batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, group: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by tumbling window and group, for rows no later than the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), group, "n")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str = "30 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)

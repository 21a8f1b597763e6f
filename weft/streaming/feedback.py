"""Feedback and file changes as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def pair_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(source, target, question, hits, first_seen, last_seen) of a stream (event_id, at, source, target, question).

    Events that are told twice within the watermark count once.
    """
    once = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("source", "target", "question").agg(F.count("*").alias("hits"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) of a stream (at, kind, value) by tumbling or sliding windows."""
    span = F.window("at", width, slide) if slide else F.window("at", width)
    grouped = events.withWatermark("at", late).groupBy(span.alias("span"), "kind")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("span.start").alias("start"), "kind", "n", "total")


def watch_files(spark: SparkSession, folder: str, update: Callable[[DataFrame, int], None], checkpoint: str, every: str = "3 seconds") -> StreamingQuery:
    """Call ``update`` with the new and changed files (path, modificationTime, length, content) of a folder, in batches."""
    schema = StructType.fromDDL("path string, modificationTime timestamp, length long, content binary")
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return files.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def drain(frame: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, into a table in memory, and return it."""
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)

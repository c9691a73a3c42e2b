"""Incremental analysis of a source folder with Structured Streaming; an extension.

A file source brings new files; a file whose text was seen already is dropped
by its hash within the watermark; what is left passes the line-local
operators, whose rows are appended to a table for each batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.existing import scan_existing
from ..operators.lines import scan_lines


def new_sources(spark: SparkSession, folder: str, remember: str = "1 day", files_per_batch: int = 100) -> DataFrame:
    """A stream of file, source, content_hash, seen_at: each content once."""
    raw = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rs").option("maxFilesPerTrigger", files_per_batch).option("wholetext", "true").schema("value string").format("text").load(folder)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("source"), F.sha2("value", 256).alias("content_hash"), F.col("_metadata.file_modification_time").alias("seen_at"))
    return rows.withWatermark("seen_at", remember).dropDuplicatesWithinWatermark(["file", "content_hash"])


def watch_existing(sources: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the instrumentation that each new file holds; a replayed batch replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        scan_existing(scan_lines(batch.select("file", "source"))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return sources.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts of event types by window of event time, with late events up to `late`."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")

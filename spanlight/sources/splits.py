"""Lines of text files of any size: files are read in splits, and line numbers hold across them (F-2, F-5).

Spark's text reader gives each split of a file to some task, whole and in
order.  Lines are counted for each split; the counts before a split, added up,
are the number of its first line.  No file and no array of lines is ever one
row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .files import stored_path
from .tables import written


def _read(spark: SparkSession, path: str, name: str | None) -> DataFrame:
    """path, block, task, at, value of every line; at counts the rows of a task."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if name:
        reader = reader.option("pathGlobFilter", name)
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    return reader.text(path).select(*place, F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), "value")


def split_counts(rows: DataFrame) -> DataFrame:
    """path, block, task, first, n, before of each split, as a written table: its first row, its lines and those before it in its file."""
    by = rows.groupBy("path", "block", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # A row for each split of a file, some 8,000 for each TB.
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return written(by.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))), "splits")


def _same(c: Column, what: str) -> Column:
    return F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"files changed while their lines were numbered: {what}")).cast("bigint"))


def scan_text_lines(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """file, line (from 1), raw, text (trimmed) of each line of the files of that name below a path.

    Lines end at \\n; one \\r goes off each end, and there is no empty line
    after a last \\n, as `operators.lines.scan_lines` has it.  Files are read
    twice with the same splits; a split that the first pass has not seen is an
    error.  Compressed files are one split each.
    """
    rows = _read(spark, path, name)
    counts = split_counts(rows).select("path", "block", "task", (F.col("before") + 1 - F.col("first")).alias("shift"))
    # Joined as its size decides: broadcast while it is small, which leaves lines where they were read.
    numbered = rows.join(counts, ["path", "block", "task"], "left")
    raw = F.regexp_replace("value", r"\r\z", "")
    line = (F.col("at") + _same(F.col("shift"), "a split is new")).cast("int")
    return numbered.select(stored_path().alias("file"), line.alias("line"), raw.alias("raw")).select("file", "line", "raw", trimmed(F.col("raw")).alias("text"))


def count_text_lines(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """file, line_count of the files of that name below a path; files without a line have no row (F-5)."""
    rows = _read(spark, path, name).groupBy("path").agg(F.count("*").alias("line_count"))
    return rows.select(stored_path().alias("file"), "line_count")

"""Line scan of source files (F-2, F-4, F-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, trimmed


def line_array(source: Column) -> Column:
    """The lines of a text: cut at \\n, one \\r off each end, no empty line after a last \\n."""
    parts = F.split(source, "\n", -1)
    some = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(some, lambda x: F.when(F.endswith(x, F.lit("\r")), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def scan_lines(files: DataFrame) -> DataFrame:
    """file, line (from 1), raw, text (trimmed) of each line (F-2).

    Lines are trimmed before they are exploded, so that a filter on text below
    is on a column and not on a copy of what makes it.
    """
    both = F.transform(line_array(F.col("source")), lambda x: F.struct(x.alias("raw"), trimmed(x).alias("text")))
    rows = files.select("file", F.posexplode(both).alias("at", "x"))
    return rows.select("file", (F.col("at") + 1).alias("line"), "x.raw", "x.text")


def lines_with(files: DataFrame, marks: list[str]) -> DataFrame:
    """scan_lines without the lines that hold none of the marks; files that hold none are not even cut into lines."""
    some = files.filter(contains_any(F.col("source"), marks))
    both = F.transform(line_array(F.col("source")), lambda x, i: F.struct((i + 1).alias("line"), x.alias("raw"), trimmed(x).alias("text")))
    rows = some.select("file", F.explode(F.filter(both, lambda x: contains_any(x["raw"], marks))).alias("x"))
    return rows.select("file", "x.*")


def cut_once(files: DataFrame, marks: list[str]) -> DataFrame:
    """file, line_count, marked: how many lines a file has, and those that hold one of the marks, from one cut of its text.

    To be written, so that every detector and the counts read what one scan found.
    """
    parts = files.select("file", line_array(F.col("source")).alias("parts"), contains_any(F.col("source"), marks).alias("some"))
    both = F.transform("parts", lambda x, i: F.struct((i + 1).alias("line"), x.alias("raw"), trimmed(x).alias("text")))
    chosen = F.when(F.col("some"), F.filter(both, lambda x: contains_any(x["raw"], marks))).otherwise(F.array().cast("array<struct<line:int,raw:string,text:string>>"))
    return parts.select("file", F.size("parts").cast("bigint").alias("line_count"), chosen.alias("marked"))


def marked_lines(cut: DataFrame) -> DataFrame:
    """file, line, raw, text of what cut_once has."""
    return cut.select("file", F.explode("marked").alias("x")).select("file", "x.*")


def line_counts(files: DataFrame) -> DataFrame:
    """file, line_count (F-5)."""
    return files.select("file", F.size(line_array(F.col("source"))).cast("bigint").alias("line_count"))


def content_hashes(files: DataFrame) -> DataFrame:
    """file, content_hash: SHA-256 of the text in lower-case hex (F-4)."""
    return files.select("file", F.sha2("source", 256).alias("content_hash"))

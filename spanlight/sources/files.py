"""Source trees as tables (F-1, F-3, F-8, F-9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_EXCLUDES


def stored_path(path: str = "path") -> Column:
    """The path of a scanned file as it was given: not as a URL, and without the scheme of local files."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^file:(//)?", "")


def scan_files(spark: SparkSession, paths: list[str], exclude: list[str] | None = None, suffix: str = ".rs") -> DataFrame:
    """file, source of every source below each path (F-1).

    A path that ends in the suffix is taken as it is; below a folder, files
    whose path holds an excluded text anywhere are dropped.  Overlapping paths
    give their files more than once.  The exclusion is a filter on the path
    that Spark's file index applies, so what is excluded is not read.  Spark's file index passes over files of no bytes;
    they have no lines and nothing to find.
    """
    exclude = DEFAULT_EXCLUDES if exclude is None else exclude
    parts = []
    for path in paths:
        single = path.endswith(suffix)
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if not single:
            reader = reader.option("pathGlobFilter", f"*{suffix}")
        rows = reader.load(path)
        for word in [] if single else exclude:
            rows = rows.filter(~F.contains(stored_path("_metadata.file_path"), F.lit(word)))
        parts.append(rows.select(stored_path().alias("file"), F.decode("content", "UTF-8").alias("source")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "file string, source string")


def distinct_files(files: DataFrame) -> DataFrame:
    """One row for each path: adding a file again changes nothing (F-9)."""
    return files.dropDuplicates(["file"])

"""Line dedup [native]: hashes in range partitions, runs streamed in document order.

Each line becomes a 128-bit hash with its document and position.  The hashes
are range-partitioned with a document salt and sorted by document and position
inside each run, so one pass over a run finds first occurrences and document
changes; the few numbers of a key's runs are then added up.  A key that holds a
third of all lines is split over SALTS runs, and joins on it are split by AQE.
What returns per document is its keep bitmap, compressed to runs of kept
lines, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

SALTS = 64
STRIPPED = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at both ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def occurrences(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, tid, pos, h1, h2, salt of each line whose key has min_chars code points at least."""
    keys = F.transform(lines_of(F.col("text")), line_key)
    hashed = F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("second"), k).alias("h2"), (F.length(k) >= min_chars).alias("counted")))
    rows = scratch.keyed(docs).select("doc_id", "tid", F.posexplode(hashed).alias("pos", "x"))
    return rows.filter("x.counted").select("doc_id", "tid", "pos", "x.h1", "x.h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))


def dropped_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, mode: str = "all") -> DataFrame:
    """doc_id, tid, pos of lines to drop.

    mode "all": every line whose key is found in min_docs documents at least.
    mode "first": every line but the first, by doc_id and position, of each key
    that is found in min_docs documents at least.  Rows with one doc_id count
    as one document.  A null doc_id counts as one document that comes first.
    """
    occ = scratch.written(occurrences(docs, min_chars), "lines")
    ranged = occ.repartitionByRange("h1", "h2", "salt")
    run = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "tid", "pos")
    streamed = ranged.withColumn("nth", F.row_number().over(run)).withColumn(
        "fresh", (F.col("nth") == 1) | ~F.lag("doc_id").over(run).eqNullSafe(F.col("doc_id"))
    )
    runs = streamed.groupBy("h1", "h2", "salt").agg(
        F.sum(F.col("fresh").cast("bigint")).alias("n"), F.min(F.when(F.col("nth") == 1, F.struct("doc_id", "tid", "pos"))).alias("first")
    )
    keys = runs.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first")).filter(F.col("n_docs") >= min_docs)
    # Written first, so that the join deals both sides anew and AQE can split a key that very many lines have.
    hits = occ.join(scratch.written(keys, "line-keys"), ["h1", "h2"])
    if mode == "first":
        hits = hits.filter(~F.struct("doc_id", "tid", "pos").eqNullSafe(F.col("first")))
    return hits.select("doc_id", "tid", "pos")


KEEP = "array<struct<start:int,length:int>>"


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """doc_id, tid, keep: the keep bitmap of each document that loses lines, as its runs of ones.

    A run has its first line and its length; that of the last run is null, as
    it goes on to the end of the text.
    """
    lines = dropped.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    before = F.coalesce(F.get("gone", F.lit(0)), F.lit(0))
    first = F.struct(F.lit(0).alias("start"), before.cast("int").alias("length"))
    after = F.transform("gone", lambda p, i: F.struct((p + 1).cast("int").alias("start"), (F.get("gone", i + 1) - p - 1).cast("int").alias("length")))
    runs = F.filter(F.concat(F.array(first), after), lambda r: F.coalesce(r["length"] > 0, F.lit(True)))
    return lines.select("doc_id", "tid", runs.cast(KEEP).alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines that a keep bitmap keeps; all where it is null."""
    part = F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, F.coalesce(r["length"], F.size(lines))))
    return F.when(keep.isNull(), lines).otherwise(F.flatten(part))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, mode: str = "all") -> DataFrame:
    """doc_id, text, n_lines, n_dropped, kept_text, keep (null: nothing dropped) of every row.

    Null and empty texts have one empty line, which has no key and stays.  A
    text whose lines all go becomes ''.  Repeated rows get the same answer
    each; an empty table gives no rows; other columns are ignored.
    """
    bitmaps = scratch.written(keep_bitmaps(dropped_lines(docs, min_docs, min_chars, mode)), "bitmaps")
    hit, clean = scratch.split_by_ids(scratch.keyed(docs), bitmaps, "tid")
    marks = bitmaps.select(F.col("doc_id").alias("b_id"), F.col("tid").alias("b_tid"), "keep")
    joined = hit.join(marks, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("tid") == F.col("b_tid")), "left").select("doc_id", "text", "keep")
    rows = joined.unionByName(clean.select("doc_id", "text", F.lit(None).cast(KEEP).alias("keep")))
    rows = rows.withColumn("all_lines", lines_of(F.col("text")))
    rows = rows.withColumn("kept_lines", kept_lines(F.col("all_lines"), F.col("keep")))
    return rows.select(
        "doc_id",
        "text",
        F.size("all_lines").cast("bigint").alias("n_lines"),
        (F.size("all_lines") - F.size("kept_lines")).cast("bigint").alias("n_dropped"),
        F.array_join("kept_lines", "\n").alias("kept_text"),
        "keep",
    )

"""Shared plumbing: tables in the shared folder, bounded id filters, components.

Intermediate results that several jobs read are written as Parquet below
``spark.checkpoint.dir`` (the folder that driver and executors share), so a
lost executor never loses them and lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running
from ..sources.tables import discard, written, written_with

__all__ = ["connected_components", "discard", "id_filter", "keyed", "running", "split_by_ids", "text_id", "written", "written_with"]

#: Bits of the id filter that `split_by_ids` broadcasts: 8 for each id, within these bounds (1 and 32 MB).
FILTER_BITS, FILTER_BITS_MAX = 1 << 23, 1 << 28


def text_id(text: Column | str = "text") -> Column:
    """A 64-bit fingerprint of the text that tells rows with one doc_id apart."""
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, tid and the named columns; whatever else the table has is left behind."""
    return docs.select("doc_id", "text", text_id().alias("tid"), *more)


def _filter_position(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + F.lit(1).cast("bigint")


def id_filter(ids: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """A Bloom-style filter of ids in at most bits / 32768 rows of 4 KB."""
    at = ids.select(_filter_position(F.col(key), bits).alias("at")).filter(F.col("at").isNotNull())
    return at.groupBy(F.bitmap_bucket_number("at").alias("f_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("f_bits")
    )


def filter_bits(n: int) -> int:
    """The size of a filter of n ids: a power of two, 8 bits an id where the bounds allow."""
    return min(max(FILTER_BITS, 1 << (8 * n - 1).bit_length()), FILTER_BITS_MAX)


def split_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ids, rows whose key is certainly not), without shuffling df.

    ids is a written table or cheap to count.  The filter that is broadcast
    has 32 MB at most, enough to tell 200 million ids apart from others but
    for one row in two.  When ids outgrow it, more rows take the first way,
    which joins exactly, so results never change.
    """
    bits = filter_bits(ids.count())
    table = F.broadcast(written(id_filter(ids, key, bits), "filter"))
    at = _filter_position(F.col(key), bits)
    bit = F.bitmap_bit_position(at)
    marked = (
        df.withColumns({"f_bucket": F.bitmap_bucket_number(at), "f_bit": bit})
        .join(table, "f_bucket", "left")
        .withColumn(
            "f_in",
            F.coalesce(
                F.expr("shiftright(cast(conv(hex(substring(f_bits, cast(f_bit div 8 as int) + 1, 1)), 16, 10) as bigint), cast(f_bit % 8 as int)) & 1"),
                F.lit(0),
            )
            == 1,
        )
    )
    drop = ("f_bucket", "f_bit", "f_bits", "f_in")
    return marked.filter("f_in").drop(*drop), marked.filter("not f_in").drop(*drop)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, comp) for every end of (src, dst): comp is the least id it is linked to.

    Alternates large-star and small-star steps, so the number of rounds grows
    with the logarithm of the longest path; each round is a written table.
    They are done when every id is either less than all that it is linked to or
    linked to one lesser id alone; only the count of others reaches the driver,
    with the writing job.
    """
    start = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()
    e = written(start, name)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written before it is joined, so that AQE can split an id with very many edges.
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least, told = written_with(least, name + "-least", between=F.count_if(F.expr("m < u and n > 1")))
        if not told["between"]:
            break
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        hung = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = written(hung.filter("u <> v").distinct(), name)
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("comp"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots).distinct()

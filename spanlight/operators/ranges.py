"""Ranks and running sums over a whole table, by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def running(df: DataFrame, order: list[Column], sums: dict[str, str], name: str = "ranged") -> DataFrame:
    """df as a written table with, for each (column, total) of sums, the total of column over the rows before each row.

    Rows are dealt to ranges of `order`, whose values should be distinct but
    for rows that are equal, and summed within each range; the ranges' own
    totals, one row for each, are added up in one task.  The result follows
    from the rows and their order alone, however they are partitioned.
    """
    keys = [f"o_{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order)))
    ranged = written(keyed.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys]).withColumn("range", F.spark_partition_id()), name)
    base = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(*[F.sum(c).alias(t) for c, t in sums.items()])
    totals = written(totals.select(F.col("range").alias("b_range"), *[F.coalesce(F.sum(t).over(base), F.lit(0)).alias(f"b_{t}") for t in sums.values()]), name + "-bases")
    within = Window.partitionBy("range").orderBy(*[F.col(k).asc_nulls_last() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({t: F.coalesce(F.sum(c).over(within), F.lit(0)) for c, t in sums.items()})
    # One row a range, of which there are as many as shuffle partitions.
    out = out.join(F.broadcast(totals), F.col("range") == F.col("b_range"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(t) + F.col(f"b_{t}")).alias(t) for t in sums.values()])


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with n, its rank from 1 in the order of the columns."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    one = df.withColumn("r_one", F.lit(1).cast("bigint"))
    return running(one, keys, {"r_one": "n"}).withColumn("n", (F.col("n") + 1).cast("int")).drop("r_one")

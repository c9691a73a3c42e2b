"""Dependencies and what they gate (D-1 to D-5, D-7 to D-9, A-19, J-11, R-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import contains_any


def crate_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.CRATES, "category string, crate string, label string")


def classify_deps(deps: DataFrame) -> DataFrame:
    """project, category, label: recognised dependencies, once each (D-1, J-11)."""
    crates = F.broadcast(crate_table(deps.sparkSession))  # 33 fixed rows
    return deps.join(crates, F.col("dep_name") == F.col("crate")).select("project", "category", "label").distinct()


def detection_context(deps: DataFrame) -> DataFrame:
    """project, has_*, *_priority for each project that has dependencies (D-3, R-14)."""
    crates = F.broadcast(crate_table(deps.sparkSession))
    known = deps.join(crates, F.col("dep_name") == F.col("crate"), "left")
    has = lambda c: F.bool_or(F.coalesce(F.col("category") == c, F.lit(False)))
    out = known.groupBy("project").agg(has("database").alias("has_db"), has("http_client").alias("has_http"), has("cache").alias("has_cache"), has("observability").alias("has_observability"), F.bool_or(F.coalesce(F.col("label") == "tracing", F.lit(False))).alias("has_tracing"))
    grade = lambda c, yes, no: F.when(F.col(c), yes).otherwise(no)
    return out.withColumns({"db_priority": grade("has_db", 0.9, 0.3), "http_priority": grade("has_http", 0.85, 0.3), "cache_priority": grade("has_cache", 0.8, 0.2)})


def dependency_summary(deps: DataFrame) -> DataFrame:
    """project, summary: a line for each category with its labels in order (A-19)."""
    by = classify_deps(deps).groupBy("project", "category").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
    order = F.create_map(*[x for i, (c, _) in enumerate(K.CATEGORY_TITLES) for x in (F.lit(c), F.lit(i))])
    title = F.create_map(*[x for c, t in K.CATEGORY_TITLES for x in (F.lit(c), F.lit(t))])
    rows = by.select("project", F.struct(order[F.col("category")].alias("o"), F.concat(title[F.col("category")], F.lit(": "), "labels").alias("t")).alias("x"))
    lines = rows.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("summary"))
    return deps.select("project").distinct().join(lines, "project", "left").select("project", F.coalesce("summary", F.lit(K.NO_DEPENDENCIES)).alias("summary"))


def framework_by_deps(deps: DataFrame) -> DataFrame:
    """project, framework: the first of the known frameworks among the dependencies, else Unknown (D-4)."""
    rank = F.lit(None).cast("int")
    for i, (_, crate) in reversed(list(enumerate(K.FRAMEWORKS))):
        rank = F.when(F.col("dep_name") == crate, i).otherwise(rank)
    best = deps.groupBy("project").agg(F.min(rank).alias("r"))
    return best.select("project", F.coalesce(F.get(F.array(*[F.lit(f) for f, _ in K.FRAMEWORKS]), F.col("r")), F.lit("Unknown")).alias("framework"))


def framework_by_source(files: DataFrame) -> DataFrame:
    """project, framework: of the first file, by name, that shows a marker (D-5)."""
    found = F.lit(None).cast("string")
    for name, marks in reversed(K.FRAMEWORK_MARKERS):
        found = F.when(contains_any(F.col("source"), marks), F.lit(name)).otherwise(found)
    seen = files.withColumn("fw", found)
    first = seen.groupBy("project").agg(F.min_by("fw", F.when(F.col("fw").isNotNull(), F.col("file"))).alias("fw"))
    return first.select("project", F.coalesce("fw", F.lit("Unknown")).alias("framework"))


def crate_usage(files: DataFrame) -> DataFrame:
    """file, label: crates whose texts of use a source shows (D-2)."""
    found = [F.when(contains_any(F.col("source"), marks), F.lit(label)) for label, marks in K.CRATE_USAGE.items()]
    return files.select("file", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("label"))

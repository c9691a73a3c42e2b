"""Suggested instrumentation points (G-1 to G-5, R-9, J-3, J-4, T-1, P-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import choose, endpoint_span, percent_text, priority_score, span_name

FIELDS = "array<struct<name:string,expression:string,is_sensitive:boolean>>"
COLUMNS = ["file", "line", "function_name", "kind", "priority", "reason", "suggested_span_name", "suggested_fields", "phase"]


def fields_of(kind: Column) -> Column:
    """Suggested fields of a kind (G-4)."""
    table = {
        k: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(e).alias("expression"), F.lit(False).alias("is_sensitive")) for n, e in fields]).cast(FIELDS) for k, fields in K.KIND_FIELDS.items()
    }
    return choose(kind, table, F.array().cast(FIELDS))


def reaches(priority: Column, threshold: float) -> Column:
    """Whether a priority's share of 4 reaches the threshold (R-9)."""
    return priority_score(priority) / 4.0 >= threshold


def endpoint_points(endpoints: DataFrame) -> DataFrame:
    """A critical point for each endpoint, whatever the threshold (G-1, S-8)."""
    return endpoints.select(
        "file", "line", F.col("handler").alias("function_name"), F.lit("Endpoint").alias("kind"), F.lit("Critical").alias("priority"),
        F.concat("method", F.lit(" endpoint handler")).alias("reason"), endpoint_span(F.col("method"), F.col("path")).alias("suggested_span_name"),
        fields_of(F.lit("Endpoint")).alias("suggested_fields"), F.lit(1).alias("phase"),
    )


def pattern_points(matches: DataFrame, degrees: DataFrame, threshold: float) -> DataFrame:
    """A point for each classified function whose priority reaches the threshold (G-2, P-8, J-3)."""
    names = F.create_map(*[x for c, n, _ in K.CATEGORIES for x in (F.lit(c), F.lit(n))])
    base = F.when(F.col("category").isin(K.HIGH_CATEGORIES), "High").when(F.col("category") == "BusinessLogic", "Medium").otherwise("Low")
    known = matches.join(degrees.select("id", "callers"), "id", "left").withColumn("base", base)
    lifted = (F.col("base") == "Medium") & ((F.coalesce("callers", F.lit(0)) > 5) | (F.col("confidence") > 0.95))
    rows = known.withColumn("priority", F.when(lifted, "High").otherwise(F.col("base"))).filter(reaches(F.col("priority"), threshold))
    kind = choose(F.col("category"), K.CATEGORY_KINDS, F.lit("BusinessLogic"))
    return rows.withColumn("kind", kind).select(
        "file", "line", F.col("id").alias("function_name"), "kind", "priority",
        F.concat(F.lit("Matched "), names[F.col("category")], F.lit(" pattern with "), percent_text(F.col("confidence")), F.lit("% confidence")).alias("reason"),
        span_name(F.col("kind"), F.col("id")).alias("suggested_span_name"), fields_of(F.col("kind")).alias("suggested_fields"), F.lit(2).alias("phase"),
    )


def connectivity_points(nodes: DataFrame, degrees: DataFrame, present: DataFrame, threshold: float) -> DataFrame:
    """A point for each well-connected node that is no point yet (G-3, J-4)."""
    known = nodes.join(degrees.select("id", "callers", "callees"), "id").filter((F.col("callers") > 5) | (F.col("callees") > 10))
    rows = known.withColumn("priority", F.when(F.col("callers") > 10, "High").otherwise("Medium")).filter(reaches(F.col("priority"), threshold))
    fresh = rows.join(present.select(F.col("function_name").alias("id")).distinct(), "id", "left_anti")
    return fresh.select(
        "file", "line", F.col("id").alias("function_name"), F.lit("BusinessLogic").alias("kind"), "priority",
        F.format_string("High connectivity: %d callers, %d callees", "callers", "callees").alias("reason"), F.col("id").alias("suggested_span_name"),
        F.array().cast(FIELDS).alias("suggested_fields"), F.lit(3).alias("phase"),
    )


def all_points(endpoints: DataFrame, matches: DataFrame, nodes: DataFrame, degrees: DataFrame, threshold: float = K.DEFAULT_THRESHOLD) -> DataFrame:
    """The points of the three phases together (G-5); `ordered` gives their order."""
    first = endpoint_points(endpoints).unionByName(pattern_points(matches, degrees, threshold))
    return first.unionByName(connectivity_points(nodes, degrees, first, threshold))


def ordered(points: DataFrame) -> DataFrame:
    """By score, then phase, then place (T-1)."""
    return points.orderBy(priority_score(F.col("priority")).desc(), "phase", "file", "line", "function_name")

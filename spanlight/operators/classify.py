"""Classification of functions by their names (P-1 to P-3, D-7 to D-9, S-1, T-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import name_has


def _first_match(rules: list[tuple[Column, str, Column | float]]) -> Column:
    out = None
    for when, category, confidence in rules:
        value = F.struct(F.lit(category).alias("category"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out


def classify_in_context(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """nodes with category and confidence; gated by the project's dependencies, first rule wins (P-1).

    nodes and context share `project`; the match is on the whole node id, and
    nodes that no rule matches give no row.
    """
    name = F.col("id")
    both = nodes.join(F.broadcast(context), "project")  # a row for each project
    rules = [
        (F.col("has_db") & name_has(name, K.DB_GATED), "Database", F.col("db_priority")),
        (F.col("has_http") & name_has(name, K.HTTP_GATED), "HttpClient", F.col("http_priority")),
        (F.col("has_cache") & name_has(name, K.CACHE_GATED), "Cache", F.col("cache_priority")),
        (name_has(name, K.ERROR_WORDS), "ErrorHandling", 0.8),
        (name_has(name, K.BUSINESS_WORDS), "BusinessLogic", 0.7),
        (F.col("has_db") & name_has(name, K.DB_NAIVE), "Database", 0.7),
        (F.col("has_http") & name_has(name, K.HTTP_NAIVE), "HttpClient", 0.6),
    ]
    return both.withColumn("m", _first_match(rules)).filter("m is not null").select(*[F.col(c) for c in nodes.columns], "m.category", "m.confidence")


def classify_naive(nodes: DataFrame) -> DataFrame:
    """nodes with category and confidence, without any gate (P-2)."""
    name = F.col("id")
    rules = [
        (name_has(name, K.DB_NAIVE), "Database", 0.9),
        (name_has(name, K.HTTP_NAIVE), "HttpClient", 0.85),
        (name_has(name, K.ERROR_WORDS), "ErrorHandling", 0.8),
        (name_has(name, K.BUSINESS_WORDS), "BusinessLogic", 0.7),
    ]
    return nodes.withColumn("m", _first_match(rules)).filter("m is not null").select(*[F.col(c) for c in nodes.columns], "m.category", "m.confidence")

"""Weighted pattern matching over source text (P-4 to P-9, A-9 to A-13, J-13, R-10, S-16, T-3, U-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from . import automaton

Pattern = tuple[str, str, float, bool]


def merge_patterns(*sets: list[Pattern]) -> list[Pattern]:
    """Sets one after the other (U-4)."""
    return [p for s in sets for p in s]


def add_pattern(patterns: list[Pattern], category: str, pattern: str, weight: float, is_regex: bool = False) -> list[Pattern]:
    """With one more; a category that is no group becomes a framework's (U-4, V-5)."""
    known = {"function_names", "attributes", "assertions", "error_handling", "modules", "imports"}
    return [*patterns, (category if category in known else f"framework:{category}", pattern, weight, is_regex)]


def match_patterns(texts: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    """doc, ord, grp, pattern, weight, matched for every match (P-4, P-5, P-9, J-13).

    A regular expression counts at each occurrence, a plain text once (S-16).
    All patterns pass a text together, see `automaton`.
    """
    return automaton.matches(texts, K.PATTERNS if patterns is None else patterns)


def confidence(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """doc, confidence, n_matches: the mean weight, 1 at most, 0 without matches (A-9)."""
    by = matches.groupBy("doc").agg(F.round(F.least(F.avg("weight"), F.lit(1.0)), 6).alias("c"), F.count("*").alias("n"))
    return texts.select("doc").join(by, "doc", "left").select("doc", F.coalesce("c", F.lit(0.0)).alias("confidence"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_matches"))


def category_scores(matches: DataFrame) -> DataFrame:
    """doc, category, score: weights of patterns with a category's words, over the greatest (A-10)."""
    holds = [F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("pattern"), w)), F.lit(c)) for c, words in K.CATEGORY_WORDS]
    rows = matches.select("doc", "weight", F.explode(F.filter(F.array(*holds), lambda x: x.isNotNull())).alias("category"))
    by = rows.groupBy("doc", "category").agg(F.sum("weight").alias("w"))
    return by.select("doc", "category", F.round(F.col("w") / F.max("w").over(Window.partitionBy("doc")), 6).alias("score"))


def _category_order(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x, _, _ in K.CATEGORIES]), c)


def top_categories(scores: DataFrame, n: int) -> DataFrame:
    """The n best categories of each doc, with rank; ties go by the categories' order (T-3)."""
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("score").desc(), _category_order(F.col("category"))))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= n)


def best_category(texts: DataFrame, scores: DataFrame) -> DataFrame:
    """doc, category: the best, or Unknown (A-11, P-7)."""
    best = top_categories(scores, 1).select("doc", "category")
    return texts.select("doc").join(best, "doc", "left").select("doc", F.coalesce("category", F.lit("Unknown")).alias("category"))


def frameworks(matches: DataFrame) -> DataFrame:
    """doc, frameworks: those with a match, in order (A-13)."""
    found = matches.filter(F.col("grp").startswith("framework:"))
    return found.groupBy("doc").agg(F.array_sort(F.collect_set(F.regexp_replace("grp", "^framework:", ""))).alias("frameworks"))


def merged_scores(parts: DataFrame) -> DataFrame:
    """doc, category, score: scores of parts that are normalised already, added and normalised again (A-12)."""
    by = parts.groupBy("doc", "category").agg(F.sum("score").alias("w"))
    return by.select("doc", "category", F.round(F.col("w") / F.max("w").over(Window.partitionBy("doc")), 6).alias("score"))


def confident(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows whose confidence reaches the threshold, which is held within 0 and 1 (R-10)."""
    return results.filter(F.col("confidence") >= min(max(threshold, 0.0), 1.0))

"""Measures over a table of functions (R-1 to R-4, A-4 to A-7, A-20, J-10, C-16, M-3, M-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import needs_refactoring, risk_level


def by_complexity(functions: DataFrame, threshold: int) -> DataFrame:
    """More complex than the threshold (R-1)."""
    return functions.filter(F.col("cyclomatic") > threshold)


def unsafe_handling(functions: DataFrame) -> DataFrame:
    """With an unwrap or expect (R-2)."""
    return functions.filter((F.col("unwrap_calls") > 0) | (F.col("expect_calls") > 0))


def async_functions(functions: DataFrame) -> DataFrame:
    return functions.filter("is_async")  # R-3


def by_line_count(functions: DataFrame, threshold: int) -> DataFrame:
    """Longer than the threshold (R-4)."""
    return functions.filter(F.col("lines_of_code") > threshold)


def risks(functions: DataFrame) -> DataFrame:
    """name, risk, refactor (M-3, M-4)."""
    c = F.col
    return functions.select("file", "name", risk_level(c("cyclomatic")).alias("risk"), needs_refactoring(c("cyclomatic"), c("cognitive"), c("lines_of_code"), c("max_nesting_depth")).alias("refactor"))


def average_complexity(functions: DataFrame) -> DataFrame:
    """One row; 0 without functions (A-4)."""
    return functions.filter("not is_test").agg(F.coalesce(F.round(F.avg("cyclomatic"), 6), F.lit(0.0)).alias("average_complexity"))


def error_handling_score(functions: DataFrame) -> DataFrame:
    """Percentage of functions that are not unsafe and handle errors or return none; 100 without functions (A-5)."""
    unsafe = (F.col("unwrap_calls") > 0) | (F.col("expect_calls") > 0)
    safe = (F.col("question_mark_ops") > 0) | (F.col("error_matches") > 0) | (F.col("error_if_lets") > 0)
    good = ~unsafe & (safe | (F.col("result_returns") == 0))
    return functions.filter("not is_test").agg(F.coalesce(F.round(F.avg(good.cast("double")) * 100, 6), F.lit(100.0)).alias("error_handling_score"))


def most_complex(functions: DataFrame) -> DataFrame:
    """file, name, cyclomatic of the most complex function, the last of equals by ord (A-6)."""
    best = functions.filter("not is_test").agg(F.max_by(F.struct("file", "name", "cyclomatic"), F.struct("cyclomatic", "ord")).alias("x"))
    return best.filter("x is not null").select("x.*")


def test_coverage_estimate(functions: DataFrame) -> DataFrame:
    """Tests per function as a percentage, 100 at most and without functions (A-7)."""
    n = functions.agg(F.count_if("is_test").alias("t"), F.count_if(~F.col("is_test")).alias("f"))
    return n.select(F.when(F.col("f") == 0, 100.0).otherwise(F.round(F.least(F.col("t") / F.col("f"), F.lit(1.0)) * 100, 6)).alias("test_coverage_estimate"))


def callees(functions: DataFrame) -> DataFrame:
    """file, name, callees: distinct, in order (A-20, U-5)."""
    return functions.select("file", "name", F.array_sort(F.array_distinct(F.transform("calls", lambda c: c["callee"]))).alias("callees"))


def callers_of(functions: DataFrame, target: str) -> DataFrame:
    """Functions that call the target by its raw text (J-10)."""
    return functions.filter(F.exists("calls", lambda c: c["callee"] == target))


def recursive(functions: DataFrame) -> DataFrame:
    """Functions that call their own name or a path that ends in it (C-16)."""
    return functions.filter(F.exists("calls", lambda c: (c["callee"] == F.col("name")) | F.endswith(c["callee"], F.concat(F.lit("::"), F.col("name")))))

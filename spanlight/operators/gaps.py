"""Points without instrumentation, and coverage (G-6 to G-8, J-1, J-2, A-2, A-3, R-7, R-8, R-15, T-2, W-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import choose
from .ranges import numbered

SEVERITY_ORDER = {"Critical": 0, "Major": 1, "Minor": 2}


def uncovered_nearby(points: DataFrame, existing: DataFrame) -> DataFrame:
    """Points with no instrumentation in their file on their line or one beside it (J-1, W-4).

    A point's three lines become join keys, so the band is an equi join.
    """
    seen = existing.select(F.col("file").alias("e_file"), F.explode(F.array_distinct(F.array(F.col("line") - 1, "line", F.col("line") + 1))).alias("e_line"))
    # Line 0 looks one up as well: its line before is itself.
    return points.join(seen.distinct(), (F.col("file") == F.col("e_file")) & (F.col("line") == F.col("e_line")), "left_anti")


def uncovered_strict(points: DataFrame, existing: DataFrame) -> DataFrame:
    """Points with no instrumentation in their file on their very line or in their function (J-2)."""
    by_line = existing.select(F.col("file").alias("e_file"), F.col("line").alias("e_line")).distinct()
    by_name = existing.select(F.col("file").alias("f_file"), F.col("function_name").alias("f_name")).distinct()
    rest = points.join(by_line, (F.col("file") == F.col("e_file")) & (F.col("line") == F.col("e_line")), "left_anti")
    return rest.join(by_name, (F.col("file") == F.col("f_file")) & (F.col("function_name") == F.col("f_name")), "left_anti")


def kind_name(kind: Column) -> Column:
    from ..functions.constants import KIND_NAMES

    return choose(kind, KIND_NAMES)


def gaps_live(points: DataFrame, existing: DataFrame) -> DataFrame:
    """Gaps by nearness, with severity from priority (G-6)."""
    severity = F.when(F.col("priority") == "Critical", "Critical").when(F.col("priority") == "High", "Major").otherwise("Minor")
    return uncovered_nearby(points, existing).select(
        "file", "line", "function_name",
        F.concat("function_name", F.lit(" ("), kind_name(F.col("kind")), F.lit(") has no instrumentation")).alias("description"),
        F.concat(F.lit('#[instrument(name = "'), "suggested_span_name", F.lit('")]')).alias("suggested_fix"),
        severity.alias("severity"),
    )


def rich_fix(kind: Column, span: Column, fields: Column, function: Column) -> Column:
    """A fix with the fields that are not sensitive and what the kind skips (G-8, R-15)."""
    shown = F.transform(F.filter(fields, lambda f: ~f["is_sensitive"]), lambda f: F.concat(f["name"], F.lit(" = %"), f["expression"]))
    listed = F.when(F.size(shown) > 0, F.concat(F.lit(", "), F.array_join(shown, ", "))).otherwise("")
    skip = choose(kind, {"Endpoint": ", skip_all", "DatabaseCall": ", skip(self)", "ExternalApiCall": ", skip(client)"}, F.lit(""))
    start = F.when(kind.isin("Endpoint", "DatabaseCall", "ExternalApiCall"), "async fn ").otherwise("fn ")
    return F.concat(F.lit('#[instrument(name = "'), span, F.lit('"'), listed, skip, F.lit(", err)]\n"), start, function, F.lit("(...) { ... }"))


def gaps_strict(points: DataFrame, existing: DataFrame, degrees: DataFrame) -> DataFrame:
    """Gaps by line or function, with severity from kind and degree (G-7, G-8)."""
    rest = uncovered_strict(points, existing).join(degrees.select(F.col("id").alias("function_name"), "callers", "callees"), "function_name", "left")
    busy = (F.coalesce("callers", F.lit(0)) > 3) | (F.coalesce("callees", F.lit(0)) > 5)
    kind = F.col("kind")
    severity = F.when(kind.isin("Endpoint", "ExternalApiCall"), "Critical").when(busy | kind.isin("DatabaseCall", "BusinessLogic"), "Major").otherwise("Minor")
    return rest.select(
        "file", "line", "function_name",
        F.concat(kind_name(kind), F.lit(" '"), "function_name", F.lit("' has no instrumentation")).alias("description"),
        rich_fix(kind, F.col("suggested_span_name"), F.col("suggested_fields"), F.col("function_name")).alias("suggested_fix"),
        severity.alias("severity"),
    )


def by_severity(gaps: DataFrame) -> DataFrame:
    """Critical first (T-2)."""
    return gaps.orderBy(choose(F.col("severity"), SEVERITY_ORDER), "file", "line", "function_name")


def ranked(gaps: DataFrame) -> DataFrame:
    """gaps with n, their rank in that order, by ranges (T-2)."""
    return numbered(gaps, choose(F.col("severity"), SEVERITY_ORDER), "file", "line", "function_name")


def at_least(gaps: DataFrame, severity: str | None) -> DataFrame:
    """Gaps of a severity or a worse one (R-7, R-8)."""
    if severity in (None, "Minor"):
        return gaps
    return gaps.filter(F.col("severity").isin([s for s, n in SEVERITY_ORDER.items() if n <= SEVERITY_ORDER[severity]]))


def coverage_check(points: DataFrame, gaps: DataFrame, threshold: float, critical_only: bool = False) -> DataFrame:
    """One row: total_points, gaps, covered, coverage, threshold, passed, critical_only (A-2)."""
    n = points.agg(F.count("*").alias("total_points"))
    g = at_least(gaps, "Critical" if critical_only else None).agg(F.count("*").alias("gaps"))
    both = n.withColumn("one", F.lit(1)).join(g.withColumn("one", F.lit(1)), "one")
    covered = F.greatest(F.col("total_points") - F.col("gaps"), F.lit(0))
    out = both.withColumn("covered", covered.cast("bigint"))
    out = out.withColumn("coverage", F.when(F.col("total_points") > 0, F.round(F.col("covered") / F.col("total_points") * 100, 6)).otherwise(100.0))
    return out.select("total_points", "gaps", "covered", "coverage", F.lit(float(threshold)).alias("threshold"), (F.col("coverage") >= threshold).alias("passed"), F.lit(critical_only).alias("critical_only"))


def coverage_strict(points: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: coverage of points by line or function; 100 without points (A-3)."""
    all_ = points.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    open_ = uncovered_strict(points, existing).agg(F.count("*").alias("u")).withColumn("one", F.lit(1))
    return all_.join(open_, "one").select(F.when(F.col("n") == 0, 100.0).otherwise(F.round((F.col("n") - F.col("u")) / F.col("n") * 100, 6)).alias("coverage"))

"""Naming rules of spans (N-0 to N-4, U-2)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any

COLUMNS = "file, line, function_name, kind, severity, message, suggestion"


@dataclass
class NamingRules:
    endpoint_prefix: str | None = None
    database_prefix: str | None = None
    external_prefix: str | None = None
    cache_prefix: str | None = None
    forbidden_patterns: list[str] = field(default_factory=list)
    required_endpoint_attrs: list[str] = field(default_factory=list)
    required_database_attrs: list[str] = field(default_factory=list)

    def forbidden(self) -> list[str]:
        """Patterns that compile and use no look-around; the others are left out without a word (N-1)."""
        good = []
        for p in self.forbidden_patterns:
            try:
                re.compile(p)
            except re.error:
                continue
            if not re.search(r"\(\?<?[=!]|\\\d", p):
                good.append(p)
        return good


def _violation(when: Column, kind: str, severity: str, message: Column, suggestion: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), message.alias("message"), suggestion.alias("suggestion")))


def _rows(df: DataFrame, found: list[Column]) -> DataFrame:
    function = F.col("function_name") if "function_name" in df.columns else F.lit("")
    picked = df.select("file", "line", function.alias("function_name"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v"))
    return picked.select("file", "line", "function_name", "v.*")


def _prefixed(name: Column, prefix: Column, severity: str, of: Column | None, suggestion: str) -> Column:
    middle = F.concat(F.lit("' for "), of, F.lit(" should")) if of is not None else F.lit("' should")
    message = F.concat(F.lit("Span name '"), name, middle, F.lit(" start with prefix '"), prefix, F.lit("'"))
    told = F.concat(F.lit(suggestion + " '"), prefix, name, F.lit("'"))
    return _violation(prefix.isNotNull() & ~F.startswith(name, prefix), "NamingConvention", severity, message, told)


def check_existing(existing: DataFrame, rules: NamingRules) -> DataFrame:
    """Violations of instrumentation that is there: forbidden texts, then prefixes (N-2, N-3)."""
    name = F.col("span_name")
    found = [
        _violation(name.rlike(p), "ForbiddenPattern", "Error", F.concat(F.lit("Span name '"), name, F.lit(f"' matches forbidden pattern '{p}'")), F.lit("Remove or obfuscate sensitive information from span name"))
        for p in rules.forbidden()
    ]
    null = F.lit(None).cast("string")
    prefix = (
        F.when(~F.col("kind").isin("TracingInstrument", "ManualSpan"), null)
        .when(contains_any(name, ["db", "sql", "query"]), F.lit(rules.database_prefix))
        .when(contains_any(name, ["cache", "redis"]), F.lit(rules.cache_prefix))
        .when(contains_any(name, ["api", "http", "grpc"]), F.lit(rules.endpoint_prefix))
        .when(contains_any(name, ["external", "client"]), F.lit(rules.external_prefix))
    ).cast("string")
    found.append(_prefixed(name, prefix, "Warning", None, "Rename span to"))
    return _rows(existing.filter(name.isNotNull()), found)


def check_points(points: DataFrame, rules: NamingRules) -> DataFrame:
    """Violations of suggested span names (N-4)."""
    name, kind = F.col("suggested_span_name"), F.col("kind")
    found = [
        _violation(name.rlike(p), "ForbiddenPattern", "Warning", F.concat(F.lit("Suggested span name '"), name, F.lit(f"' matches forbidden pattern '{p}'")), F.lit("Adjust pattern detection to avoid sensitive names"))
        for p in rules.forbidden()
    ]
    table = {"Endpoint": rules.endpoint_prefix, "DatabaseCall": rules.database_prefix, "ExternalApiCall": rules.external_prefix, "CacheOperation": rules.cache_prefix}
    prefix = F.lit(None).cast("string")
    for k, v in table.items():
        prefix = F.when(kind == k, F.lit(v)).otherwise(prefix)
    found.append(_prefixed(name, prefix.cast("string"), "Info", kind, "Use"))
    return _rows(points, found)


def check_all(existing: DataFrame, points: DataFrame, rules: NamingRules) -> DataFrame:
    """Violations of both (N-0, U-2)."""
    return check_existing(existing, rules).unionByName(check_points(points, rules))


def missing_attributes(points: DataFrame, rules: NamingRules) -> DataFrame:
    """A violation for each required field that a point does not suggest (N-5); an extension, not part of check_all."""
    kind, names = F.col("kind"), F.transform("suggested_fields", lambda f: f["name"])
    found = []
    for of, attrs in (("Endpoint", rules.required_endpoint_attrs), ("DatabaseCall", rules.required_database_attrs)):
        for a in attrs:
            lacking = (kind == of) & ~F.array_contains(names, a)
            found.append(_violation(lacking, "MissingAttribute", "Warning", F.concat(F.lit("Span '"), "suggested_span_name", F.lit(f"' lacks attribute '{a}'")), F.lit(f"Add field '{a}'")))
    if not found:
        found = [_violation(F.lit(False), "MissingAttribute", "Warning", F.lit(""), F.lit(""))]
    return _rows(points, found)

"""Existing instrumentation in source lines (X-1 to X-6, A-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import contains_any, instrument_name, quoted

ISSUE = "array<struct<kind:string,message:string>>"


def quality_issues(line: Column) -> Column:
    """What an attribute line lacks: skips of large and of sensitive fields, and err handling (X-6)."""
    skips = F.contains(line, F.lit("skip"))
    issue = lambda when, kind, message: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(message).alias("message")))
    found = [issue(contains_any(line, K.LARGE_WORDS) & ~skips, "MissingSkip", "Large fields should use skip or skip_all")]
    found += [issue(F.contains(line, F.lit(w)) & ~skips, "SensitiveData", f"Sensitive field '{w}' should be skipped or redacted") for w in K.SENSITIVE_WORDS]
    handled = F.contains(line, F.lit("err = true")) | F.contains(line, F.lit("err("))
    found.append(issue(F.contains(line, F.lit("err")) & ~handled, "NoErrorHandling", "Consider adding err = true for error tracking"))
    return F.filter(F.array(*found), lambda x: x.isNotNull()).cast(ISSUE)


def quality_score(line: Column) -> Column:
    """1 less 0.2, 0.3 for each sensitive word and 0.1, and 0 at least (A-18)."""
    cost = {"MissingSkip": 0.2, "SensitiveData": 0.3, "NoErrorHandling": 0.1}
    total = F.aggregate(quality_issues(line), F.lit(1.0), lambda a, x: a - sum((F.when(x["kind"] == k, v).otherwise(0.0) for k, v in cost.items()), F.lit(0.0)))
    return F.greatest(F.round(total, 6), F.lit(0.0))


#: One of these is in every line that sets off a detector.
MARKS = ["instrument", *K.SPAN_MARKS, *K.LOG_MARKS, *K.METRIC_MARKS]


def scan_existing(lines: DataFrame) -> DataFrame:
    """file, line, ord, kind, span_name, score, issues: a row for each detector that a line sets off (X-1 to X-5)."""
    text = F.col("text")
    none, clean, no_issue = F.lit(None).cast("string"), F.lit(1.0), F.array().cast(ISSUE)
    attribute = text.startswith("#[instrument") | text.startswith("#[tracing::instrument")

    def hit(order: int, when: Column, kind: str, name: Column, score: Column, issues: Column) -> Column:
        fields = F.struct(F.lit(order).alias("ord"), F.lit(kind).alias("kind"), name.alias("span_name"), score.alias("score"), issues.alias("issues"))
        return F.when(when, fields)

    hits = F.array(
        hit(1, attribute, "TracingInstrument", instrument_name(text), quality_score(text), quality_issues(text)),
        hit(2, contains_any(text, K.SPAN_MARKS), "ManualSpan", quoted(text), clean, no_issue),
        hit(3, contains_any(text, K.LOG_MARKS), "LogMacro", none, clean, no_issue),
        hit(4, contains_any(text, K.METRIC_MARKS), "Metrics", none, clean, no_issue),
    )
    # One cheap test spares lines without any mark the rest; no mark begins or ends with white space.
    rows = lines.filter(contains_any(F.col("raw"), MARKS)).select("file", "line", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("x"))
    return rows.select("file", "line", "x.*")

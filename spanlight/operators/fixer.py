"""Source edits for gaps (H-1 to H-8, W-2, W-3, W-5, T-4, T-6, J-12, A-16, A-17, U-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import attribute_of, indentation
from ..sources.tables import checkpointed
from .gaps import SEVERITY_ORDER
from .lines import line_array, scan_lines

IMPORT = "use tracing::instrument;"


def insertion_points(files: DataFrame, gaps: DataFrame) -> DataFrame:
    """gaps with target_line, indentation, content (H-1, H-2, S-14, S-15, W-2).

    Above the gap's line, doc comments and attributes are passed; the first
    other line is the stop and the insertion goes right below it.  An
    instrument attribute on the way, or none but passed lines, puts it right
    before the function.  A line beyond the file stays, without indentation.
    """
    text = F.col("text")
    passed = text.startswith("///") | text.startswith("//!") | (text.startswith("#[") & ~F.contains(text, F.lit("instrument")))
    above = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.when(~passed, F.struct("line", (text.startswith("#[")).alias("is_attribute")))
    lines = scan_lines(files).withColumn("stop", F.last(stop, ignorenulls=True).over(above))
    at = lines.select(F.col("file").alias("l_file"), F.col("line").alias("l_line"), "raw", "stop")
    # A gap on line 0 looks at line 1.
    joined = gaps.join(at, (F.col("file") == F.col("l_file")) & (F.greatest("line", F.lit(1)) == F.col("l_line")), "left")
    here = F.greatest("line", F.lit(1))
    target = F.when(F.col("l_line").isNull(), F.col("line")).when(F.col("stop").isNull() | F.col("stop.is_attribute"), here).otherwise(F.col("stop.line") + 1)
    return joined.select(
        *[F.col(c) for c in gaps.columns], target.cast("int").alias("target_line"), F.coalesce(indentation(F.col("raw")), F.lit("")).alias("indentation"), attribute_of(F.col("suggested_fix")).alias("content")
    )


def _joined(rows: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "kind", "nth", "content"))), lambda x: x["content"])
    return rows.groupBy("file").agg(F.array_join(ordered, "\n").alias("content"))


def apply_insertions(files: DataFrame, insertions: DataFrame) -> DataFrame:
    """file, source with every insertion before its target line (H-3, T-4); later rows of one line come first.

    insertions: file, target_line, indentation, content, ord.
    """
    sized = files.select("file", F.size(line_array(F.col("source"))).alias("n"), F.endswith("source", F.lit("\n")).alias("closed"))
    old = scan_lines(files).select("file", F.col("line").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("nth"), F.col("raw").alias("content"))
    new = insertions.join(sized.select("file", "n"), "file").filter(F.col("target_line") <= F.col("n") + 1)
    new = new.select("file", F.greatest("target_line", F.lit(1)).alias("at"), F.lit(0).alias("kind"), (-F.col("ord")).alias("nth"), F.concat("indentation", "content").alias("content"))
    return _joined(old.unionByName(new)).join(sized, "file").select("file", F.concat("content", F.when(F.col("closed"), "\n").otherwise("")).alias("source"))


def ensure_import(files: DataFrame) -> DataFrame:
    """file, source, was_added: the import after the first block of uses, else after inner docs and attributes (H-4)."""
    source = F.col("source")
    has = lambda t: F.contains(source, F.lit(t))
    present = has("use tracing::instrument") | has("use tracing::*") | (has("use tracing::{") & has("instrument")) | has("tracing::instrument")
    lines = scan_lines(files.filter(~present))
    text = F.col("text")
    is_use = text.startswith("use ")
    so_far = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    inner = text.startswith("//!") | text.startswith("#![")
    started = F.coalesce(F.max(is_use.cast("int")).over(so_far), F.lit(0)) == 1
    ends = started & ~is_use & ~inner & (text != "") & ~text.startswith("//")
    marked = lines.withColumn("ended", ends.cast("int")).withColumn("over", F.coalesce(F.max("ended").over(Window.partitionBy("file").orderBy("line")), F.lit(0)))
    alive = marked.filter("over = 0")
    at = alive.groupBy("file").agg(F.max(F.when(is_use, F.col("line"))).alias("last_use"), F.max(F.when(inner, F.col("line"))).alias("last_inner"))
    spot = files.filter(~present).select("file").join(at, "file", "left").select("file", (F.coalesce("last_use", "last_inner", F.lit(0)) + 1).alias("target_line"), F.lit("").alias("indentation"), F.lit(IMPORT).alias("content"), F.lit(0).alias("ord"))
    added = apply_insertions(files.filter(~present), spot).withColumn("was_added", F.lit(True))
    return added.unionByName(files.filter(present).select("file", "source", F.lit(False).alias("was_added")))


def diff_previews(files: DataFrame, insertions: DataFrame) -> DataFrame:
    """insertions with diff: two lines before, the new line, two lines after (H-7, W-3)."""
    known = files.select(F.col("file").alias("s_file"), line_array(F.col("source")).alias("all_lines"))
    joined = insertions.join(known, F.col("file") == F.col("s_file"), "left")
    at = F.greatest(F.col("target_line") - 1, F.lit(0))
    shown = lambda a: F.transform(a, lambda x: F.concat(F.lit("  "), x, F.lit("\n")))
    before = F.slice("all_lines", F.greatest(at - 2, F.lit(0)) + 1, F.least(at, F.lit(2)))
    after = F.slice("all_lines", at + 1, F.lit(2))
    diff = F.concat(F.array_join(shown(before), ""), F.lit("+ "), "indentation", "content", F.lit("\n"), F.array_join(shown(after), ""))
    return joined.select(*[F.col(c) for c in insertions.columns], diff.alias("diff"))


def select_fixes(gaps: DataFrame, min_severity: str | None = None, max_fixes: int | None = None) -> DataFrame:
    """gaps with status: Fix, or the reason why each is skipped; the limit counts within a file (R-7, T-6, U-7, W-5)."""
    worst = SEVERITY_ORDER[min_severity] if min_severity else 2
    order = F.when(F.col("severity") == "Critical", 0).when(F.col("severity") == "Major", 1).otherwise(2)
    marked = gaps.withColumn("wanted", order <= worst)
    nth = F.row_number().over(Window.partitionBy("file", "wanted").orderBy("ord"))
    status = F.when(~F.col("wanted"), "Skipped: Severity filter")
    if max_fixes is not None:
        status = status.when(nth > max_fixes, "Skipped: Max fixes limit reached")
    return marked.withColumn("status", status.otherwise("Fix")).drop("wanted")


def plan_fixes(files: DataFrame, gaps: DataFrame, min_severity: str | None = None, max_fixes: int | None = None, apply: bool = False) -> DataFrame:
    """A row for each gap: file, line, function_name, status, diff (H-8, J-12, A-16).

    The diff is of the insertion whose target is the gap's own line, else of
    the file's last one by line.  A gap whose file is missing has failed.
    """
    chosen = select_fixes(gaps, min_severity, max_fixes)
    planned = diff_previews(files, insertion_points(files, chosen.filter("status = 'Fix'")))
    of = Window.partitionBy("file").orderBy(F.col("target_line").desc(), "ord")
    spots = planned.withColumn("nth", F.row_number().over(of))
    lowest = spots.filter("nth = 1").select(F.col("file").alias("w_file"), F.col("diff").alias("other_diff"))
    own = spots.withColumn("k", F.row_number().over(Window.partitionBy("file", "target_line").orderBy("ord"))).filter("k = 1").select(F.col("file").alias("o_file"), F.col("target_line").alias("o_line"), F.col("diff").alias("own_diff"))
    there = files.select(F.col("file").alias("t_file")).distinct()
    rows = chosen.join(there, F.col("file") == F.col("t_file"), "left")
    rows = rows.join(own, (F.col("file") == F.col("o_file")) & (F.col("line") == F.col("o_line")), "left").join(lowest, F.col("file") == F.col("w_file"), "left")
    done = "Applied" if apply else "DryRun"
    status = F.when(F.col("t_file").isNull(), "Failed: Failed to read file").when(F.col("status") == "Fix", done).otherwise(F.col("status"))
    return rows.select("file", "line", "function_name", status.alias("status"), F.when(F.col("t_file").isNotNull() & (F.col("status") == "Fix"), F.coalesce("own_diff", "other_diff")).alias("diff"))


def fixed_files(files: DataFrame, gaps: DataFrame) -> DataFrame:
    """file, source of files with gaps, with the import and all attributes put in (H-3 to H-5)."""
    some = files.join(gaps.select("file").distinct(), "file", "left_semi")
    ready = checkpointed(ensure_import(some))
    moved = gaps.join(ready.select("file", "was_added"), "file").withColumn("line", F.col("line") + F.col("was_added").cast("int")).drop("was_added")
    return apply_insertions(ready.select("file", "source"), insertion_points(ready.select("file", "source"), moved))


def gated(attempts: DataFrame, parsed: DataFrame) -> DataFrame:
    """attempts with what was applied to files that no longer parse marked as failed (H-6); parsed: file, parse_ok, parse_error."""
    broken = parsed.filter("not parse_ok").select(F.col("file").alias("g_file"), F.concat(F.lit("Failed: Syntax validation failed: "), "parse_error").alias("why"))
    rows = attempts.join(broken, F.col("file") == F.col("g_file"), "left")
    failed = F.col("why").isNotNull() & (F.col("status") == "Applied")
    return rows.select("file", "line", "function_name", F.when(failed, F.col("why")).otherwise(F.col("status")).alias("status"), F.when(~failed, F.col("diff")).alias("diff"))


def tally(attempts: DataFrame) -> DataFrame:
    """One row: total, applied (dry runs too), skipped, failed (A-17)."""
    is_ = lambda p: F.count_if(F.col("status").rlike(p))
    return attempts.agg(F.count("*").alias("total"), is_("^(Applied|DryRun)").alias("applied"), is_("^Skipped").alias("skipped"), is_("^Failed").alias("failed"))

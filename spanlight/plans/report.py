"""Reports of an analysis (K-1 to K-6, K-9, M-8, T-5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import choose, mermaid_id, priority_score, quality_status
from ..operators.fixer import tally
from ..operators.gaps import kind_name
from ..operators.ranges import numbered

TITLE = "Analysis Results"


def _numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    return numbered(df, *order)


def _section(df: DataFrame, section: int, text: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col("n").cast("int").alias("n"), text.alias("text"))


def _place(c: str = "      ") -> Column:
    return F.concat(F.lit(c), "file", F.lit(":"), F.col("line").cast("string"), F.lit("\n"))


def _header(rows: DataFrame, section: int, title: str) -> DataFrame:
    """The title of a section that has rows."""
    return rows.limit(1).select(F.lit(section).alias("section"), F.lit(0).alias("n"), F.lit(title).alias("text"))


def tree_rows(a) -> DataFrame:
    """section, n, text: the pieces of the human report in their order (K-1).

    Ranks within a section go by ranges, so no task holds a whole section.
    """
    s = a.stats
    labels = [
        ("Files analyzed:     %d", "total_files"), ("Functions found:    %d", "total_functions"), ("Lines of code:      %d", "total_lines"), ("Endpoints:          %d", "endpoints_count"),
        ("Instrumentation:    %d points", "instrumentation_points"), ("Existing:           %d found", "existing_count"), ("Gaps:               %d", "gaps_count"), ("Rule violations:    %d", "rule_violations_count"),
    ]
    template = TITLE + "\n" + "═" * len(TITLE) + "\n\n📊 Statistics\n" + "".join(f"   {t}\n" for t, _ in labels) + "\n"
    out = s.select(F.lit(1).alias("section"), F.lit(1).alias("n"), F.format_string(template, *[c for _, c in labels]).alias("text"))
    e = _numbered(a.endpoints, "file", "line", "framework", "method", "path")
    out = out.unionByName(_header(e, 2, "🔗 Detected Endpoints\n")).unionByName(_section(e, 2, F.concat(F.lit("   "), "method", F.lit(" "), "path", F.lit(" → "), "handler", F.lit("\n"), _place())))
    x = _numbered(a.existing, "file", "line", "ord")
    issues = F.array_join(F.transform("issues", lambda i: F.concat(F.lit("      ⚠️  "), i["message"], F.lit("\n"))), "")
    name = F.coalesce(F.concat(F.lit('"'), "span_name", F.lit('"')), F.lit("(unnamed)"))
    line = F.concat(F.lit("   "), quality_status(F.col("score")), F.lit(" "), choose(F.col("kind"), K.EXISTING_LABELS), F.lit(" "), name, F.lit("\n"), _place(), issues)
    out = out.unionByName(_header(x, 3, "🎯 Existing Instrumentation\n")).unionByName(_section(x, 3, line))
    g = _numbered(a.gaps, "file", "line", "function_name", "description")
    out = out.unionByName(_header(g, 4, "🚨 Instrumentation Gaps\n")).unionByName(
        _section(g, 4, F.concat(F.lit("   ["), "severity", F.lit("] "), "description", F.lit("\n"), _place("      Location: "), F.lit("      Suggested: "), "suggested_fix", F.lit("\n\n")))
    )
    v = _numbered(a.violations, "file", "line", "kind", "message")
    severity = choose(F.col("severity"), {"Error": "ERROR", "Warning": "WARN", "Info": "INFO"})
    kind = choose(F.col("kind"), {"NamingConvention": "Naming", "MissingAttribute": "Missing Attr", "ForbiddenPattern": "Forbidden"})
    out = out.unionByName(_header(v, 5, "📋 Rule Violations\n")).unionByName(
        _section(v, 5, F.concat(F.lit("   ["), severity, F.lit("] ["), kind, F.lit("] "), "message", F.lit("\n"), _place("      Location: "), F.lit("      Suggestion: "), "suggestion", F.lit("\n\n")))
    )
    nothing = s.filter("existing_count = 0").select(F.lit(True).alias("shown"))
    p = _numbered(a.points.join(F.broadcast(nothing)), priority_score(F.col("priority")) * -1, "phase", "file", "line", "function_name")  # one row at most
    return out.unionByName(_header(p, 6, "📍 Suggested Instrumentation Points\n")).unionByName(
        _section(p, 6, F.concat(F.lit("   ["), "priority", F.lit("] "), "function_name", F.lit(" ("), kind_name(F.col("kind")), F.lit(")\n      Reason: "), "reason", F.lit("\n      Suggested span: "), "suggested_span_name", F.lit("\n"), _place("      Location: "), F.lit("\n")))
    )


def write_rows(rows: DataFrame, folder: str) -> None:
    """The pieces of tree_rows or mermaid_rows as text files in the order of their names, for reports of any size."""
    ordered = rows.repartitionByRange("section", "n").sortWithinPartitions("section", "n")
    ordered.select(F.regexp_replace("text", r"\n\z", "").alias("value")).write.mode("overwrite").text(folder)


def finding_rows(a) -> DataFrame:
    """kind, file, line, finding: every finding as one JSON text, to be written as JSON lines whatever their number."""
    parts = {"endpoint": a.endpoints, "existing": a.existing, "gap": a.gaps, "point": a.points.drop("suggested_fields"), "violation": a.violations}
    out = None
    for kind, df in parts.items():
        rows = df.select(F.lit(kind).alias("kind"), "file", "line", F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("finding"))
        out = rows if out is None else out.unionByName(rows)
    return out


def tree_text(a) -> str:
    """The whole report as one text, for results of a size to read."""
    return "".join(r["text"] for r in tree_rows(a).orderBy("section", "n").collect())


def _listed(df: DataFrame, name: str, value: Column, *order: Column | str) -> DataFrame:
    rows = _numbered(df, *order).select("n", value.alias("v"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias(name), F.lit(1).alias("one"))


def _json_items(a) -> list[tuple[str, DataFrame, Column, list]]:
    """(key, rows, item, order) of the lists of the JSON report, its keys in alphabetical order."""
    c = F.col
    place = F.struct("file", "line")
    with_function = F.struct("file", c("function_name").alias("function"), "line")
    return [
        ("endpoints", a.endpoints, F.struct("framework", "handler", place.alias("location"), "method", "path"), ["file", "line", "framework", "method", "path"]),
        ("existing_instrumentation", a.existing, F.struct("issues", "kind", place.alias("location"), c("score").alias("quality_score"), "span_name"), ["file", "line", "ord"]),
        ("gaps", a.gaps, F.struct("description", with_function.alias("location"), "severity", "suggested_fix"), ["file", "line", "function_name", "description"]),
        ("instrumentation_points", a.points, F.struct("file", c("function_name").alias("function"), "kind", "line", "priority", "reason", "suggested_span_name"), [priority_score(c("priority")) * -1, "phase", "file", "line", "function_name"]),
        ("rule_violations", a.violations, F.struct("kind", with_function.alias("location"), "message", "severity", "suggestion"), ["file", "line", "kind", "message"]),
    ]


def json_rows(a) -> DataFrame:
    """section, n, text: pieces that make the JSON document when they are put together by section and n (K-2).

    An item is one piece, so a document of any size is written in tasks
    (`write_rows`) and no task holds a list.
    """
    out = a.stats.select(F.lit(6).alias("section"), F.lit(0).alias("n"), F.concat(F.lit('],"stats":'), F.to_json(F.struct(*sorted(a.stats.columns))), F.lit("}")).alias("text"))
    for i, (key, rows, item, order) in enumerate(_json_items(a), 1):
        one = _numbered(rows, *order)
        text = F.concat(F.when(F.col("n") > 1, ",").otherwise(""), F.to_json(item, {"ignoreNullFields": "false"}))
        head = a.stats.select(F.lit(i).alias("section"), F.lit(0).alias("n"), F.lit(("{" if i == 1 else "],") + f'"{key}":[').alias("text"))
        out = out.unionByName(head).unionByName(_section(one, i, text))
    return out


def json_report(a) -> DataFrame:
    """One row, report: the JSON document, its keys in alphabetical order (K-2), for results of a size to read; json_rows has any number."""
    parts = [_listed(rows, key, item, *order) for key, rows, item, order in _json_items(a)]
    out = a.stats.select(F.struct(*sorted(a.stats.columns)).alias("stats"), F.lit(1).alias("one"))
    for p in parts:
        out = out.join(p, "one")
    keys = ["endpoints", "existing_instrumentation", "gaps", "instrumentation_points", "rule_violations", "stats"]
    return out.select(F.to_json(F.struct(*keys), {"pretty": "true", "ignoreNullFields": "false"}).alias("report"))


def mermaid_rows(a) -> DataFrame:
    """section, n, text: the lines of a Mermaid graph (K-3)."""
    e = _numbered(a.endpoints, "file", "line", "framework", "method", "path").withColumn("ep", F.concat(F.lit("    EP"), (F.col("n") - 1).cast("string")))
    out = _section(e, 2, F.concat("ep", F.lit('["'), "method", F.lit(" "), "path", F.lit('"]\n'), "ep", F.lit(" --> "), mermaid_id(F.col("handler"))))
    edge = _numbered(a.edges, "src", "dst", "kind")
    out = out.unionByName(_section(edge, 3, F.concat(F.lit("    "), mermaid_id(F.col("src")), F.lit(" --> "), mermaid_id(F.col("dst")))))
    p = _numbered(a.points, priority_score(F.col("priority")) * -1, "phase", "file", "line", "function_name")
    out = out.unionByName(_section(p, 4, F.concat(F.lit("    class "), mermaid_id(F.col("function_name")), F.lit(" "), F.lower("priority"))))
    fixed = [(1, 1, "graph TD"), (5, 0, "")] + [(5, i, f"    classDef {n} fill:#{f},stroke:#333,stroke-width:{w}px") for i, (n, f, w) in enumerate((("critical", "ff0000", 2), ("high", "ff6600", 2), ("medium", "ffcc00", 1), ("low", "99cc99", 1)), 1)]
    return out.unionByName(a.points.sparkSession.createDataFrame(fixed, out.schema))


def mermaid_text(a) -> str:
    return "\n".join(r["text"] for r in mermaid_rows(a).orderBy("section", "n").collect()) + "\n"


def check_json(check: DataFrame) -> DataFrame:
    """One row, report: the coverage gate's JSON (K-6)."""
    return check.select(F.to_json(F.struct(*sorted(check.columns)), {"pretty": "true"}).alias("report"))


def check_text(check: DataFrame, gaps: DataFrame, existing_count: int) -> str:
    """The coverage gate's text, with the first five gaps where it fails (K-6, T-5)."""
    c = check.first()
    lines = [
        "Instrumentation Coverage Check", "══════════════════════════════", "", "📊 Results:",
        f"   Total instrumentation points: {c['total_points']}", f"   Existing instrumentation:     {existing_count}",
        f"   Gaps:                         {c['gaps']}{' (critical only)' if c['critical_only'] else ''}", f"   Coverage:                     {c['coverage']:.1f}%", f"   Threshold:                    {c['threshold']:.1f}%", "",
    ]
    if c["passed"]:
        return "\n".join([*lines, "✅ PASSED: Coverage meets threshold", ""])
    lines.append(f"❌ FAILED: Coverage {c['coverage']:.1f}% is below threshold {c['threshold']:.1f}%")
    n = gaps.count()
    if n:
        lines += ["", "🚨 Critical gaps to fix:"]
        lines += [f"   - {g['function_name']} ({g['file']}:{g['line']})" for g in gaps.orderBy("file", "line", "function_name").limit(5).collect()]
        if n > 5:
            lines.append(f"   ... and {n - 5} more")
    return "\n".join([*lines, ""])


def fix_report_rows(attempts: DataFrame) -> DataFrame:
    """section, n, text: the head of the report, then the text of each planned or applied fix in the order of its file (K-9)."""
    told = tally(attempts)
    line = lambda name, c: F.when(F.col(c) > 0, F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\n"))).otherwise("")
    done = F.when(F.col("applied") > 0, F.concat(F.lit("Applied: "), F.col("applied").cast("string"))).otherwise(F.concat(F.lit("Would apply: "), (F.col("total") - F.col("skipped") - F.col("failed")).cast("string")))
    title = "Instrumentation Fix Report\n==========================\n\nTotal gaps: "
    head = told.select(F.lit(1).alias("section"), F.lit(0).alias("n"), F.concat(F.lit(title), F.col("total").cast("string"), F.lit("\n"), done, F.lit("\n"), line("Skipped", "skipped"), line("Failed", "failed")).alias("text"))
    rows = _numbered(attempts, "file", "line", "function_name")
    first = F.row_number().over(Window.partitionBy("file").orderBy("n")) == 1
    status = F.col("status")
    label = F.when(status == "Applied", "APPLIED").when(status == "DryRun", "DRY-RUN").otherwise(F.regexp_replace(F.regexp_replace(status, "^Skipped", "SKIPPED"), "^Failed", "FAILED"))
    diff = F.transform(F.split(F.rtrim("diff", F.lit("\n")), "\n"), lambda x: F.concat(F.lit("    "), x, F.lit("\n")))
    shown = F.when(status.isin("Applied", "DryRun") & F.col("diff").isNotNull(), F.array_join(diff, "")).otherwise("")
    text = F.concat(F.when(F.col("first"), F.concat(F.lit("\nFile: "), "file", F.lit("\n"))).otherwise(""), F.lit("  ["), label, F.lit("] "), "function_name", F.lit(" at line "), F.col("line").cast("string"), F.lit("\n"), shown)
    return head.unionByName(rows.withColumn("first", first).select(F.lit(2).alias("section"), "n", text.alias("text")))


def fix_report(attempts: DataFrame) -> str:
    """The rows as one text, for results of a size to read (K-9)."""
    return "".join(r["text"] for r in fix_report_rows(attempts).orderBy("section", "n").collect())


FORMATTERS: dict[str, Callable] = {"tree": tree_text, "json": lambda a: json_report(a).first()["report"], "mermaid": mermaid_text}  # K-4


def write_output(text: str, path: str | None = None) -> None:
    """To a file, or to standard output (K-5)."""
    if path is None:
        print(text)
        return
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


class TreeBuilder:
    """Lines of a drawn tree, and progress bars (M-8)."""

    def __init__(self):
        self.lines: list[str] = []

    def add(self, prefix: str, last: bool, label: str, value: str | None = None) -> str:
        """Add a node; what its children's lines start with."""
        self.lines.append(prefix + ("└── " if last else "├── ") + label + (f" {value}" if value is not None else ""))
        return prefix + ("    " if last else "│   ")

    def build(self) -> str:
        return "\n".join(self.lines)


def progress_bar(done: int, total: int, width: int) -> str:
    share = min(done / total, 1.0) if total else 1.0
    full = int(share * width)
    return f"[{'█' * full}{'░' * (width - full)}] {share * 100:5.1f}% ({done}/{total})"

"""The fixed analysis: sources and dependencies to endpoints, points, gaps, violations and stats (A-1)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import classify, deps, endpoints, existing, gaps, graph, points, rules, traverse
from ..operators.lines import cut_once, line_counts, lines_with, marked_lines
from ..sources.tables import written


@dataclass
class Config:
    """Settings of an analysis; what is not set keeps its documented default."""

    threshold: float = K.DEFAULT_THRESHOLD
    exclude_patterns: list[str] = field(default_factory=lambda: list(K.DEFAULT_EXCLUDES))
    source_dirs: list[str] = field(default_factory=lambda: ["src"])
    framework: str = "auto"
    max_depth: int = K.DEFAULT_MAX_DEPTH
    trace_from_endpoints: bool = False
    filter_path: str | None = None
    include_tests: bool = True
    naming_rules: rules.NamingRules = field(default_factory=rules.NamingRules)


@dataclass
class Analysis:
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    endpoints: DataFrame
    existing: DataFrame
    points: DataFrame
    gaps: DataFrame
    violations: DataFrame
    stats: DataFrame


NODE = "id string, name string, kind string, file string, line int"
EDGE = "src string, dst string, kind string, is_conditional boolean, is_in_loop boolean"


def run_stats(lines: DataFrame, nodes: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """The eight counts in one row (A-1); lines: file, line_count."""
    counts = lines.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines")).unpivot([], ["total_files", "total_lines"], "name", "n")
    for name, df in {"total_functions": nodes, **found}.items():
        counts = counts.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
    return counts.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in ("total_files", "total_functions", "total_lines", *found)])


def analyze(files: DataFrame, dependencies: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, config: Config | None = None) -> Analysis:
    """files (file, source) of one project through every stage.

    nodes and edges come from the parser; without edges the graph is what the
    command line builds, definitions alone.  trace_from_endpoints keeps the
    points that endpoints reach within max_depth; filter_path keeps files
    whose path holds it.
    """
    config = config or Config()
    spark = files.sparkSession
    if config.filter_path:
        files = files.filter(F.contains("file", F.lit(config.filter_path)))
    nodes = spark.createDataFrame([], NODE) if nodes is None else nodes.select("id", "name", "kind", "file", "line")
    if not config.include_tests:
        nodes = nodes.filter("kind <> 'Test'")
    edges = spark.createDataFrame([], EDGE) if edges is None else edges
    dependencies = spark.createDataFrame([], "project string, package string, dep_name string, dep_kind string") if dependencies is None else dependencies
    one = dependencies.withColumn("project", F.lit("p"))
    framework = config.framework
    if framework == "auto":
        by_deps = deps.framework_by_deps(one).first()
        framework = by_deps["framework"] if by_deps else "Unknown"
        if framework == "Unknown":
            by_source = deps.framework_by_source(files.withColumn("project", F.lit("p"))).first()
            framework = by_source["framework"] if by_source else "Unknown"
    # Texts are cut once; what all stages read are the lines with marks, and the narrow tables that follow.
    if framework in endpoints.MARKS:
        cut = written(cut_once(files, [*existing.MARKS, *endpoints.MARKS[framework]]), "cut")
        of_endpoints = of_existing = marked_lines(cut)
        counts = cut.select("file", "line_count")
    else:
        of_endpoints, of_existing, counts = endpoints.endpoint_lines(files, framework), lines_with(files, existing.MARKS), line_counts(files)
    found = written(endpoints.detect_endpoints(of_endpoints, framework), "endpoints")
    there = written(existing.scan_existing(of_existing), "existing")
    context = deps.detection_context(one.unionByName(spark.createDataFrame([("p", "", "", "")], dependencies.schema)))
    matches = classify.classify_in_context(nodes.withColumn("project", F.lit("p")), context).drop("project")
    degs = graph.degrees(nodes, edges)
    suggested = points.all_points(found, matches, nodes, degs, config.threshold)
    if config.trace_from_endpoints:
        seeds = found.select(F.col("handler").alias("id")).distinct()
        near = traverse.reached(seeds, edges, config.max_depth).select(F.col("id").alias("function_name"))
        suggested = suggested.join(near, "function_name", "left_semi").select(*points.COLUMNS)
    suggested = written(suggested, "points")
    open_ = gaps.gaps_live(suggested, there)
    broken = rules.check_all(there, suggested, config.naming_rules)
    stats = run_stats(counts, nodes, {"endpoints_count": found, "instrumentation_points": suggested, "existing_count": there, "gaps_count": open_, "rule_violations_count": broken})
    return Analysis(files, nodes, edges, found, there, suggested, open_, broken, stats)

"""Command line: analyse, check, fix and init (K-5 to K-9)."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import ast, fixer, gaps, graph
from ..sources.config import load_config, save_config
from ..sources.files import scan_files
from ..sources.manifest import read_manifest
from ..sources.rewrite import rewrite_files
from ..sources.tables import checkpointed
from . import report
from .analyze import Analysis, Config, analyze


def session() -> SparkSession:
    return (
        SparkSession.builder.appName("spanlight").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )


def analyse_paths(spark: SparkSession, paths: list[str], config: Config, trace: bool = False) -> Analysis:
    """Everything below the paths; the manifest is looked up in the first.  Without trace the graph has definitions alone."""
    files = scan_files(spark, paths, config.exclude_patterns)
    parsed = ast.parse_files(files).cache()
    good = files.join(parsed.filter("parse_ok").select("file"), "file", "left_semi")
    nodes = ast.fn_nodes(parsed)
    edges = None
    if trace or config.trace_from_endpoints:
        edges = ast.call_edges(parsed, nodes)
        outside = graph.external_nodes(edges, nodes).select("id", "name", "kind", F.lit("").alias("file"), F.lit(0).alias("line"))
        nodes = nodes.select("id", "name", "kind", "file", "line").unionByName(outside)
    return analyze(good, read_manifest(spark, paths[0]), nodes, edges, config)


def prepare_fixes(a: Analysis, chosen) -> tuple:
    """(fixed files with parse_ok and parse_error, the same without their sources), as written tables (H-6)."""
    fixed = checkpointed(fixer.fixed_files(a.files, chosen))
    parsed = checkpointed(ast.parse_files(fixed).select("file", "parse_ok", "parse_error"))
    return fixed, parsed


def write_fixes(fixed, parsed, keep: bool) -> None:
    """Write the fixed sources that parse, in tasks (K-7, K-8)."""
    checkpointed(rewrite_files(fixed.join(parsed.filter("parse_ok"), "file", "left_semi"), keep))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spanlight")
    p.add_argument("--threshold", type=float)
    p.add_argument("--format", choices=sorted(report.FORMATTERS), default="tree")
    p.add_argument("--output")
    p.add_argument("--config")
    p.add_argument("--framework", choices=["auto", "axum", "actix", "rocket", "tonic"], default="auto")
    p.add_argument("--exclude", action="append")
    p.add_argument("--filter-path")
    p.add_argument("--trace-from-endpoints", action="store_true")
    p.add_argument("--max-depth", type=int)
    p.add_argument("--fix", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--fix-severity", choices=["critical", "major", "minor"])
    p.add_argument("--max-fixes", type=int)
    p.add_argument("--backup", action="store_true")
    p.add_argument("--coverage", type=float, default=80.0)
    p.add_argument("--critical-only", action="store_true")
    p.add_argument("command", choices=["analyse", "check", "init"])
    p.add_argument("paths", nargs="*", default=["."])
    args = p.parse_args(argv)
    if args.command == "init":
        save_config(Config(), args.output or "spanlight.toml")
        return 0
    config = load_config(args.config) if args.config else Config()
    for name in ("threshold", "filter_path", "max_depth"):
        if getattr(args, name) is not None:
            setattr(config, name, getattr(args, name))
    config.framework = config.framework if args.framework == "auto" else args.framework.capitalize()
    config.exclude_patterns = args.exclude or config.exclude_patterns
    config.trace_from_endpoints = args.trace_from_endpoints
    spark = session()
    a = analyse_paths(spark, args.paths, config)
    if args.command == "check":
        check = gaps.coverage_check(a.points, a.gaps, args.coverage, args.critical_only)
        row = check.first()
        text = report.check_json(check).first()["report"] if args.format == "json" else report.check_text(check, a.gaps, a.existing.count())
        report.write_output(text, args.output)
        return 0 if row["passed"] else 1
    if args.fix or args.dry_run:
        numbered = checkpointed(a.gaps.withColumn("ord", F.monotonically_increasing_id()))
        severity = args.fix_severity.capitalize() if args.fix_severity else None
        attempts = fixer.plan_fixes(a.files, numbered, severity, args.max_fixes, args.fix and not args.dry_run)
        if args.fix and not args.dry_run:
            fixed, parsed = prepare_fixes(a, fixer.select_fixes(numbered, severity, args.max_fixes).filter("status = 'Fix'").drop("status"))
            attempts = checkpointed(fixer.gated(attempts, parsed))
            write_fixes(fixed, parsed, args.backup)
        text = report.fix_report(attempts)
        report.write_output(text, args.output)
        return 1 if "[FAILED" in text else 0
    report.write_output(report.FORMATTERS[args.format](a), args.output)
    return 0


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    sys.exit(main())

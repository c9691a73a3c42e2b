"""Endpoint extraction from source lines (E-1 to E-7, E-14, J-7, J-8, W-1, U-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import contains_any, fn_name, is_fn_start, quoted
from .lines import lines_with, scan_lines

COLUMNS = ["file", "line", "method", "path", "handler", "framework"]


def next_function(lines: DataFrame) -> DataFrame:
    """lines with next_fn: the function that follows past attributes, comments and blank lines (E-6, J-8, W-1)."""
    text = F.col("text")
    passed = text.startswith("#") | text.startswith("//") | (text == "")
    end = F.when(is_fn_start(text), F.struct(fn_name(text).alias("name"))).when(~passed, F.struct(F.lit(None).cast("string").alias("name")))
    after = Window.partitionBy("file").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    return lines.withColumn("next_fn", F.first(end, ignorenulls=True).over(after)["name"])


def definition_lines(lines: DataFrame) -> DataFrame:
    """file, name, line of the first definition of each function (E-7)."""
    names = lines.filter(is_fn_start(F.col("text"))).select("file", "line", fn_name(F.col("text")).alias("name"))
    return names.filter("name is not null").groupBy("file", "name").agg(F.min("line").alias("line"))


def axum_routes(lines: DataFrame) -> DataFrame:
    """`.route(` lines: the first method of a fixed list that the line calls, placed at its handler (E-2, J-7)."""
    text = F.col("text")
    method, handler, closed = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for m in reversed(K.AXUM_METHODS):
        has = F.contains(text, F.lit(m + "("))
        after = F.regexp_extract(text, m + r"\(([^)]*)\)", 1)
        method = F.when(has, F.lit(m.upper())).otherwise(method)
        # The first call decides, even where it is never closed.
        rest = F.substr(text, F.instr(text, m + "(") + len(m) + 1)
        closed = F.when(has, F.contains(rest, F.lit(")"))).otherwise(closed)
        handler = F.when(has, F.trim(F.substring_index(rest, ")", 1))).otherwise(handler)
    routes = lines.filter(F.contains(text, F.lit(".route("))).select("file", "line", method.alias("method"), quoted(text).alias("path"), handler.alias("handler"), closed.alias("closed"))
    routes = routes.filter("method is not null and path is not null and closed").drop("closed")
    places = definition_lines(lines).select(F.col("file").alias("d_file"), F.col("name").alias("d_name"), F.col("line").alias("d_line"))
    joined = routes.join(places, (F.col("file") == F.col("d_file")) & (F.col("handler") == F.col("d_name")), "left")
    return joined.select("file", F.coalesce("d_line", "line").alias("line"), "method", "path", "handler", F.lit("axum").alias("framework"))


def attribute_routes(lines: DataFrame, framework: str) -> DataFrame:
    """`#[get("/path")]` and the like, with the function that follows (E-3, E-4)."""
    text = F.col("text")
    pattern = r"^#\[(" + "|".join(K.ATTRIBUTE_METHODS) + r")\("
    found = next_function(lines).filter(text.rlike(pattern) & quoted(text).isNotNull())
    return found.select("file", "line", F.upper(F.regexp_extract(text, pattern, 1)).alias("method"), quoted(text).alias("path"), F.coalesce("next_fn", F.lit("unknown")).alias("handler"), F.lit(framework).alias("framework"))


def tonic_methods(lines: DataFrame) -> DataFrame:
    """gRPC methods: `async fn` with a `Request<` (E-5)."""
    text = F.col("text")
    found = lines.filter(text.startswith("async fn ") & F.contains(text, F.lit("Request<"))).withColumn("handler", fn_name(text)).filter("handler is not null")
    return found.select("file", "line", F.lit("gRPC").alias("method"), F.concat(F.lit("/"), "handler").alias("path"), "handler", F.lit("tonic").alias("framework"))


#: One of these is in every line that the detector of a framework looks at; other frameworks' detectors look at all lines.
MARKS = {"Axum": [".route(", "fn "], "Tonic": ["async fn "]}


def endpoint_lines(files: DataFrame, framework: str) -> DataFrame:
    """The lines that detect_endpoints needs, of files that have a mark of the framework."""
    having = lambda marks: files.filter(contains_any(F.col("source"), marks))
    attributes = [f"#[{m}(" for m in K.ATTRIBUTE_METHODS]
    if framework == "Axum":
        return lines_with(having([".route("]), [".route(", "fn "])
    if framework in ("Actix", "Rocket"):
        return scan_lines(having(attributes))
    if framework == "Tonic":
        return lines_with(having(["Request<"]), ["async fn "])
    return scan_lines(having([".route(", "Request<", *attributes]))


def detect_endpoints(lines: DataFrame, framework: str) -> DataFrame:
    """Endpoints of a known framework, or of all four where it is Unknown (E-1, U-1)."""
    makers = {"Axum": axum_routes, "Actix": lambda x: attribute_routes(x, "actix-web"), "Rocket": lambda x: attribute_routes(x, "rocket"), "Tonic": tonic_methods}
    if framework in makers:
        return makers[framework](lines)
    out = None
    for make in makers.values():
        out = make(lines) if out is None else out.unionByName(make(lines))
    return out


def http_method(c: Column) -> Column:
    """A known method in upper case, else the text itself as Custom (E-14)."""
    return F.when(F.upper(c).isin(K.HTTP_METHODS), F.upper(c)).otherwise(c)

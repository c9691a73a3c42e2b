"""Call graphs as node and edge tables (C-2, C-3, C-5 to C-21, A-14, A-15, J-5, J-6, J-9, R-5, R-6, R-11, U-3, U-6, W-7, M-1, K-10).

nodes: id, kind and whatever else; edges: src, dst, kind, is_conditional, is_in_loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import edge_weight
from ..sources.tables import Growing, checkpointed
from . import components, traverse


def node_kind(name: Column, attributes: Column) -> Column:
    """Test, Endpoint or Internal by attributes and name (C-2); attributes are plain paths."""
    return (
        F.when(F.array_contains(attributes, "test"), "Test")
        .when(F.exists(attributes, lambda a: a.isin(K.AXUM_METHODS)) | (name == "main"), "Endpoint")
        .otherwise("Internal")
    )


def first_nodes(nodes: DataFrame, order: list[str]) -> DataFrame:
    """One row for each id, the first by `order` (U-3)."""
    return nodes.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter("nth = 1").drop("nth")


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (J-6, C-10)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def external_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, name, module_path, kind of the targets that are no nodes (J-5, C-3, C-9)."""
    missing = edges.select(F.col("dst").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    parts = F.split("id", "::")
    return missing.select("id", F.element_at(parts, -1).alias("name"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("module_path"), F.lit("External").alias("kind"))


def edge_kinds(edges: DataFrame) -> DataFrame:
    """edges with Recursive where an edge ends where it starts (C-5)."""
    return edges.withColumn("kind", F.when(F.col("src") == F.col("dst"), "Recursive").otherwise(F.col("kind")))


def weighted_edges(edges: DataFrame) -> DataFrame:
    """edges with edge_id and weight (C-17, M-1)."""
    return edges.withColumns({"edge_id": F.concat("src", F.lit("->"), "dst"), "weight": F.round(edge_weight(F.col("kind"), F.col("is_conditional"), F.col("is_in_loop")), 6)})


def edge_text(edges: DataFrame) -> DataFrame:
    """src -[kind]-> dst (K-10)."""
    return edges.select(F.format_string("%s -[%s]-> %s", "src", "kind", "dst").alias("text"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, callers, callees: numbers of distinct neighbours, 0 without any (A-15, J-3)."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("callees"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers"))
    both = nodes.select("id").join(into, "id", "left").join(out, "id", "left")
    return both.select("id", F.coalesce("callers", F.lit(0)).cast("bigint").alias("callers"), F.coalesce("callees", F.lit(0)).cast("bigint").alias("callees"))


def adjacency(edges: DataFrame) -> DataFrame:
    """id, calls: distinct targets in order (A-15, C-21)."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("calls"))


def locally_reachable(nodes: DataFrame, degs: DataFrame) -> DataFrame:
    """id, is_reachable: called by something, or an endpoint or test itself (R-11)."""
    return nodes.join(degs, "id").select("id", ((F.col("callers") > 0) | F.col("kind").isin("Endpoint", "Test")).alias("is_reachable"))


def reachable(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """seed, id, depth: everything on a path from each seed, itself at depth 0 (C-11, C-18).

    A row for each seed and id, as many as there are such pairs: `traverse.reach_sets`
    has them as bitmaps, `traverse.reached` the ids that any seed reaches.
    """
    numbers = traverse.numbered_seeds(seeds)
    return traverse.expanded(traverse.reach_sets(numbers, edges, max_depth), numbers)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reaching(targets: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """seed, id, depth: everything from which each target is reached (C-12)."""
    return reachable(targets, reversed_edges(edges), max_depth)


def shortest_paths(start: DataFrame, edges: DataFrame) -> DataFrame:
    """id, path: a shortest path from the start to every id it reaches; the id before an id is the least that is one step nearer (C-13)."""
    return traverse.shortest_paths(start, edges)


def cycles(edges: DataFrame) -> DataFrame:
    """cycle: each simple cycle once, of any length, from its least id on (C-14).

    Only hops inside strongly connected components are followed.  A component
    that is one ring is read off it; in others paths start at a cycle's least
    id and never pass a smaller one, which finds each cycle once.  A dense
    component has exponentially many simple cycles, and all are listed;
    `components.component_cycles` gives a shortest one of each.
    """
    rings, rest = components.split_rings(checkpointed(components.hops_inside(edges)))
    hops = checkpointed(rest.select("src", "dst"))
    steps = Growing(edges.sparkSession, "path array<string>, dst string, is_closed boolean", "cycles")
    going = F.count_if(~F.col("is_closed"))
    front, told = steps.add(hops.filter("dst >= src").select(F.array("src").alias("path"), "dst", (F.col("src") == F.col("dst")).alias("is_closed")), n=going)
    while told["n"]:
        longer = front.filter("not is_closed").select(F.array_append("path", F.col("dst")).alias("path")).join(hops, F.element_at("path", -1) == F.col("src"))
        first = F.col("path")[0]
        longer = longer.filter((F.col("dst") >= first) & ((F.col("dst") == first) | ~F.array_contains("path", F.col("dst"))))
        front, told = steps.add(longer.select("path", "dst", (F.col("dst") == first).alias("is_closed")), n=going)
    return rings.select("cycle").unionByName(steps.all().filter("is_closed").select(F.col("path").alias("cycle")))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ten numbers of a graph in one row (A-14, C-15, C-19, U-6)."""
    one = F.lit(1).alias("one")
    kinds = nodes.agg(one, F.count("*").alias("total_nodes"), *[F.count_if(F.col("kind") == k).alias(f"{k.lower()}_count") for k in K.NODE_KINDS])
    reached = traverse.reached(nodes.filter("kind = 'Endpoint'"), edges).select("id")
    lost = nodes.filter("kind = 'Internal'").join(reached, "id", "left_anti").agg(one, F.count("*").alias("unreachable_internal"))
    all_edges = edges.agg(one, F.count("*").alias("total_edges"))
    degs = degrees(nodes, edges).agg(one, F.coalesce(F.max("callers"), F.lit(0)).alias("max_in_degree"), F.coalesce(F.max("callees"), F.lit(0)).alias("max_out_degree"))
    loops = cycles(edges).agg(one, F.count("*").alias("cycle_count"))
    out = kinds
    for part in (all_edges, lost, loops, degs):
        out = out.join(part, "one")
    return out.select("total_nodes", "total_edges", "endpoint_count", "test_count", "internal_count", "external_count", "unreachable_internal", "cycle_count", "max_in_degree", "max_out_degree")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """call_id, path, full_path, is_external: the first of four ways that finds a symbol (J-9, C-8, W-7).

    calls: call_id, module (array), path. Ways: the path itself; its first
    segment put in for what it imports; the enclosing modules from the inside
    out; else external where the first segment is a known root or no symbol.
    """
    first = F.substring_index("path", "::", 1)
    rest = F.substr(F.col("path"), F.length(first) + 1)
    known = calls.withColumns({"first": first, "rest": rest})
    direct = known.select("call_id", "path", F.lit(0).alias("rank"), F.col("path").alias("key"))
    imported = known.join(imports, F.col("first") == F.col("local_name")).select("call_id", "path", F.lit(1).alias("rank"), F.concat("full_path", "rest").alias("key"))
    levels = F.sequence(F.size("module"), F.lit(1), F.lit(-1))
    within = known.filter(F.size("module") > 0).select("call_id", "path", "module", F.explode(levels).alias("n"))
    within = within.select("call_id", "path", (F.lit(2) + F.size("module") - F.col("n")).alias("rank"), F.concat(F.array_join(F.slice("module", F.lit(1), F.col("n")), "::"), F.lit("::"), "path").alias("key"))
    tried = direct.unionByName(imported).unionByName(within)
    hit = tried.join(symbols.select(F.col("full_path").alias("key")).distinct(), "key").groupBy("call_id").agg(F.min_by("key", "rank").alias("full_path"))
    roots = symbols.select(F.col("full_path").alias("first")).distinct().withColumn("is_symbol", F.lit(True))
    out = known.join(hit, "call_id", "left").join(roots, "first", "left")
    outside = F.col("full_path").isNull() & (F.col("first").isin(K.EXTERNAL_ROOTS) | F.col("is_symbol").isNull())
    return out.select("call_id", "path", F.when(outside, F.col("path")).otherwise(F.col("full_path")).alias("full_path"), outside.alias("is_external"))


class Scope:
    """Symbols and imports put down by hand while modules are entered and left; `tables` is what resolve_calls reads (C-20)."""

    def __init__(self):
        self.module: list[str] = []
        self.symbols: list[tuple[str]] = []
        self.imports: dict[str, str] = {}

    def enter_module(self, name: str) -> None:
        self.module.append(name)

    def exit_module(self) -> None:
        if self.module:
            self.module.pop()

    def register_import(self, local_name: str, full_path: str) -> None:
        self.imports[local_name] = full_path

    def register_function(self, name: str) -> None:
        """Under its full path, and under its short name where that is free."""
        self.symbols.append(("::".join([*self.module, name]),))
        if (name,) not in self.symbols:
            self.symbols.append((name,))

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """symbols (full_path) and imports (local_name, full_path)."""
        return spark.createDataFrame(self.symbols, "full_path string"), spark.createDataFrame(list(self.imports.items()), "local_name string, full_path string")


def graph_text(stats: DataFrame) -> DataFrame:
    """A graph's display text (K-10)."""
    return stats.select(
        F.format_string(
            "CallGraph {\n  Nodes: %d\n  Edges: %d\n  Endpoints: %d\n  Tests: %d\n  Internal: %d\n  External: %d\n  Unreachable: %d\n  Cycles: %d\n}",
            "total_nodes", "total_edges", "endpoint_count", "test_count", "internal_count", "external_count", "unreachable_internal", "cycle_count",
        ).alias("text")
    )

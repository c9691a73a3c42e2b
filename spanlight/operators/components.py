"""Strongly connected components by forward and backward colours, and cycles inside them (C-14, C-15).

A colour is the least label among all ids that reach an id.  Ids with many hops
into and out of them come first, as they are likely to lie in large components,
then a hash of the id decides, so that chains and rings in the order of their
ids take few rounds.  Ids of one colour that the colour's root is reached from form a
component, the root's.  Hops between colours lie in no component and are
dropped; what is left inside colours is coloured again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Growing, written, written_with
from .traverse import distinct_hops, read_back, shortest_cycles

LABEL = "struct<w:bigint,h:bigint,id:string>"


def _labels(hops: DataFrame) -> DataFrame:
    """id, least: the own label of every end of a hop."""
    one = F.lit(1).cast("bigint")
    both = hops.select(F.col("src").alias("id"), one.alias("o"), (one - 1).alias("i")).unionByName(hops.select(F.col("dst").alias("id"), (one - 1).alias("o"), one.alias("i")))
    weight = -F.sum("o") * F.sum("i")
    return both.groupBy("id").agg(weight.alias("w")).select("id", F.struct(F.col("w"), F.xxhash64("id").alias("h"), F.col("id")).cast(LABEL).alias("least"))


def ends(hops: DataFrame) -> DataFrame:
    """The distinct ids that hops start or end at."""
    return hops.select(F.col("src").alias("id")).unionByName(hops.select(F.col("dst").alias("id"))).distinct()


def least_reaching(hops: DataFrame, name: str = "colours") -> DataFrame:
    """id, least: the least label among an id and all ids that reach it, for every end of (src, dst).

    A round takes the least label over incoming hops and then, twice, that of
    the id behind the label, which multiplies what a label has seen on long
    chains.  Every round is a written table; a count of changes ends the loop.
    """
    labels = written(_labels(hops), name)
    while True:
        sent = hops.join(labels, hops["src"] == labels["id"]).select(F.col("dst").alias("id"), "least", F.lit(None).cast(LABEL).alias("own"))
        near = labels.select("id", "least", F.col("least").alias("own")).unionByName(sent).groupBy("id").agg(F.min("least").alias("least"), F.max("own").alias("own"))
        for n in range(2):
            behind = labels.select(F.col("id").alias(f"id_{n}"), F.col("least").alias(f"least_{n}"))
            near = near.join(behind, F.col("least.id") == F.col(f"id_{n}")).select("id", F.least("least", f"least_{n}").alias("least"), "own")
        now, told = written_with(near, name, changed=F.count_if(F.col("least") != F.col("own")))
        labels = now.select("id", "least")
        if not told["changed"]:
            return labels


def _inside(hops: DataFrame, labels: DataFrame) -> DataFrame:
    """The hops whose ends have one label."""
    one = labels.select(F.col("id").alias("src"), F.col("least").alias("l_src"))
    two = labels.select(F.col("id").alias("dst"), F.col("least").alias("l_dst"))
    return hops.join(one, "src").join(two, "dst").filter("l_src = l_dst").select("src", "dst")


def strong_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, component: the least id of the component, for every end of an edge and every node.

    Null ends make no hop.  An empty graph gives no rows.
    """
    hops = distinct_hops(edges)
    every = ends(hops) if nodes is None else ends(hops).unionByName(nodes.select("id").filter("id is not null")).distinct()
    settled = Growing(edges.sparkSession, f"id string, root {LABEL}", "components")
    left, told = written_with(hops.filter("src <> dst"), "hops", n=F.count(F.lit(1)))
    while told["n"]:
        # An id that nothing leads to, or that leads nowhere, is a component of its own.
        inner = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        inner, told = written_with(inner.select("src", "dst"), "hops", n=F.count(F.lit(1)))
        if not told["n"]:
            break
        forward = least_reaching(inner)
        same = written(_inside(inner, forward), "hops")
        backward = least_reaching(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = forward.join(backward.withColumnRenamed("least", "back"), "id").filter("least = back")
        done, _ = settled.add(found.select("id", F.col("least").alias("root")))
        gone = done.select("id")
        rest = same.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        left, told = written_with(rest.select("src", "dst"), "hops", n=F.count(F.lit(1)))
    all_settled = settled.all()
    # Written first, so that AQE can split a component that very many ids share.
    names = written(all_settled.groupBy("root").agg(F.min("id").alias("component")), "component-names")
    named = all_settled.join(names, "root").select("id", "component")
    return every.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def hops_inside(edges: DataFrame) -> DataFrame:
    """component, src, dst: the distinct hops that lie on some cycle, self-calls included."""
    of = written(strong_components(edges), "components")
    one = of.select(F.col("id").alias("src"), "component")
    two = of.select(F.col("id").alias("dst"), F.col("component").alias("c_dst"))
    return distinct_hops(edges).join(one, "src").join(two, "dst").filter("component = c_dst").select("component", "src", "dst")


def _sizes(inside: DataFrame) -> DataFrame:
    ids = inside.select("component", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("component").agg(F.count("*").alias("n_ids"))
    return ids.join(inside.groupBy("component").agg(F.count("*").alias("n_hops")), "component")


def component_sizes(edges: DataFrame) -> DataFrame:
    """component, n_ids, n_hops of every component with a cycle."""
    return _sizes(written(hops_inside(edges), "inside"))


def split_rings(inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component, cycle of the components that are one ring, component, src, dst of the hops of all others), from hops_inside as a written table.

    A component with as many hops as ids is a single cycle.  It is cut before
    its least id and read back by pointer doubling, so a long ring takes few
    rounds.
    """
    # Written first, so that AQE can split a component with very many hops.
    sizes = written(_sizes(inside), "component-sizes")
    ring = written(inside.join(sizes.filter("n_ids = n_hops").select("component"), "component", "left_semi"), "rings")
    rest = inside.join(sizes.filter("n_ids < n_hops").select("component"), "component", "left_semi")
    depth = F.lit(0)
    chain = ring.filter("dst <> component").select(F.col("component").alias("pair"), F.col("dst").alias("id"), depth.alias("depth"), F.col("src").alias("via"))
    first = ring.filter("dst = component").select(F.col("component").alias("pair"), F.col("component").alias("id"), depth.alias("depth"), F.lit(None).cast("string").alias("via"))
    last = ring.filter("dst = component").select(F.col("component").alias("l_pair"), F.col("src").alias("l_id"))
    whole = read_back(first.unionByName(chain)).join(last, (F.col("pair") == F.col("l_pair")) & (F.col("id") == F.col("l_id")))
    return whole.select(F.col("pair").alias("component"), F.col("path").alias("cycle")), rest


def component_cycles(edges: DataFrame) -> DataFrame:
    """component, cycle: a shortest cycle through the least id of every component that has one, from that id on.

    One cycle a component, found in time that grows with its hops; `graph.cycles`
    lists every simple cycle.
    """
    rings, rest = split_rings(written(hops_inside(edges), "inside"))
    rest = written(rest, "inside")
    found = shortest_cycles(rest.select(F.col("component").alias("id")).distinct(), rest.select("src", "dst"))
    return rings.unionByName(found.withColumnRenamed("id", "component"))

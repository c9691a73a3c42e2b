"""Traversals by levels: sets of seeds as bitmaps, and shortest paths as parent pointers (C-11 to C-13, C-18).

A level is a part of one growing table, so plans stay as short at the last
level as at the first.  What a level adds is what the next one starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Growing, written, written_with
from .ranges import numbered

#: Seeds whose bits share a number.
SEEDS = 64
#: Pairs for each id of an end from which one search serves all pairs of that id.
SHARED = 8


def distinct_hops(edges: DataFrame) -> DataFrame:
    """src, dst of the edges, each pair once, as a written table; edges with a null end are left out."""
    return written(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).filter("src is not null and dst is not null").distinct(), "hops")


def reversed_hops(hops: DataFrame) -> DataFrame:
    return hops.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


# ---------------------------------------------------------------- many seeds


def reached(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """id, depth: what any of the seeds reaches, itself at depth 0, at its least depth; one row for each id."""
    hops = distinct_hops(edges)
    seen = Growing(edges.sparkSession, "id string, depth int", "reached")
    count = F.count(F.lit(1))
    front, told = seen.add(seeds.select(F.col("id").cast("string").alias("id")).filter("id is not null").distinct().withColumn("depth", F.lit(0)), n=count)
    depth = 0
    while told["n"] and (max_depth is None or depth < max_depth):
        depth += 1
        step = front.join(hops, front["id"] == hops["src"]).select(F.col("dst").alias("id")).distinct()
        front, told = seen.add(step.join(seen.all().select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), n=count)
    return seen.all()


def numbered_seeds(seeds: DataFrame) -> DataFrame:
    """seed, block, bit: the distinct seeds in order, SEEDS of them to a block, as a written table."""
    one = numbered(seeds.select(F.col("id").cast("string").alias("seed")).filter("seed is not null").distinct(), "seed")
    at = F.col("n") - 1
    return written(one.select("seed", F.floor(at / SEEDS).cast("int").alias("block"), F.pmod(at, F.lit(SEEDS)).cast("int").alias("bit")), "seeds")


def reach_sets(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """id, block, depth, bits: the seeds that reach an id first at a depth, as bits of numbered_seeds (`seeds`).

    Bits of SEEDS seeds travel along an edge as one number and are merged by
    OR; a level holds the bits that an id did not have before, and nothing
    travels twice.  Blocks without a new bit stop.
    """
    hops = distinct_hops(edges)
    levels = Growing(edges.sparkSession, "id string, block int, depth int, bits bigint", "reach-levels")
    one = F.expr("shiftleft(cast(1 as bigint), bit)")
    count = F.count(F.lit(1))
    front, told = levels.add(seeds.select(F.col("seed").alias("id"), "block", F.lit(0).alias("depth"), one.alias("bits")).groupBy("id", "block", "depth").agg(F.bit_or("bits").alias("bits")), n=count)
    depth = 0
    while told["n"] and (max_depth is None or depth < max_depth):
        depth += 1
        sent = front.join(hops, front["id"] == hops["src"]).select(F.col("dst").alias("id"), "block", "bits").groupBy("id", "block").agg(F.bit_or("bits").alias("bits"))
        known = levels.all().groupBy("id", "block").agg(F.bit_or("bits").alias("known"))
        fresh = sent.join(known, ["id", "block"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("bigint")))))
        front, told = levels.add(fresh.filter("bits <> 0").select("id", "block", F.lit(depth).alias("depth"), "bits"), n=count)
    return levels.all()


def set_sizes(sets: DataFrame) -> DataFrame:
    """id, n_seeds: the number of seeds that reach an id."""
    return sets.groupBy("id").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n_seeds"))


def expanded(sets: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, id, depth: a row for each seed and id; as many rows as there are such pairs."""
    rows = sets.select("id", "block", "depth", "bits", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("bit"))
    rows = rows.filter(F.expr("shiftright(bits, bit) & 1") == 1)
    return rows.join(seeds, ["block", "bit"]).select("seed", "id", "depth")


# ---------------------------------------------------------------- paths

POINTERS = "pair string, id string, depth int, via string"


def _apart(rows: DataFrame) -> DataFrame:
    """rows, never broadcast: equal texts and paths take little room in a written table, so its size says nothing of what they take in memory."""
    return rows.hint("merge")


def _step(front: DataFrame, hops: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    """The next level: ids that are new to their pair, each with the least id that leads to it."""
    near = front.join(_apart(hops), front["id"] == hops["src"]).groupBy("pair", F.col("dst").alias("n_id")).agg(F.min("id").alias("via"))
    return near.withColumnRenamed("n_id", "id").join(_apart(seen.select("pair", "id")), ["pair", "id"], "left_anti").select("pair", "id", F.lit(depth).alias("depth"), "via")


def read_back(pointers: DataFrame) -> DataFrame:
    """pair, id, path: from the id without a pointer to each id, by pointer doubling.

    Every row has a piece of path and the id before it; a round puts the piece
    of that id in front, so pieces double and the number of rounds grows with
    the logarithm of the longest path.
    """
    begun = pointers.select("pair", "id", F.col("via").alias("anchor"), F.array("id").alias("path"))
    rows, told = written_with(begun, "pieces", open=F.count("anchor"))
    while told["open"]:
        before = rows.select(F.col("pair").alias("b_pair"), F.col("id").alias("b_id"), F.col("anchor").alias("b_anchor"), F.col("path").alias("b_path"))
        held = rows.filter("anchor is not null").join(_apart(before), (F.col("anchor") == F.col("b_id")) & (F.col("pair") == F.col("b_pair")))
        longer = held.select("pair", "id", F.col("b_anchor").alias("anchor"), F.concat("b_path", "path").alias("path"))
        rows, told = written_with(rows.filter("anchor is null").unionByName(longer), "pieces", open=F.count("anchor"))
    return rows.select("pair", "id", "path")


def shortest_paths(start: DataFrame, edges: DataFrame) -> DataFrame:
    """id, path: a shortest path to every id from the start that is nearest, the least of nearest starts by what their paths hold before the id.

    Of several ids one step nearer the least is the one before an id.
    """
    hops = distinct_hops(edges)
    seen = Growing(edges.sparkSession, POINTERS, "paths")
    count = F.count(F.lit(1))
    ids = start.select(F.col("id").cast("string").alias("id")).filter("id is not null").distinct()
    front, told = seen.add(ids.select(F.lit("").alias("pair"), "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")), n=count)
    depth = 0
    while told["n"]:
        depth += 1
        front, told = seen.add(_step(front, hops, seen.all(), depth), n=count)
    return read_back(seen.all()).select("id", "path")


def _met(fore: DataFrame, back: DataFrame, hops: DataFrame) -> DataFrame:
    """pair, path: the shortest from each pair's ids in fore to those in back (pair, id, depth, via), for pairs that meet.

    The side with fewer rows takes a step.  The first step after which the
    sides of a pair share an id gives the length of its shortest path; the
    least of such ids is taken.  A pair goes once it has met or one of its
    sides has nothing new.
    """
    spark, count = hops.sparkSession, F.count(F.lit(1))
    way = {"fore": hops, "back": written(reversed_hops(hops), "hops")}
    seen = {side: Growing(spark, POINTERS, side) for side in way}
    front, size, depth = {}, {}, {}
    for side, rows in (("fore", fore), ("back", back)):
        front[side], told = seen[side].add(rows.select(*[c.split()[0] for c in POINTERS.split(", ")]), n=count, far=F.max("depth"))
        size[side], depth[side] = told["n"], told["far"] or 0
    mids = Growing(spark, "pair string, mid string", "mids")

    def meet(rows: DataFrame, other: str) -> DataFrame:
        both = rows.select("pair", "id").join(_apart(seen[other].all().select("pair", "id")), ["pair", "id"], "left_semi")
        return mids.add(both.groupBy("pair").agg(F.min("id").alias("mid")))[0]

    done = meet(front["fore"], "back")
    while size["fore"] and size["back"]:
        side = "fore" if size["fore"] <= size["back"] else "back"
        other = "back" if side == "fore" else "fore"
        open_ = front[other].select("pair").distinct().join(done.select("pair"), "pair", "left_anti")
        depth[side] += 1
        fresh = _step(front[side].join(open_, "pair", "left_semi"), way[side], seen[side].all(), depth[side])
        front[side], told = seen[side].add(fresh, n=count)
        size[side] = told["n"]
        done = meet(front[side], other)
        # What the other side goes on with are the pairs that are still open.
        rest = front[other].join(front[side].select("pair").distinct(), "pair", "left_semi").join(done.select("pair"), "pair", "left_anti")
        front[other], told = written_with(rest, "front", n=count)
        size[other] = told["n"]
    met = mids.all()
    heads = read_back(seen["fore"].all()).select(F.col("pair").alias("f_pair"), F.col("id").alias("f_id"), F.col("path").alias("head"))
    tails = read_back(seen["back"].all()).select(F.col("pair").alias("b_pair"), F.col("id").alias("b_id"), F.reverse("path").alias("tail"))
    whole = met.join(_apart(heads), (F.col("pair") == F.col("f_pair")) & (F.col("mid") == F.col("f_id"))).join(_apart(tails), (F.col("pair") == F.col("b_pair")) & (F.col("mid") == F.col("b_id")))
    return whole.select("pair", F.concat("head", F.slice("tail", F.lit(2), F.size("tail"))).alias("path"))


def _fanned(pairs: DataFrame, hops: DataFrame) -> DataFrame:
    """pair, path: a shortest path from hub to leaf for each of pairs (pair, hub, leaf) that has one; one search for each hub.

    A hub's search ends once it has all its leaves.
    """
    seen, count = Growing(hops.sparkSession, POINTERS, "fans"), F.count(F.lit(1))
    hubs = pairs.select(F.col("hub").alias("pair"), F.col("hub").alias("id")).distinct()
    front, told = seen.add(hubs.select("pair", "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")), n=count)
    left, depth = pairs.select("hub", "leaf"), 0
    while told["n"]:
        left, more = written_with(left.join(_apart(front.select(F.col("pair").alias("hub"), F.col("id").alias("leaf"))), ["hub", "leaf"], "left_anti"), "left", n=count)
        if not more["n"]:
            break
        depth += 1
        open_ = front.join(_apart(left.select(F.col("hub").alias("pair")).distinct()), "pair", "left_semi")
        front, told = seen.add(_step(open_, hops, seen.all(), depth), n=count)
    found = read_back(seen.all()).select(F.col("pair").alias("f_hub"), F.col("id").alias("f_leaf"), "path")
    return pairs.join(_apart(found), (F.col("hub") == F.col("f_hub")) & (F.col("leaf") == F.col("f_leaf"))).select("pair", "path")


def paths_between(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, path: a shortest path for each distinct pair (src, dst); null where there is none (C-13).

    Pairs are searched from both ends, each by itself; where they have few
    ids at one end (SHARED pairs for each or more), a search from each such id
    serves all its pairs.  A pair of one id has the path of that id.  Pairs
    with a null end have none.
    """
    hops = distinct_hops(edges)
    ids = pairs.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    asked = written(ids.withColumn("pair", F.to_json(F.struct("src", "dst"))), "pairs")
    whole = asked.filter("src is not null and dst is not null")
    at = lambda end: whole.select("pair", F.col(end).alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    n = whole.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("src").alias("src"), F.count_distinct("dst").alias("dst")).first()
    hub, leaf = ("src", "dst") if n["src"] < n["dst"] else ("dst", "src")
    if n["pairs"] >= SHARED * n[hub]:
        found = _fanned(whole.select("pair", F.col(hub).alias("hub"), F.col(leaf).alias("leaf")), hops if hub == "src" else written(reversed_hops(hops), "hops"))
        found = found if hub == "src" else found.withColumn("path", F.reverse("path"))
    else:
        found = _met(at("src"), at("dst"), hops)
    return asked.join(_apart(found), "pair", "left").select("src", "dst", "path")


def shortest_cycles(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """id, cycle: a shortest cycle through each root that lies on one, from the root on, the root once."""
    hops = distinct_hops(edges)
    ids = roots.select(F.col("id").cast("string").alias("id")).filter("id is not null").distinct()
    fore = ids.select(F.col("id").alias("pair"), "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    # The way back begins one step before the root, or it would meet there at once.
    into = hops.join(ids, hops["dst"] == ids["id"], "left_semi").select(F.col("dst").alias("pair"), F.col("src").alias("id"), F.lit(1).alias("depth"), F.lit(None).cast("string").alias("via"))
    return _met(fore, into, hops).select(F.col("pair").alias("id"), F.col("path").alias("cycle"))

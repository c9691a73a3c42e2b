"""Mixing sources to target weights [native]: hash-threshold histograms.

A document's place in its source is a 40-bit hash of its id.  Word counts are
summed by source and hash bucket, the bucket in which a source's budget runs
out is found, and only that bucket is summed again by the next bits of the
hash, LEVELS times.  The thresholds that come out are a few numbers a source;
the documents below them are kept by a filter, never by a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

LEVELS, BITS = 4, 10
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
WORD = "[^\\x20\\x09-\\x0D]+"


def place(doc_id: Column, seed: str) -> Column:
    """A 40-bit number that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, LEVELS * BITS // 4), 16, 10).cast("bigint")


def source_key(source: str = "source") -> Column:
    """A key that is never null, so that joins and groups keep the null source."""
    return F.concat(F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.lit("=")), F.coalesce(source, F.lit("")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target: sources by code point, null last, weigh `weights` in turn.

    Sources share the sum of all sizes by weight; a target stops at
    max_repeats times its source's size and the excess goes to the others by
    weight until none is above.  That settles in the order of size per weight:
    a source is capped iff the share left to it, with those before it capped,
    reaches its cap.  Ranks and running sums go by ranges, so sources may be
    many; one row a source is held.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("bigint"))
    named = scratch.running(totals, [F.col("source").isNull(), F.col("source")], {"one": "nth"}, "mix-names")
    weighed = named.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * max_repeats).drop("one", "nth")
    order = [F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source")]
    s = scratch.running(weighed, order, {"cap": "cap_before", "w": "w_before"}, "mix-caps")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    whole = s.agg(zero(F.col("w")).alias("w"), zero(F.col("source_size")).alias("size")).first()
    capped = exact("cap") * (F.lit(whole["w"]).cast("decimal(38,0)") - exact("w_before")) <= (F.lit(whole["size"]).cast("decimal(38,0)") - exact("cap_before")) * exact("w")
    s = scratch.written(s.withColumn("capped", capped), "mix-capped")
    taken = s.filter("capped").agg(zero(F.col("cap")).alias("cap"), zero(F.col("w")).alias("w")).first()
    share = F.lit(float(whole["size"] - taken["cap"])) * F.col("w").cast("double") / F.lit(float(whole["w"] - taken["w"]))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source_key, source_size, target, repeats, below: documents with place < below are taken once more.

    Each level reads only the documents in its sources' boundary buckets.
    """
    state = targets.withColumns(
        {
            "repeats": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"),
        }
    )
    state = state.withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size"))
    state = state.withColumns({"prefix": F.lit(0).cast("bigint"), "open": F.col("budget") > 0})
    state = scratch.written(state, "mix-targets")
    rows = sized
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * BITS
        bounds = state.select(F.col("source_key").alias("k"), "prefix", "open", "budget")
        inside = rows.join(bounds, F.col("source_key") == F.col("k")).filter(F.col("open") & (F.expr(f"shiftright(place, {shift + BITS})") == F.expr(f"shiftright(prefix, {shift + BITS})")))
        histogram = inside.groupBy("source_key", F.expr(f"shiftright(place, {shift})").alias("bucket")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("source_key").orderBy("bucket")
        cumulated = histogram.withColumn("upto", F.sum("size").over(run))
        found = (
            cumulated.join(bounds, F.col("source_key") == F.col("k"))
            .filter(F.col("upto") > F.col("budget"))
            .groupBy(F.col("source_key").alias("f_key"))
            .agg(F.min_by(F.struct("bucket", "size", "upto"), "bucket").alias("edge"))
        )
        state = state.join(found, F.col("source_key") == F.col("f_key"), "left").drop("f_key")
        leaf = F.col("edge.size").cast("double")
        left = F.col("budget") - (F.col("edge.upto") - F.col("edge.size"))
        bucket = F.expr(f"shiftleft(edge.bucket, {shift})")
        last = level == LEVELS - 1
        take = (left * 2 >= leaf).cast("bigint") if last else F.lit(0).cast("bigint")
        state = state.withColumns(
            {
                "prefix": F.when(F.col("edge").isNotNull(), bucket + take).otherwise(F.when(F.col("open"), F.lit(1 << (LEVELS * BITS)).cast("bigint")).otherwise(F.col("prefix"))),
                "budget": F.when(F.col("edge").isNotNull(), left).otherwise(F.col("budget")),
                "open": F.col("open") & F.col("edge").isNotNull(),
            }
        ).drop("edge")
        state = scratch.written(state, f"mix-level{level}")
    return state.withColumnRenamed("prefix", "below")


def sizes(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, source_key, size, place of every row, as a written table: texts are read once."""
    return scratch.written(
        docs.select(
            "doc_id",
            "source",
            source_key().alias("source_key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            place(F.col("doc_id"), seed).alias("place"),
        ),
        "mix-sizes",
    )


def source_cuts(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """k, source_size, target, whole, below: one row a source, enough to decide on any document."""
    targets = source_targets(sized, weights, max_repeats).withColumn("source_key", source_key())
    return thresholds(sized, targets).select(F.col("source_key").alias("k"), "source_size", "target", F.col("repeats").alias("whole"), "below")


def repeats(place_column: Column) -> Column:
    return F.col("whole") + (place_column < F.col("below")).cast("bigint")


def mix_sources(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats of every row.

    size counts the words of the text (null: 0); taken = size * repeats, with
    repeats the whole times a source fits its target, and one more below its
    threshold, which lies where the words come nearest to the target.  Rows
    with one doc_id share a place and are taken together.  A null source is a
    source of its own, the last by name.  An empty table gives no rows.
    """
    sized = sizes(docs, seed)
    joined = sized.join(source_cuts(sized, weights, max_repeats), F.col("source_key") == F.col("k"))
    taken = joined.withColumn("repeats", repeats(F.col("place")))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def mixed_rows(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources says, with all its columns."""
    cuts = source_cuts(sizes(docs, seed), weights, max_repeats)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source_key().alias("r_key"), place(F.col("doc_id"), seed).alias("r_place"))
    counted = rows.join(cuts, F.col("r_key") == F.col("k")).withColumn("times", repeats(F.col("r_place"))).filter("times > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("nth")).select("row.*")

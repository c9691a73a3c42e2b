"""Benchmark decontamination: a prefix-filtered set join of item windows and documents.

A window (`width` consecutive item words; a shorter item whole) is the set of
its shingles of up to SHINGLE words.  To hold the window a document must hold
all of them, so one shingle is the necessary prefix: the one that the corpus
holds least often.  Spark joins documents and windows on those prefix shingles
alone.  The place of the shingle in its window bounds where the window can
start and whether it fits in the document, and what is left is compared word
by word.

Both sides of every join are tables.  What is broadcast is a filter of a fixed
size that tells which of a document's shingles are worth a row; where items
outgrow it, more rows reach the join, and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import map_arrow
from . import scratch, words

SHINGLE = 3
WIDTH = 10
#: Bits of the shingle filter, at least and at most (1 and 16 MB); 32 bits for each shingle within these bounds.
FILTER_BITS, FILTER_BITS_MAX = 1 << 23, 1 << 27

_U = np.uint64
#: What parts words, on the text as it is: A-Z count as letters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _scan(column: pa.Array) -> words.Words:
    return words.scan(column, words.NOT_ALNUM, words.FOLD)


def _starts(count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, first[group] + 0 .. count[group] - 1), one after the other."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[group]


def _item_windows(width: int):
    """(item, window, n, shingle, at) of every shingle of every window of an item; window is its words, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi in words.slices(column):
                found = _scan(column.slice(lo, hi - lo))
                prefix = words.prefix_hashes(found.hash)
                many = np.diff(found.ptr)
                row, start = _starts(np.where(many > 0, np.maximum(many - width + 1, 1), 0), found.ptr[:-1])
                n = np.minimum(many[row], width)
                s = np.minimum(n, SHINGLE)
                which, at = _starts(n - s + 1, start)
                shingle = words.range_hash(prefix, at, at + s[which])
                text = [found.joined[a : b - 1].tobytes() for a, b in zip(found.at[start].tolist(), found.at[start + n].tolist())]
                window = pa.array(text, pa.binary()).cast(pa.string()).take(pa.array(which))
                yield pa.record_batch(
                    [batch.column("item").take(pa.array(lo + row[which])), window, pa.array(n[which].astype(np.int32)), pa.array(words.signed(shingle)), pa.array((at - start[which]).astype(np.int32))],
                    ["item", "window", "n", "shingle", "at"],
                )

    return run


def _bits(rows: list, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r["f_bucket"] - 1) * 4096 : r["f_bucket"] * 4096] = np.frombuffer(r["f_bits"], np.uint8)
    return out


class Filter:
    """A set of shingle hashes by `bits` bits, for numpy."""

    def __init__(self, shingles: DataFrame, key: str = "shingle"):
        n = shingles.count()
        self.bits = min(max(FILTER_BITS, 1 << (32 * n).bit_length()), FILTER_BITS_MAX)
        at = (F.shiftrightunsigned(F.col(key), 64 - self.bits.bit_length() + 1) + 1).alias("at")
        rows = shingles.select(at).groupBy(F.bitmap_bucket_number("at").alias("f_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("f_bits"))
        held = _bits(rows.collect(), self.bits)  # FILTER_BITS_MAX / 8 bytes at most
        self.held = shingles.sparkSession.sparkContext.broadcast(held)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = (x >> _U(64 - self.bits.bit_length() + 1)).astype(np.int64)
        return (self.held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _doc_shingles(found: words.Words, sizes: list[int], may: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, start words, hashes) of the shingles of each size within one row that the filter lets pass."""
    prefix = words.prefix_hashes(found.hash)
    ends = np.repeat(found.ptr[1:], np.diff(found.ptr))
    at = np.arange(len(found.hash))
    for s in sizes:
        start = at[at + s <= ends]
        own = words.range_hash(prefix, start, start + s)
        some = may(own)
        yield s, start[some], own[some]


def _counted(sizes: list[int], may: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi in words.slices(column):
                for _, _, own in _doc_shingles(_scan(column.slice(lo, hi - lo)), sizes, may):
                    value, n = np.unique(own, return_counts=True)
                    yield pa.record_batch([pa.array(words.signed(value)), pa.array(n)], ["shingle", "n"])

    return run


def _met(sizes: list[int], may: Filter, width: int):
    """(doc_id, tid, shingle, pos, near, context): context holds the words from `near` on that a window around the shingle can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi in words.slices(column):
                found = _scan(column.slice(lo, hi - lo))
                row = found.row
                for s, start, own in _doc_shingles(found, sizes, may):
                    r = row[start]
                    a = np.maximum(start - (width - s), found.ptr[r])
                    b = np.minimum(start + width, found.ptr[r + 1])
                    context = [found.joined[x : y - 1].tobytes() for x, y in zip(found.at[a].tolist(), found.at[b].tolist())]
                    of = pa.array(lo + r)
                    yield pa.record_batch(
                        [*(batch.column(c).take(of) for c in ("doc_id", "tid")), pa.array(words.signed(own)), pa.array(start - found.ptr[r]), pa.array(a - found.ptr[r]), pa.array(context, pa.binary()).cast(pa.string())],
                        ["doc_id", "tid", "shingle", "pos", "near", "context"],
                    )

    return run


def _prefixes(pairs: DataFrame, docs: DataFrame, sizes: list[int]) -> DataFrame:
    """window, n, shingle, at: the shingle of each window that the corpus holds least often, as a written table; ties go to the least hash."""
    distinct = scratch.written(pairs.select("shingle").distinct(), "shingles")
    counts = map_arrow(docs.select("text"), _counted(sizes, Filter(distinct)), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("count"))
    counts = scratch.written(counts.join(distinct, "shingle", "left_semi"), "shingle-counts")
    rare = pairs.select("window", "n", "shingle", "at").distinct().join(counts, "shingle", "left")
    # A window that holds a shingle which no document has can't occur.
    least = rare.groupBy("window", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "at")).alias("p"))
    return scratch.written(least.filter("p.count > 0").select("window", "n", "p.shingle", "p.at"), "prefixes")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, n_words, spans, items of every row of docs.

    row is the whole input row; spans holds (start, n) of each window that
    occurs, by start; items the ids, as sorted strings, of the items that have
    an occurring window.  A null text has no words; an item without words has
    no windows, one with a null id has windows but no place in items; repeated
    items share their windows.  An empty benchmark gives empty spans, an empty
    table no rows.
    """
    known = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    pairs = scratch.written(map_arrow(known, _item_windows(width), "item string, window string, n int, shingle bigint, at int"), "windows")
    sizes = sorted(r["s"] for r in pairs.select(F.least("n", F.lit(SHINGLE)).alias("s")).distinct().collect())  # SHINGLE numbers at most
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), scratch.text_id(F.col("text").cast("string")).alias("tid"))
    prefixes = _prefixes(pairs, rows, sizes)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("tid", "shingle", "pos", "near")), T.StructField("context", T.StringType())])
    # Written first, so that AQE can split a shingle that very many documents hold.
    met = scratch.written(map_arrow(rows, _met(sizes, Filter(prefixes.select("shingle").distinct()), width), schema), "met")
    start = F.col("pos") - F.col("at")
    inner = start - F.col("near")
    parts = F.split("context", " ")
    fits = (inner >= 0) & (inner + F.col("n") <= F.size(parts))
    same = F.array_join(F.slice(parts, F.greatest(inner, F.lit(0)).cast("int") + 1, F.col("n")), " ") == F.col("window")
    hits = met.join(prefixes, "shingle").filter(fits).filter(same).select("doc_id", "tid", start.alias("start"), "n", "window").distinct()
    hits = scratch.written(hits, "hits")
    spans = hits.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))
    held = hits.select("doc_id", "tid", "window").distinct()
    of = scratch.written(pairs.filter("item is not null").select("window", "item").distinct(), "window-items")
    items = held.join(of, "window").groupBy("doc_id", "tid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.join(items, (spans["doc_id"].eqNullSafe(items["doc_id"])) & (spans["tid"] == items["tid"]), "left")
    found = scratch.written(found.select(spans["doc_id"].alias("h_id"), spans["tid"].alias("h_tid"), "spans", "items"), "found")
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("r_id"), scratch.text_id(F.col("text").cast("string")).alias("r_tid"))
    some, clean = scratch.split_by_ids(every, found.select(F.col("h_tid").alias("r_tid")), "r_tid")
    joined = some.join(found, F.col("r_id").eqNullSafe(F.col("h_id")) & (F.col("r_tid") == F.col("h_tid")), "left").select("row", "spans", "items")
    empty = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("spans", "items")]
    out = joined.unionByName(clean.select("row", *empty))
    n_words = F.regexp_count(F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")
    return out.select("row", n_words.alias("n_words"), *[F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("spans", "items")])


def covered_words(spans: str = "spans") -> Column:
    """Number of words in spans sorted by start, as a column."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))

    def step(s: Column, x: Column) -> Column:
        end = x["start"] + x["n"]
        fresh = F.greatest(end - F.greatest(s["upto"], x["start"]), F.lit(0))
        return F.struct((s["n"] + fresh).alias("n"), F.greatest(s["upto"], end).alias("upto"))

    return F.aggregate(spans, zero, step, lambda s: s["n"])

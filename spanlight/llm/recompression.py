"""Substring dedup by recompression.

ROUNDS of recompression rewrite every document at once: runs of one symbol
become one symbol, then pairs whose left symbol is in the round's left half and
whose right symbol is in its right half become one.  A symbol's name is a
64-bit hash of what it stands for and halves are chosen by a hash of the name,
so names agree over all documents and executors without an exchange of
dictionaries, and equal substrings get equal interior symbols.  Each symbol
also carries the range of words on which its existence depends (its neighbours
decide where runs and pairs end); a symbol whose range lies inside a window is
the same in every copy of the window.

Each window of `window` words is filed under the least of its high-level
symbols (with the words of their ranges); a window with none, as inside one
long run, under its own content.  Neighbouring windows filed under one symbol
form a segment.  Spark then (1) finds symbols shared by documents, (2) settles
segments whose whole content is shared with an earlier document, and (3) only
where segments of one symbol differ compares their windows one by one.  Names
only bring segments together: two are equal if and only if the 128-bit BLAKE2b
digests of their words' bytes are, so names that clash change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import map_arrow
from . import scratch, words

ROUNDS = 3
WINDOW = 50

_U = np.uint64
_RUN, _PAIR, _RIGHT, _SALT, _OWN = (_U(x) for x in (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def recompress(symbols: np.ndarray, ptr: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, from, to): the symbols after `rounds` rounds and the word ranges on which each depends.

    A range that reaches over an end of its row goes one word beyond it, so
    that no window of the row holds it.  Both ends never decrease.
    """
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    name, lo, hi = symbols, np.arange(len(symbols)), np.arange(1, len(symbols) + 1)
    before, after = ptr[:-1] - 1, ptr[1:] + 1

    def left_of(i: np.ndarray, r: np.ndarray) -> np.ndarray:
        j = np.maximum(i - 1, 0)
        return np.where((i > 0) & (row[j] == r), lo[j], before[r])

    def right_of(i: np.ndarray, r: np.ndarray) -> np.ndarray:
        j = np.minimum(i + 1, len(row) - 1)
        return np.where((i + 1 < len(row)) & (row[j] == r), hi[j], after[r])

    for k in range(rounds):
        if not len(name):
            break
        head = np.ones(len(name), bool)
        head[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(head)
        many = np.diff(np.append(first, len(name)))
        r = row[first]
        run = words.mix(name[first] * _RUN + many.astype(_U))
        new = np.where(many > 1, run, name[first]), left_of(first, r), right_of(first + many - 1, r), r
        name, lo, hi, row = new
        right_half = (words.mix(name + _U(int(_SALT) * (k + 1) % 2**64)) >> _U(63)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right_half[:-1] & right_half[1:] & (row[1:] == row[:-1])
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        at = np.arange(len(name))
        own_lo = np.where(right_half, left_of(at, row), lo)
        own_hi = np.where(right_half, hi, right_of(at, row))
        keep = np.flatnonzero(~second)
        p = pair[keep]
        nxt = np.minimum(keep + 1, len(name) - 1)
        joined = words.mix(name[keep] * _PAIR + words.mix(name[nxt] + _RIGHT))
        name, lo, hi, row = np.where(p, joined, name[keep]), np.where(p, lo[keep], own_lo[keep]), np.where(p, hi[nxt], own_hi[keep]), row[keep]
    return name, lo, hi


def window_symbols(found: words.Words, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, symbol) of every window of a slice."""
    prefix = words.prefix_hashes(found.hash)
    name, lo, hi = recompress(found.hash, found.ptr, rounds)
    n_windows = np.maximum(np.diff(found.ptr) - window + 1, 0)
    row = np.repeat(np.arange(len(n_windows)), n_windows)
    start = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + found.ptr[row]
    top = len(found.hash)
    key = words.mix(name ^ words.range_hash(prefix, np.clip(lo, 0, top), np.clip(hi, 0, top)))
    first, last = np.searchsorted(lo, start, "left"), np.searchsorted(hi, start + window, "right")
    count = last - first
    symbol = words.mix(words.range_hash(prefix, start, start + window) + _OWN)
    least, size = key, 1
    while size <= (count.max() if len(count) else 0):
        some = (count >= size) & (count < 2 * size)
        symbol[some] = np.minimum(least[first[some]], least[last[some] - size])
        least = np.minimum(least[: max(len(least) - size, 0)], least[size:])
        size *= 2
    return row, start, symbol


def _pass(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    return [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "tid")]


def _segments(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi in words.slices(column):
                found = words.scan(column.slice(lo, hi - lo))
                row, start, symbol = window_symbols(found, window, rounds)
                if not len(row):
                    continue
                head = np.ones(len(row), bool)
                head[1:] = (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(head)
                many = np.diff(np.append(first, len(row)))
                at = start[first]
                content = found.digests(at, at + many - 1 + window)
                yield pa.record_batch(
                    [*_pass(batch, lo + row[first]), pa.array(words.signed(symbol[first])), pa.array(content, pa.binary()), pa.array((at - found.ptr[row[first]]).astype(np.int32)), pa.array(many.astype(np.int32))],
                    ["doc_id", "tid", "symbol", "content", "pos", "n"],
                )

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, spans = batch.column("text"), batch.column("open")
            for lo, hi in words.slices(column):
                found = words.scan(column.slice(lo, hi - lo))
                part = spans.slice(lo, hi - lo)
                of = np.repeat(np.arange(hi - lo), pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False))
                x = part.flatten()
                if not len(x):
                    continue
                pos, n, symbol = (x.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                rep = np.repeat(np.arange(len(n)), n)
                at = pos[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                start = found.ptr[of[rep]] + at
                own = found.digests(start, start + window)
                yield pa.record_batch(
                    [*_pass(batch, lo + of[rep]), pa.array(symbol[rep]), pa.array(own, pa.binary()), pa.array(at.astype(np.int32))],
                    ["doc_id", "tid", "symbol", "content", "pos"],
                )

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                own = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(own))
                if spans.is_valid:
                    change = np.zeros(len(own) + 1, np.int64)
                    for s in spans.as_py():
                        change[s["pos"]] += 1
                        change[s["pos"] + s["n"] - 1 + window] -= 1
                    gone = np.cumsum(change)[:-1] > 0
                    own = [w for w, g in zip(own, gone.tolist()) if not g]
                n_removed.append(n_words[-1] - len(own))
                kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
            yield pa.record_batch([batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept_text"])

    return run


def _repeats(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """doc_id, tid, spans: array of (pos, n) for n windows from word pos that an earlier document holds."""
    id_type = docs.schema["doc_id"].dataType
    ids = [T.StructField("doc_id", id_type), T.StructField("tid", T.LongType())]
    hashes = [T.StructField("symbol", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("pos", T.IntegerType())]
    rows = scratch.keyed(docs).filter(F.col("doc_id").isNotNull())
    segments = scratch.written(map_arrow(rows, _segments(window, rounds), T.StructType([*ids, *hashes, T.StructField("n", T.IntegerType())])), "segments")
    names = segments.groupBy("symbol").agg(
        F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), (F.min(F.struct("content", "n")) < F.max(F.struct("content", "n"))).alias("differ")
    )
    # Written first, so that the join deals both sides anew and AQE can split a symbol that very many documents share.
    names = scratch.written(names.filter("d0 < d1").select("symbol", "differ"), "symbols")
    shared = scratch.written(segments.join(names, "symbol"), "shared")
    firsts = shared.groupBy("symbol", "content", "n").agg(F.min("doc_id").alias("first"))
    classes = scratch.written(shared.join(scratch.written(firsts, "firsts"), ["symbol", "content", "n"]), "classes")
    whole = classes.filter("doc_id > first").select("doc_id", "tid", "pos", "n")
    open_ = scratch.written(classes.filter("doc_id = first and differ").groupBy("doc_id", "tid").agg(F.collect_list(F.struct("pos", "n", "symbol")).alias("open")), "open")
    some, _ = scratch.split_by_ids(rows, open_, "tid")
    windows = scratch.written(map_arrow(some.join(open_, ["doc_id", "tid"]), _windows(window), T.StructType([*ids, *hashes])), "windows")
    seen = windows.groupBy("symbol", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    single = windows.join(scratch.written(seen, "seen"), ["symbol", "content"]).filter("doc_id > first").select("doc_id", "tid", "pos", F.lit(1).alias("n"))
    return whole.unionByName(single).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """row, n_words, n_removed, kept_text of every row of docs; row is the whole input row.

    Every word goes that is covered by a window of `window` words whose
    sequence also starts in a document with a smaller doc_id, judged on the
    input.  kept_text joins the kept words by one space.  A null text has no
    words; a row with a null doc_id neither loses words nor takes any from
    others; rows with one doc_id do not take from each other; an empty table
    gives no rows.
    """
    found = scratch.written(_repeats(docs, window, rounds), "repeats").select(F.col("doc_id").alias("r_id"), F.col("tid").alias("r_tid"), "spans")
    all_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", scratch.text_id().alias("tid"))
    hit, clean = scratch.split_by_ids(all_rows, found.select(F.col("r_tid").alias("tid")), "tid")
    out = hit.join(found, (F.col("doc_id") == F.col("r_id")) & (F.col("tid") == F.col("r_tid")), "left").select("row", "text", "spans")
    out = out.unionByName(clean.select("row", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans")))
    schema = T.StructType([out.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return map_arrow(out, _cut(window), schema)


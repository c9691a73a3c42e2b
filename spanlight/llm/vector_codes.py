"""Vector code compression: product codes by Lloyd's rounds that rescan active entries only.

Each vector is cut into equal parts; each part position has a codebook.  A
round assigns every part to its nearest entry and moves the entries to the
floor of their parts' mean.  A part whose entry did not move since its
distance was taken still stands at that exact distance, and no other entry
that did not move can have become better: it is compared with the moved
entries alone.  Parts whose own entry moved scan the whole codebook.  Ties go
to the lower index either way, so codes equal those of full scans.

State (vector, codes, distances) is a written table for each round, from which
Spark sums parts by entry; what reaches the driver are the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import map_arrow
from . import scratch, vectors

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows whose distances to all entries are held at a time.
CHUNK = 2048


def distances(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries: doubles hold whole numbers below 2**53, objects any."""
    return (part * part).sum(1)[:, None] - 2 * (part @ book.T) + (book * book).sum(1)[None, :]


def reassign(part: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and exact distances of the rows of one part position, from those before entries `moved` did."""
    code, dist = code.copy(), dist.copy()
    stays = ~moved[code]
    active = np.flatnonzero(moved)
    rows = np.flatnonzero(stays)
    if len(rows) and len(active):
        d = distances(part[rows], book[active])
        best = d.argmin(1)
        nearest, entry = d[np.arange(len(rows)), best], active[best]
        better = ((nearest < dist[rows]) | ((nearest == dist[rows]) & (entry < code[rows]))).astype(bool)
        code[rows[better]], dist[rows[better]] = entry[better], nearest[better]
    rows = np.flatnonzero(~stays)
    if len(rows):
        d = distances(part[rows], book)
        code[rows] = d.argmin(1)
        dist[rows] = d[np.arange(len(rows)), code[rows]]
    return code, dist


def _assigner(books: np.ndarray, moved: np.ndarray, number: str):
    parts, _, length = books.shape
    dtype = object if number == vectors.WIDE else np.float64
    books = books.astype(dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = {n: names.index(n) for n in ("v", "code", "dist")}
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                v = vectors.matrix(part.column(at["v"]), parts * length, dtype)
                code = vectors.matrix(part.column(at["code"]), parts, np.int64)
                dist = vectors.matrix(part.column(at["dist"]), parts, dtype)
                for p in range(parts):
                    code[:, p], dist[:, p] = reassign(v[:, p * length : (p + 1) * length], books[p], moved[p], code[:, p], dist[:, p])
                columns = list(part.columns)
                columns[at["code"]] = vectors.lists(code, pa.int32())
                columns[at["dist"]] = vectors.lists(dist, vectors.arrow_type(number))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def entry_sums(state: DataFrame, length: int, number: str) -> DataFrame:
    """part, entry, n and s_0 ... of the parts that are assigned to each entry."""
    rows = state.select("v", F.posexplode("code").alias("part", "entry"))
    component = lambda j: F.get("v", F.col("part") * length + j).cast(number)
    return rows.groupBy("part", "entry").agg(F.count(F.lit(1)).alias("n"), *[F.sum(component(j)).alias(f"s_{j}") for j in range(length)])


def moved_books(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Codebooks with every used entry at the floor of its parts' mean; sums has a row for each used entry at most."""
    out = books.copy()
    for r in sums.collect():
        out[r["part"], r["entry"]] = [int(r[f"s_{j}"]) // r["n"] for j in range(books.shape[2])]
    return out


def common_width(rows: DataFrame, parts: int) -> int:
    """The length that most vectors have, of those that can be cut into equal parts; the longer of two as common; 0 without any."""
    sizes = rows.groupBy(F.size("v").alias("width")).count().filter((F.col("width") > 0) & (F.col("width") % parts == 0))
    first = sizes.orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    return first[0]["width"] if first else 0


def compress(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, dist of every kept vector as a written table, codebooks by part, entry and component).

    code has an entry index for each part, dist the exact squared distances.
    Left out are vectors that are null, hold null, non-finite or huge (2**56
    after scaling) components, or have another length than most or one that
    can't be cut into equal parts.  Codebooks start as the vectors of least key, then
    of least vector, null keys last; with fewer vectors there are fewer
    entries.  Repeated rows count each; an empty table gives no rows and empty
    codebooks; other columns are ignored.
    """
    picked = table.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("x")).filter(vectors.usable(F.col("x")))
    whole = picked.select("key", "label", vectors.whole(F.col("x")).alias("v"))
    width = common_width(whole, parts)
    length = width // parts
    even, told = scratch.written_with(whole.filter(F.size("v") == width), "vectors", most=vectors.largest("v"))
    most = told.get("most") or 0
    # |part|^2, |entry|^2 and twice their product stay below 2**53 as doubles.
    number = "bigint" if 4 * max(length, 1) * (most + 1) ** 2 < 1 << 53 else vectors.WIDE
    first = even.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()
    blank = F.array_repeat(F.lit(0), parts)
    state = even.select("key", "label", "v", blank.alias("code"), blank.cast(f"array<{number}>").alias("dist"))
    if not first:
        return state.drop("v").limit(0), np.zeros((parts, 0, length), object)
    books = np.array([r["v"] for r in first], object).reshape(len(first), parts, length).swapaxes(0, 1)
    moved = np.ones(books.shape[:2], bool)
    for n in range(rounds + 1):
        last = n == rounds
        made = map_arrow(state, _assigner(books, moved, number), state.schema)
        before, state = state, scratch.written(made.drop("v") if last else made, "codes")
        if n:
            scratch.discard(before)
        if not last:
            books, old = moved_books(books, entry_sums(state, length, number)), books
            moved = (books != old).any(2)
    return state, books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def code_hex(code="code"):
    """Two hex digits for each part's index."""
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def compressed(table: DataFrame, **how) -> DataFrame:
    """key, label, code (hex), error, label_error, codebooks_sha256 of what `compress` keeps.

    error is the sum of a vector's distances, label_error the sum of errors
    over its label (nulls together); both stop at the largest bigint.
    """
    coded, books = compress(table, **how)
    total = F.aggregate("dist", F.lit(0).cast(vectors.WIDE), lambda a, x: (a + x).cast(vectors.WIDE))
    rows = coded.select("key", "label", code_hex().alias("code"), vectors.as_long(total).alias("error"))
    # Written first, so that its size decides how it is joined and AQE can split a label that very many rows have.
    sums = scratch.written(rows.groupBy(F.col("label").alias("l")).agg(vectors.as_long(F.sum(F.col("error").cast(vectors.WIDE))).alias("label_error")), "label-errors")
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return out.select("key", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))

"""Centroid clustering: k-means whose search runs over Walsh-Hadamard coefficients, coarse to fine.

The transform of whole-number vectors is exact and keeps distances up to a
factor, the number of components: squared differences of coefficients, added
up one by one, never pass the distance and reach it with the last.  So a
centroid whose partial sum is greater than the finished distance of another is
strictly worse and is dropped; what is left is finished over all coefficients.
Coefficients go by sequency, from few sign changes to many, in blocks that
double.

Vectors are transformed once, into a written table.  A round sends the
centroids' coefficients out and takes back, for each task, one row of sums for
each centroid; means follow from the sums' inverse transform.
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

CLUSTERS, ROUNDS, WIDTH = 8, 10, 64
#: Coefficients of the first block, which all centroids pass.
LEAD = 4
CHUNK = 4096


def sequency_order(width: int) -> np.ndarray:
    """Rows of the Hadamard matrix of Sylvester's order, by their number of sign changes."""
    signs = np.ones((1, 1), np.int64)
    while len(signs) < width:
        signs = np.block([[signs, signs], [signs, -signs]])
    return np.argsort((np.diff(signs, axis=1) != 0).sum(1), kind="stable")


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row by sequency; the width is a power of two."""
    return _butterflies(rows)[:, sequency_order(rows.shape[1])]


def inverse(rows: np.ndarray) -> np.ndarray:
    """The rows of which these are the transform."""
    natural = np.empty_like(rows)
    natural[:, sequency_order(rows.shape[1])] = rows
    return _butterflies(natural) // rows.shape[1]


def _butterflies(rows: np.ndarray) -> np.ndarray:
    count, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(count, width // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(count, width)
        step *= 2
    return rows


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance times width) of the nearest centroid of each row of coefficients, the lower number of equals."""
    count, width = rows.shape
    every = np.arange(count)
    lead = min(LEAD, width)
    partial = ((rows[:, None, :lead] - centroids[None, :, :lead]) ** 2).sum(2)
    leader = partial.argmin(1)
    bound = partial[every, leader] + ((rows[:, lead:] - centroids[leader, lead:]) ** 2).sum(1)
    alive = (partial <= bound[:, None]).astype(bool)
    alive[every, leader] = False
    at, of = np.nonzero(alive)
    total = partial[at, of]
    begin = lead
    while begin < width and len(at):
        end = min(2 * begin, width)
        total = total + ((rows[at, begin:end] - centroids[of, begin:end]) ** 2).sum(1)
        holds = (total <= bound[at]).astype(bool)
        at, of, total = at[holds], of[holds], total[holds]
        begin = end
    # What was dropped is strictly worse than the leader, so any greater number stands for it.
    final = np.repeat((bound + 1)[:, None], len(centroids), 1)
    final[every, leader] = bound
    final[at, of] = total
    number = final.argmin(1)
    return number, final[every, number]


def _transformer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors.matrix(batch.column(1), width, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors.lists(transform(rows), pa.int64())], names=["key", "h"])

    return run


def _found(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dtype) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, CHUNK):
            part = batch.slice(k, CHUNK)
            rows = vectors.matrix(part.column(1), centroids.shape[1], dtype)
            yield part.column(0), rows, *nearest(rows, centroids)


def _summer(centroids: np.ndarray, dtype):
    """A task's sums of coefficients: a row for each centroid that it uses."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), object)
        for _, rows, number, _ in _found(batches, centroids.astype(dtype), dtype):
            n += np.bincount(number, minlength=k)
            for c in np.unique(number):
                sums[c] += rows[number == c].sum(0).astype(object)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), vectors.lists(sums[used], vectors.arrow_type(vectors.WIDE))], names=["cluster", "n", "s"])

    return run


def _assigner(centroids: np.ndarray, dtype):
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, number, total in _found(batches, centroids.astype(dtype), dtype):
            distance = np.minimum(total // width, vectors.LONG_MAX).astype(np.int64)
            yield pa.RecordBatch.from_arrays([keys, pa.array(number.astype(np.int32)), pa.array(distance)], names=["key", "cluster", "distance"])

    return run


def start_centroids(coefficients: DataFrame, k: int, salt: int) -> list[list[int]]:
    """Coefficients of the k rows of least sha256('<salt>:<key>'), in that order; equal keys go by their coefficients, null keys last."""
    place = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("key").cast("string")), 256)
    return [r["h"] for r in coefficients.orderBy(place.asc_nulls_last(), "h").limit(k).collect()]


def cluster(table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, salt: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance of every kept vector as a written table, the centroids in whole numbers).

    Kept are vectors of exactly `width` components (a power of two), none of
    them null, non-finite or huge (2**56 after scaling).  Null keys are kept
    and start no cluster while others can.  Repeated rows count each; with
    fewer than k vectors there are fewer centroids; an empty table gives no
    rows.  A distance beyond bigint is its largest number.
    """
    if width & (width - 1) or width < 1:
        raise ValueError(f"the transform takes a power of two, not {width} components")
    picked = table.select(F.col(key).alias("key"), F.col(vector).alias("x")).filter((F.size("x") == width) & vectors.usable(F.col("x")))
    whole = picked.select("key", vectors.whole(F.col("x")).alias("v"))
    kind = whole.schema["key"].dataType.simpleString()
    h, told = scratch.written_with(map_arrow(whole, _transformer(width), f"key {kind}, h array<bigint>"), "coefficients", most=vectors.largest("h"))
    dtype = np.int64 if 4 * width * ((told.get("most") or 0) + 1) ** 2 < 1 << 63 else object
    started = start_centroids(h, k, salt)
    out_schema = f"key {kind}, cluster int, distance bigint"
    if not started:
        return h.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), np.zeros((0, width), object)
    centroids = inverse(np.array(started, object))
    for _ in range(rounds):
        sums = map_arrow(h, _summer(transform(centroids), dtype), f"cluster int, n bigint, s array<{vectors.WIDE}>")
        total = sums.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(j))).alias(f"s_{j}") for j in range(width)])
        for r in total.collect():  # k rows at most
            mean = inverse(np.array([[int(r[f"s_{j}"]) for j in range(width)]], object))[0]
            centroids[r["cluster"]] = [x // r["n"] for x in mean]
    return scratch.written(map_arrow(h, _assigner(transform(centroids), dtype), out_schema), "clusters"), centroids


def clustered(table: DataFrame, **how) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of what `cluster` keeps.

    Inertia is the distance summed over a cluster and over all; sums stop at
    the largest bigint.
    """
    rows, centroids = cluster(table, **how)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast(vectors.WIDE)).alias("total"))
    by = {r["cluster"]: int(r["total"]) for r in sums.collect()}  # a row for each centroid at most
    held = lambda x: min(x, vectors.LONG_MAX)
    digest = lambda c: hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()
    told = [(i, held(by.get(i, 0)), held(sum(by.values())), digest(c)) for i, c in enumerate(centroids)]
    facts = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""op11 and op12 against plain loops over whole numbers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from spanlight.llm import centroids, vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string"


def whole(x):
    return [math.floor(1024 * float(np.float32(c))) for c in x]


def usable(x):
    return x is not None and all(c is not None and math.isfinite(c) for c in x)


def square(a, b):
    return sum((p - q) ** 2 for p, q in zip(a, b))


def first_least(of, choices):
    return min(range(len(choices)), key=lambda i: (square(of, choices[i]), i))


def codes_by_hand(rows, parts, entries, rounds):
    kept = sorted(((k, whole(x), g) for k, x, g, *_ in rows if usable(x)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * n : (p + 1) * n]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    for step in range(rounds + 1):
        codes = [[first_least(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in kept]
        if step == rounds:
            break
        for p in range(parts):
            for i in range(len(books[p])):
                if own := [cut(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == i]:
                    books[p][i] = [sum(col) // len(own) for col in zip(*own)]
    errors = [sum(square(cut(v, p), books[p][c[p]]) for p in range(parts)) for (_, v, _), c in zip(kept, codes)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by = lambda g: sum(e for e, (_, _, h) in zip(errors, kept) if h == g)
    return sorted((str(k), "".join(f"{x:02x}" for x in c), e, by(g), digest) for (k, _, g), c, e in zip(kept, codes, errors))


def clusters_by_hand(rows, k, rounds, width):
    kept = [(key, whole(x)) for key, x, *_ in rows if usable(x) and len(x) == width]
    at = lambda key: hashlib.sha256(f"3:{key}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, at(r[0])))[:k]]
    for step in range(rounds + 1):
        found = [first_least(v, cents) for _, v in kept]
        if step == rounds:
            break
        for c in range(len(cents)):
            if own := [v for (_, v), f in zip(kept, found) if f == c]:
                cents[c] = [sum(col) // len(own) for col in zip(*own)]
    far = [square(v, cents[f]) for (_, v), f in zip(kept, found)]
    inside = lambda c: sum(d for d, f in zip(far, found) if f == c)
    digest = lambda c: hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()
    return sorted((str(key), f, d, inside(f), sum(far), digest(f)) for (key, _), f, d in zip(kept, found, far))


def made(n, width, seed, spread=1.0, grid=None):
    r = random.Random(seed)
    one = lambda: round(r.gauss(0, spread) * grid) / grid if grid else r.gauss(0, spread)
    return [(i, [one() for _ in range(width)], r.choice([None, 1, 1, 2]), "own") for i in range(n)]


def odd_rows(width):
    """Nulls everywhere, repeated rows and vectors that are left out."""
    return [
        (None, [0.25] * width, None, None), (None, None, 1, "x"), (900, [float("nan")] * width, 1, None), (901, [float("inf")] + [0.0] * (width - 1), 2, None),
        (902, [None] + [0.0] * (width - 1), 2, None), (903, [-0.001] * width, 7, None), (903, [-0.001] * width, 7, None),
    ]


@pytest.mark.parametrize("seed, grid", [(1, None), (2, 2)])
def test_codes_against_full_scans(spark, seed, grid):
    """A coarse grid makes ties and equal entries common."""
    rows = made(150, 8, seed, grid=grid) + odd_rows(8)
    out = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=4, entries=12, rounds=4).collect()
    assert sorted((str(r["key"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out) == codes_by_hand(rows, 4, 12, 4)


def test_codes_leave_out_other_lengths(spark):
    rows = made(20, 8, 3)
    more = [(100, [1.0] * 4, 1, ""), (101, [], 1, ""), (102, [1.0] * 7, 1, "")]
    out = vector_codes.compressed(spark.createDataFrame(rows + more, SCHEMA), parts=4, entries=3, rounds=2).collect()
    assert sorted((str(r["key"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out) == codes_by_hand(rows, 4, 3, 2)


def test_codes_of_large_numbers(spark):
    """Squares beyond doubles are compared as exact numbers."""
    rows = [(i, [2.0**21 + i * (-1) ** i, 3.0 * i, 0.5 * i, float(i)], 1, "") for i in range(12)]
    out = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA), parts=2, entries=4, rounds=3).collect()
    assert sorted((str(r["key"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out) == codes_by_hand(rows, 2, 4, 3)


def test_only_active_entries_are_compared():
    """A part whose entry stays never looks at entries that stay, even if its stored distance is made up."""
    part, book = np.array([[0.0], [9.0]]), np.array([[0.0], [5.0], [9.0]])
    code, dist = vector_codes.reassign(part, book, np.array([False, True, False]), np.array([2, 2]), np.array([81.0, 0.0]))
    assert code.tolist() == [1, 2] and dist.tolist() == [25.0, 0.0]
    code, _ = vector_codes.reassign(part, np.array([[4.0], [4.0], [9.0]]), np.array([True, False, False]), np.array([1, 2]), np.array([16.0, 0.0]))
    assert code.tolist() == [0, 2]  # an equal distance goes to the lower entry


@pytest.mark.parametrize("seed, grid", [(4, None), (5, 1)])
def test_clusters_against_all_distances(spark, seed, grid):
    rows = made(160, 64, seed, 0.3, grid) + odd_rows(64) + [(950, [1.0] * 63, 1, None), (951, [], 1, None)]
    out = centroids.clustered(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = sorted((str(r["key"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in out)
    assert got == clusters_by_hand(rows, 8, 10, 64)


def test_clusters_of_large_numbers(spark):
    rows = [(i, [2.0**18 * (i % 3) + i, 3.0 * i, 0.5 * i, float(i)], 1, "") for i in range(12)]
    out = centroids.clustered(spark.createDataFrame(rows, SCHEMA), k=3, rounds=4, width=4).collect()
    got = sorted((str(r["key"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in out)
    assert got == clusters_by_hand(rows, 3, 4, 4)


def test_transform_keeps_distances_and_turns_back():
    r = np.random.default_rng(1)
    rows = r.integers(-1000, 1000, (20, 64))
    h = centroids.transform(rows)
    assert ((h[0] - h[1]) ** 2).sum() == 64 * ((rows[0] - rows[1]) ** 2).sum()
    assert (centroids.inverse(h) == rows).all()
    assert h[3, 0] == rows[3].sum()  # no sign change comes first


def test_search_drops_none_that_ties():
    r = np.random.default_rng(2)
    rows, cents = r.integers(-2, 3, (400, 8)), r.integers(-2, 3, (30, 8))
    number, far = centroids.nearest(centroids.transform(rows), centroids.transform(cents))
    every = ((rows[:, None] - cents[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (far == 8 * every.min(1)).all()


def test_tables_without_vectors(spark):
    for rows in ([], [(1, None, 1, None), (2, [float("nan")] * 64, None, None)]):
        table = spark.createDataFrame(rows, SCHEMA)
        assert vector_codes.compressed(table).collect() == [] and centroids.clustered(table).collect() == []


def test_fewer_vectors_than_clusters(spark):
    rows = made(3, 64, 9)
    out = centroids.clustered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["cluster"] for r in out) == [0, 1, 2] and {r["inertia"] for r in out} == {0}

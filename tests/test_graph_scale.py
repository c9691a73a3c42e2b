"""Components, seed bitmaps and paths against plain traversals of random graphs."""

from __future__ import annotations

import random
from collections import deque

import pytest

from spanlight.operators import components, graph, traverse

EDGE = "src string, dst string"


def made(seed, n, m, extra=()):
    r = random.Random(seed)
    return [(f"n{r.randrange(n):02d}", f"n{r.randrange(n):02d}") for _ in range(m)] + list(extra)


def near(rows):
    out = {}
    for a, b in rows:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set())
    return out


def depths(g, start):
    seen, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for y in g.get(x, ()):
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


GRAPHS = [
    made(1, 30, 45), [], [("a", None), ("c", "c"), (None, "b"), ("a", "b"), ("a", "b")],
    [(f"r{i:02d}", f"r{(i + 1) % 30:02d}") for i in range(30)] + [(f"r{(i + 1) % 30:02d}x", f"r{i:02d}x") for i in range(30)] + [("r03", "r05x")],
]


@pytest.mark.parametrize("rows", GRAPHS)
def test_components_are_mutual_reach(spark, rows):
    g = near(rows)
    reach = {x: set(depths(g, x)) for x in g}
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in g}
    edges = spark.createDataFrame(rows, EDGE)
    got = {r["id"]: r["component"] for r in components.strong_components(edges).collect()}
    assert got == want
    inside = sorted((want[a], a, b) for a in g for b in g[a] if want[a] == want[b])
    assert sorted(map(tuple, components.hops_inside(edges).collect())) == inside
    cyclic = {c for c, _, _ in inside}
    cycles = {r["component"]: r["cycle"] for r in components.component_cycles(edges).collect()}
    assert set(cycles) == cyclic
    for c, path in cycles.items():
        assert path[0] == c and len(set(path)) == len(path) and all(b in g[a] for a, b in zip(path, path[1:] + path[:1]))
        assert len(path) == min(depths(g, b)[c] + 1 for b in g[c] if c in depths(g, b))


@pytest.mark.parametrize("depth", [None, 2])
def test_seed_bitmaps(spark, depth):
    """Over 64 seeds, so that they fill two blocks; a seed that no edge names reaches itself."""
    rows = made(7, 80, 110)
    g = near(rows)
    seeds = [f"n{i:02d}" for i in range(70)] + ["alone"]
    numbers = traverse.numbered_seeds(spark.createDataFrame([(s,) for s in seeds + seeds[:3]] + [(None,)], "id string"))
    sets = traverse.reach_sets(numbers, spark.createDataFrame(rows, EDGE), depth)
    got = sorted(map(tuple, traverse.expanded(sets, numbers).collect()))
    want = sorted((s, x, d) for s in seeds for x, d in depths(g, s).items() if depth is None or d <= depth)
    assert got == want
    assert sets.count() < len(want) and {r["block"] for r in numbers.collect()} == {0, 1}
    sizes = {r["id"]: r["n_seeds"] for r in traverse.set_sizes(sets).collect()}
    assert sizes["alone"] == 1 and sum(sizes.values()) == len(want)


def test_reached_by_any(spark):
    rows = made(9, 40, 45)
    g = near(rows)
    got = {r["id"]: r["depth"] for r in traverse.reached(spark.createDataFrame([("n01",), ("n02",)], "id string"), spark.createDataFrame(rows, EDGE)).collect()}
    want = {}
    for s in ("n01", "n02"):
        for x, d in depths(g, s).items():
            want[x] = min(d, want.get(x, d))
    assert got == want


def test_paths_from_both_ends(spark):
    rows = made(11, 60, 90, [(f"c{i}", f"c{i + 1}") for i in range(21)])
    g = near(rows)
    pairs = [(f"n{i:02d}", f"n{(i * 7 + 3) % 60:02d}") for i in range(40)] + [("c0", "c21"), ("c21", "c0"), ("n01", "n01"), ("no", "n01"), (None, "n01"), ("n01", "n02"), ("n01", "n02")]
    out = traverse.paths_between(spark.createDataFrame(pairs, EDGE), spark.createDataFrame(rows, EDGE)).collect()
    assert len(out) == len(set(pairs))
    for r in out:
        d = depths(g, r["src"]) if r["src"] in g else {r["src"]: 0}
        if r["src"] is None or r["dst"] not in d:
            assert r["path"] is None
        else:
            assert (r["path"][0], r["path"][-1], len(r["path"]) - 1) == (r["src"], r["dst"], d[r["dst"]])
            assert all(b in g[a] for a, b in zip(r["path"], r["path"][1:]))


def test_paths_from_one_start(spark):
    rows = made(13, 50, 90, [("n01", "c0")] + [(f"c{i}", f"c{i + 1}") for i in range(9)])
    g = near(rows)
    d = depths(g, "n01")
    got = {r["id"]: r["path"] for r in graph.shortest_paths(spark.createDataFrame([("n01",)], "id string"), spark.createDataFrame(rows, EDGE)).collect()}
    assert set(got) == set(d)
    for x, path in got.items():
        assert len(path) == d[x] + 1
        for a, b in zip(path, path[1:]):
            assert a == min(y for y in g if b in g[y] and d.get(y) == d[b] - 1)


def test_plans_do_not_grow(spark):
    """A chain of 40 levels leaves a plan with one scan of the levels."""
    rows = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    seen = traverse.reached(spark.createDataFrame([("c00",)], "id string"), spark.createDataFrame(rows, EDGE))
    assert seen.count() == 41
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1

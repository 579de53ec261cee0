"""Shortest paths against a plain search."""

import random
from collections import deque

import pytest

from lattis.operators import paths as P
from lattis.operators import topology as T

EDGE = "source_id string, target_id string"


def near(pairs):
    out = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def plain(graph, a, b, longest=None):
    """Hops, status and the least shortest path, by a search from ``b`` and a walk from ``a``."""
    if a is not None and a == b:
        return 0, "found", [a]
    d, queue = {b: 0}, deque([b])
    while queue:
        u = queue.popleft()
        for v in graph.get(u, ()):
            if v not in d:
                d[v] = d[u] + 1
                queue.append(v)
    if a not in d or a not in graph or b is None:
        return None, "apart", None
    if longest is not None and d[a] > longest:
        return None, "further", None
    path = [a]
    while path[-1] != b:
        path.append(min(v for v in graph[path[-1]] if d[v] == d[path[-1]] - 1))
    return d[a], "found", path


def check(spark, edges, pairs, longest=None):
    graph = near(edges)
    got = P.shortest_paths(spark.createDataFrame(edges, EDGE), spark.createDataFrame(pairs, "a string, b string"), longest).collect()
    assert len(got) == len(set(pairs))
    assert {(r["a"], r["b"]): (r["hops"], r["status"], r["path"]) for r in got} == {p: plain(graph, *p, longest) for p in set(pairs)}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(40)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range((45, 60)[seed])]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(60)]
    check(spark, edges, pairs, (None, 3)[seed])


def test_a_grid_has_one_least_path(spark):
    name = lambda x, y: f"{x}{y}"
    edges = [(name(x, y), name(x + i, y + j)) for x in range(5) for y in range(5) for i, j in ((0, 1), (1, 0)) if x + i < 5 and y + j < 5]
    check(spark, edges, [("00", "44"), ("44", "00"), ("04", "40"), ("22", "23")])


def test_long_chain_nulls_and_strangers(spark):
    edges = [(f"c{i:02}", f"c{i + 1:02}") for i in range(11)] + [("x", "y"), ("x", "x"), (None, "x"), ("y", None), ("x", "y")]
    pairs = [("c00", "c11"), ("c00", "x"), ("z", "z"), ("z", "x"), (None, "x"), ("x", "y"), ("x", "y"), (None, None)]
    check(spark, edges, pairs, 10)
    check(spark, [], pairs)


def test_hops_alone_know_no_bound(spark):
    edges = spark.createDataFrame([(f"c{i:02}", f"c{i + 1:02}") for i in range(9)], EDGE)
    pairs = spark.createDataFrame([("c00", "c09"), ("c00", "q")], "a string, b string")
    assert {(r["b"], r["hops"]) for r in T.shortest_paths(edges, pairs).collect()} == {("c09", 9), ("q", None)}
    assert {(r["b"], r["hops"]) for r in T.shortest_paths(edges, pairs, 8).collect()} == {("c09", None), ("q", None)}


def test_waypoints(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("p", "q")], EDGE)
    rows = [(1, 0, "a"), (1, 1, "c"), (1, 2, "e"), (2, 0, "a"), (2, 1, "p"), (2, 2, "q"), (3, 0, "a"), (4, 0, "a"), (4, 1, "nowhere"), (4, 2, "c"), (5, 0, None), (6, 1, "a"), (6, 2, "e")]
    got = P.between_waypoints(edges, spark.createDataFrame(rows, "qid int, pos int, id string"), 3).collect()
    assert {r["qid"]: tuple(r)[1:] for r in got} == {1: (2, 0, 0, ["b", "d"]), 2: (2, 1, 0, []), 3: (0, 0, 0, []), 4: (0, 0, 0, []), 6: (1, 0, 1, [])}

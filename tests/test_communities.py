"""Community search to its end, against a plain sequential one."""

import random

import pytest
from pyspark.sql import functions as F

from lattis.operators import gaps as G
from lattis.operators import topology as T

EDGE = "source_id string, target_id string"


def ring_of_cliques(n, k):
    inner = [(f"c{c:02d}_{i}", f"c{c:02d}_{j}") for c in range(n) for i in range(k) for j in range(i)]
    return inner + [(f"c{c:02d}_0", f"c{(c + 1) % n:02d}_1") for c in range(n)]


def planted(groups, size, inside, across, seed):
    rng = random.Random(seed)
    names = [f"g{g}_{i:02d}" for g in range(groups) for i in range(size)]
    return [(a, b) for i, a in enumerate(names) for b in names[:i] if rng.random() < (inside if a[:2] == b[:2] else across)]


def hub(n):
    """A hub that touches everyone, and pairs of the others."""
    return [("hub", f"n{i:03d}") for i in range(n)] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, n - 1, 2)] * 3


def quality(edges, at):
    m, inside, degree = len(edges), {}, {}
    for a, b in edges:
        degree[at[a]] = degree.get(at[a], 0) + 1
        degree[at[b]] = degree.get(at[b], 0) + 1
        if at[a] == at[b]:
            inside[at[a]] = inside.get(at[a], 0) + 1
    return sum(inside.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in degree.items())


def one_by_one(edges):
    """Nodes in order, each to the neighbouring community of the largest gain, then contraction, until nothing moves."""
    at = {x: x for e in edges for x in e}
    links, m2 = {}, 2 * len(edges)
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            links.setdefault(x, {})
            links[x][y] = links[x].get(y, 0) + 1
    while True:
        own = {x: x for x in links}
        k = {x: sum(links[x].values()) for x in links}
        total, moved, again = dict(k), False, True
        while again:
            again = False
            for x in sorted(links):
                near = {own[x]: 0}
                for y, w in links[x].items():
                    if y != x:
                        near[own[y]] = near.get(own[y], 0) + w
                total[own[x]] -= k[x]
                gain = {c: w - k[x] * total[c] / m2 for c, w in near.items()}
                to = min(gain, key=lambda c: (-gain[c], c))
                if gain[to] > gain[own[x]] + 1e-12:
                    own[x], moved, again = to, True, True
                total[own[x]] += k[x]
        at = {x: own[c] for x, c in at.items()}
        if not moved:
            return at
        joined = {}
        for x, ys in links.items():
            for y, w in ys.items():
                row = joined.setdefault(own[x], {})
                row[own[y]] = row.get(own[y], 0) + w
        links = joined


@pytest.mark.parametrize("edges", [ring_of_cliques(12, 5), planted(4, 16, 0.5, 0.03, 7), hub(60)], ids=["cliques", "planted", "hub"])
def test_as_good_as_one_by_one(spark, edges):
    found = {r["id"]: r["community"] for r in G.label_communities(spark.createDataFrame(edges, EDGE)).collect()}
    assert set(found) == {x for e in edges for x in e}
    assert quality(edges, found) >= quality(edges, one_by_one(edges)) - 1e-6


def test_the_end_is_no_number_of_rounds(spark):
    """A long path goes on after the rounds and levels at which a bounded search stops."""
    path = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(200)]
    edges = spark.createDataFrame(path, EDGE)
    ended, stopped = ({r["id"]: r["community"] for r in G.label_communities(edges, **how).collect()} for how in ({}, {"rounds": 3, "levels": 2}))
    assert quality(path, ended) > quality(path, stopped) + 0.01
    assert quality(path, ended) >= quality(path, one_by_one(path)) - 0.01


def test_odd_edges(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "a"), ("x", None), (None, None), ("c", "c")]
    found = {r["id"]: r["community"] for r in G.label_communities(spark.createDataFrame(rows, EDGE).withColumn("community", F.lit(1))).collect()}
    assert set(found) == {"a", "b", "c"} and found["a"] == found["b"] != found["c"]
    empty = spark.createDataFrame([], EDGE)
    assert G.label_communities(empty).collect() == []
    assert T.modularity(empty, G.label_communities(empty)).first()["modularity"] == 0

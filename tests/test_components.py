"""Connected components against a plain union-find."""

import random

from lattis.operators.components import connected_components


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None:
            continue
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def run(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    return {r["node"]: r["component"] for r in connected_components(df).collect()}


def test_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    assert run(spark, edges) == plain(edges)


def test_path_hub_loops_nulls_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (300, 300), (None, 3), (1, 0), (1, 0)]
    assert run(spark, edges) == plain(edges)


def test_no_edges(spark):
    assert run(spark, []) == {}


def test_more_links_than_a_task_has_shrink_round_by_round(spark, monkeypatch):
    from lattis.operators import components

    rounds = []
    stars = components._stars
    monkeypatch.setattr(components, "_stars", lambda *a: rounds.append(a) or stars(*a))
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(3_000)] + [(rng.randrange(4_000, 9_000), rng.randrange(4_000, 9_000)) for _ in range(4_000)] + [(10_000, x) for x in range(10_001, 12_000)] + [(7, 7), (20_000, 20_000), (None, 3), (1, 0)]
    df = spark.createDataFrame([(None if a is None else f"n{a}", f"n{b}") for a, b in edges], "src string, dst string")
    found = {r["node"]: r["component"] for r in connected_components(df, rows_a_task=100).collect()}
    assert found == plain([(None if a is None else f"n{a}", f"n{b}") for a, b in edges])
    assert not rounds  # the star rounds keep as many links as there are nodes

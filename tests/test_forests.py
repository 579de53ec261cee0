"""Forests, bridges and bars against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lattis.operators import forests as T
from lattis.operators import gaps as G

PAIR = "source_id string, target_id string"


def kruskal(links):
    up, out = {}, []

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in links if a != b):
        if root(a) != root(b):
            up[root(a)] = root(b)
            out.append((a, b, w))
    return out


def parts(nodes, edges):
    return len(nodes) - len(kruskal([(a, b, 0) for a, b in edges]))


def plain_bridges(edges):
    simple = {(min(e), max(e)) for e in edges if None not in e and e[0] != e[1]}
    nodes = {x for e in simple for x in e}
    whole = parts(nodes, simple)
    return {e for e in simple if parts(nodes, simple - {e}) > whole}


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):03}", f"n{rng.randrange(n):03}") for _ in range(m)]


@pytest.mark.parametrize("seed,rows_a_task", [(0, 0), (1, 10), (2, 250_000)])
def test_minimum_forest(spark, seed, rows_a_task):
    rng = random.Random(seed)
    links = [(a, b, rng.randrange(9)) for a, b in random_edges(seed, 50, 90)]
    got = T.minimum_forest(spark.createDataFrame(links, "a string, b string, w long"), rows_a_task)
    assert sorted(tuple(r) for r in got.collect()) == sorted(kruskal(links))


def test_a_rising_chain_and_odd_links(spark):
    links = [(f"c{i:03}", f"c{i + 1:03}", float(i)) for i in range(60)] + [("x", "x", 1.0), (None, "x", 1.0), ("y", "z", None), ("z", "y", 4.0)]
    got = T.minimum_forest(spark.createDataFrame(links, "a string, b string, w double"), 0).collect()
    assert sorted((r["a"], r["b"], r["w"]) for r in got) == sorted([*links[:60], ("y", "z", None)])
    assert T.minimum_forest(spark.createDataFrame([], "a string, b string, w double")).collect() == []


@pytest.mark.parametrize("seed,m,rows_a_task", [(0, 50, 0), (1, 70, 250_000), (2, 80, 250_000), (3, 45, 5)])
def test_bridges_equal_removing_each_edge(spark, seed, m, rows_a_task):
    edges = random_edges(seed, 50, m) + [(None, "n001"), ("n001", "n001")]
    got = T.bridges(spark.createDataFrame(edges, PAIR), strip=seed % 3, rows_a_task=rows_a_task).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_bridges(edges)


def test_a_long_path_with_a_ring_at_each_end(spark):
    n = 200_000
    path = spark.range(n - 1).select(F.concat(F.lit("p"), F.col("id")).alias("source_id"), F.concat(F.lit("p"), F.col("id") + 1).alias("target_id"))
    rings = spark.createDataFrame([("p0", "r1"), ("r1", "r2"), ("r2", "p0"), (f"p{n - 1}", "s1"), ("s1", "s2"), ("s2", f"p{n - 1}")], PAIR)
    found = G.bridges(None, path.union(rings))
    assert found.count() == n - 1 and found.where("a like 'r%' or b like 's%'").isEmpty()


def test_cut_values_by_rounds_equal_one_task(spark):
    rng = random.Random(5)
    tree = [(f"v{i}", f"v{i - 1 if i % 3 else rng.randrange(i)}", str(i)) for i in range(1, 60)]
    label = {f"v{i}": [rng.randrange(1 << 40), rng.randrange(1 << 40)] for i in range(59)}
    total = [0, 0]
    for own in label.values():
        total = [total[0] ^ own[0], total[1] ^ own[1]]
    label["v59"] = total
    frames = spark.createDataFrame(tree, "x string, y string, e string"), spark.createDataFrame([(v, *own) for v, own in label.items()], "v string, l long, m long")
    one, many = (sorted(tuple(r) for r in T.cut_values(*frames, k).collect()) for k in (1_000, 0))
    assert one == many and len(one) == 59


def test_bars(spark):
    rng = random.Random(7)
    links = [(a, b, rng.randrange(30)) for a, b in random_edges(7, 40, 60)]
    got = {r["death"]: r["bars"] for r in T.component_bars(spark.createDataFrame([*links, ("n1", None, 3), ("q", "r", None)], "a string, b string, w int"), 20).collect()}
    want = {}
    for _, _, w in kruskal(links):
        want[w] = want.get(w, 0) + 1
    nodes = {x for a, b, _ in links for x in (a, b)}
    assert got == want | {None: len(nodes) - sum(want.values())}
    assert T.component_bars(spark.createDataFrame([], "a string, b string, w int")).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_bridges_settled_in_bins(spark, seed):
    """Bins of a few edges, with rows that come twice in one bin and in others, equal removing each edge."""
    rng = random.Random(seed)
    ways = [(f"w{i:02}", f"w{i + 1:02}") for i in range(30)] + [("w03", "w09"), ("w12", "w14"), ("w29", "w01" if seed % 2 else "w25"), ("w12", "leaf")]
    edges = ways + random_edges(seed, 40, 30) + rng.sample(ways, 8)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = T.bridges(spark.createDataFrame(edges, PAIR).coalesce(2), rows_a_task=6).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_bridges(edges)


def test_names_of_one_number_get_others(spark, monkeypatch):
    plain = T._number
    monkeypatch.setattr(T, "_number", lambda name, seed: plain(name, seed) % 5 if seed == 0 else plain(name, seed))
    edges = random_edges(3, 30, 28)
    assert {tuple(r) for r in T.bridges(spark.createDataFrame(edges, PAIR)).collect()} == plain_bridges(edges)


def test_near_edges_are_settled_where_they_are(spark, monkeypatch):
    """Chains that hang on one hub need no forests, however many there are."""
    monkeypatch.setattr(T, "minimum_forest", None)
    chains = spark.range(4_000).selectExpr("concat('n', id) as source_id", "if(id % 10 = 0, 'hub', concat('n', id - 1)) as target_id")
    rings = spark.range(200).selectExpr("concat('n', id * 20) as source_id", "concat('n', id * 20 + 9) as target_id")
    found = T.bridges(chains.union(rings), rows_a_task=500)
    assert found.count() == 4_000 - 200 * 9

"""Pruned, ranged and rewritten operators against plain versions."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattis.operators import gaps as G
from lattis.operators import retrieval as R
from lattis.operators import stats as T
from lattis.operators.components import connected_components
from lattis.operators.ordering import running


def boundary_bars(d):
    """Finite one-dimensional bars of positive length by reducing the boundary matrix of all triangles."""
    n = len(d)
    edges = sorted((int(d[i, j]), i, j) for i, j in combinations(range(n), 2))
    place = {(i, j): k for k, (_, i, j) in enumerate(edges)}
    pivots, bars = {}, []
    for death, i, j, k in sorted((int(max(d[i, j], d[i, k], d[j, k])), i, j, k) for i, j, k in combinations(range(n), 3)):
        column = {place[i, j], place[i, k], place[j, k]}
        while column and max(column) in pivots:
            column ^= pivots[max(column)]
        if column:
            pivots[max(column)] = column
            if death > edges[max(column)][0]:
                bars.append(death - edges[max(column)][0])
    return len(bars), float(max(bars, default=0))


@pytest.mark.parametrize("seed", range(30))
def test_holes_equal_the_boundary_matrix(seed):
    rng = random.Random(seed)
    n = rng.randrange(4, 19)
    pairs = set(combinations(range(n), 2))
    chosen = rng.sample(sorted(pairs), min(len(pairs), rng.randrange(n - 2, 2 * n)))
    near = [[] for _ in range(n)]
    for a, b in chosen:
        near[a].append(b)
        near[b].append(a)
    d = G._hops(near)
    assert G._h1(d) == boundary_bars(d)


def test_a_long_ring_and_a_grid_end_soon():
    ring = [[(i - 1) % 700, (i + 1) % 700] for i in range(700)]
    assert G._h1(G._hops(ring)) == (1, float(-(-700 // 3) - 1))
    side = 22
    at = lambda x, y: x * side + y
    grid = [[at(x + i, y + j) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= x + i < side and 0 <= y + j < side] for x in range(side) for y in range(side)]
    assert G._h1(G._hops(grid)) == ((side - 1) ** 2, 1.0)


def test_large_components_are_flagged_or_drawn(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{(i + 1) % 60:03}") for i in range(60)] + [("x", "y"), ("y", "z"), ("z", "w"), ("w", "x")], "source_id string, target_id string").withColumn("edge_type", F.lit("e"))
    nodes = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct().withColumn("name", F.col("id")).withColumn("entity_type", F.lit("t"))
    one = {r["component"]: r for r in G.betti(nodes, edges, most_nodes=50, largest_only=False).collect()}
    assert (one["n000"]["skipped"], one["n000"]["nodes"], one["n000"]["beta0"]) == (True, 60, 0)
    assert (one["w"]["skipped"], one["w"]["beta0"], one["w"]["beta1"]) == (False, 1, 1)
    r = G.betti(nodes, edges, most_nodes=50, subsample=True).first()
    assert not r["skipped"] and r["nodes"] == 50 and 1 <= r["beta0"] <= 10 and r["beta1"] == 0
    full = G.betti(nodes, edges).first()
    assert (full["beta0"], full["beta1"], full["max_persistence"]) == (1, 1, 19.0)
    cycles = {r["component"]: (r["length"], r["cycle"]) for r in G.cycle_basis(nodes, edges, most_nodes=50).collect()}
    assert cycles == {"n000": (None, None), "w": (4, ["w", "x", "y", "z"])}


@pytest.mark.parametrize("seed", range(6))
def test_candidate_gaps_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    types = "abcdefgh"
    held = {f"c{i:02}": [rng.choice(types[: rng.choice((2, 5, 8))]) for _ in range(rng.choice((3, 3, 4, 9)))] for i in range(40)}
    placed = [(f"{c}:{k}", t, c) for c, ts in held.items() for k, t in enumerate(ts)]
    n = {t: sum(t in ts for ts in held.values()) for t in types}
    rare = {t: 1 / (1 + np.log2(n[t])) for t in types if n[t] and n[t] <= 0.5 * len(held)}
    pairs = []
    for a, b in combinations(sorted(held), 2):
        shared = set(held[a]) & set(held[b]) & set(rare)
        if shared:
            pairs.append((-round(sum(rare[t] for t in sorted(shared)) * min(len(held[a]), len(held[b])) ** 0.5, 6), a, b))
    found = G.candidate_gaps(spark.createDataFrame(placed, "id string, entity_type string, component string"), k=7).collect()
    assert [(r["a"], r["b"]) for r in found] == [(a, b) for _, a, b in sorted(pairs)[:7]]
    assert [r["score"] for r in found] == pytest.approx([-s for s, _, _ in sorted(pairs)[:7]], abs=2e-6)


def test_running_sums_and_extremes(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice((None, rng.randrange(100)))) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(5)
    for over, plain in ((F.sum, sum), (F.min, min), (F.max, max)):
        found = {r["i"]: r["x"] for r in running(df, ["i"], "v", over, "x").collect()}
        seen = []
        for i, v in sorted(rows):
            seen += [v] if v is not None else []
            assert found[i] == (plain(seen) if seen else None)
    assert running(spark.createDataFrame([], "i int, v int"), ["i"], "v", F.sum, "x").collect() == []


def test_isotonic_over_many_ranges(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.random(600), 3)
    y = (rng.random(600) < x).astype(int)
    found = {r["x"]: (r["n"], r["fitted"]) for r in T.isotonic(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "score double, y int")).collect()}
    u = np.unique(x)
    blocks = []
    for k in u:
        blocks.append([y[x == k].sum(), (x == k).sum(), [k]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, ks = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + ks]
    plain = {k: s / n for s, n, ks in blocks for k in ks}
    assert set(found) == set(u.tolist())
    assert all(found[k][0] == (x == k).sum() and found[k][1] == pytest.approx(plain[k], abs=1e-8) for k in found)
    assert T.isotonic(spark.createDataFrame([], "score double, y int")).collect() == []


def test_interpolation_around_many_points(spark):
    points = [(k / 10, k * k / 100) for k in range(11)]
    asked = [(float(v),) for v in np.round(np.random.default_rng(1).uniform(-0.3, 1.3, 200), 4)] + [(0.5,), (0.5,), (1.0,), (0.0,)]
    found = sorted((r["score"], r["p"]) for r in T.interpolate(spark.createDataFrame(points, "x double, fitted double"), spark.createDataFrame(asked, "score double")).collect())
    plain = sorted((v, float(np.interp(v, [x for x, _ in points], [y for _, y in points]))) for (v,) in asked)
    assert [v for v, _ in found] == [v for v, _ in plain] and [p for _, p in found] == pytest.approx([p for _, p in plain])


def test_components_of_hubs(spark):
    edges = [(5_000, i) for i in range(1, 3_000)] + [(0, 9_000 + i) for i in range(2_500)] + [(7_000 + i, 7_001 + i) for i in range(300)] + [(5_000, 0)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), rows_a_task=1_000).collect()}
    assert set(found.values()) == {0, 7_000} and sum(c == 7_000 for c in found.values()) == 301


def test_blocks_of_queries_lose_none(spark):
    q = spark.createDataFrame([(i,) for i in range(23)], "qid long")
    d = spark.createDataFrame([(i,) for i in range(40)], "id long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(R.hashed_topk(q, d, 3)) == rows(R.hashed_topk(q, d, 3, block=4)) and R.hashed_topk(q, d, 3).count() == 69
    pages = spark.createDataFrame([("a/b",), ("b/c",), (None,)], "url string")
    words = spark.createDataFrame([(1, "b"), (2, "c"), (3, "x"), (4, None)], "qid long, w string")
    assert rows(R.address_hits(words, pages)) == rows(R.address_hits(words, pages, block=1)) == [(1, 2), (2, 1)]


def test_no_window_without_partition_over_rows(spark):
    for df in (T.benjamini_hochberg(spark.createDataFrame([(1, 0.5), (2, 0.1)], "id int, p double")), T.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0)], "x double, y double"), "x", "y")):
        text = df._jdf.queryExecution().analyzed().toString()
        assert not any("windowspecdefinition(" in line and "_task" not in line for line in text.splitlines())

import numpy as np

from lattis.llm import embedding_hnsw as H

ROWS = "vec_id long, embedding array<float>, label int, rep long"


def vectors(rng, n, dims=16, labels=3):
    centres = rng.normal(size=(max(1, n // 8), dims))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * rng.choice([0.0, 0.05, 0.2], n)[:, None]
    return [(i, [float(np.float32(v)) for v in x[i]], int(rng.integers(0, labels)), 0) for i in range(n)]


def slow(rows, least=0.98):
    def unit(v, label):
        a = np.array(v, dtype=float) if v and None not in v and label is not None else None
        return None if a is None or not np.isfinite(a).all() or not a.any() else a / np.sqrt((a * a).sum())

    units = [unit(v, label) for _, v, label, _ in rows]
    links = {i: [j for j in range(len(rows)) if j != i and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(len(rows))}
    out = []
    for i in range(len(rows)):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        out.append((rows[i][0], len(links[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def fast(spark, rows, **how):
    found = H.near_duplicate_vectors(spark.createDataFrame(rows, ROWS), **how).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found)


def test_equals_brute_force(spark):
    rows = vectors(np.random.default_rng(1), 400)
    expected = slow(rows)
    assert fast(spark, rows) == expected
    assert fast(spark, rows, shard_size=40, chunk=50, recall=1.0) == expected


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]
    rows = [(1, a, 0, 0), (2, b, 0, 0), (3, a, 1, 0), (4, a, None, 0), (5, None, 0, 0), (6, [0.0] * 3, 0, 0), (7, [1.0, None, 2.0], 0, 0), (8, [nan, 1.0, 2.0], 0, 0), (9, [inf, 1.0, 2.0], 0, 0), (10, [], 0, 0), (11, a, 0, None), (12, [1.0, 2.0], 0, 0), (13, [1.0, 2.0], 0, 0)]
    assert fast(spark, rows) == slow(rows)
    assert fast(spark, []) == []


def test_a_cluster_wider_than_the_beam_is_walked_whole():
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(size=(1, 24)) + 0.02 * rng.normal(size=(600, 24)), rng.normal(size=(1500, 24))]
    unit = H._unit(x)
    graph = H.SmallWorld(unit)
    q, node = graph.search(unit[:50], 16, 0.98)
    truth = unit[:50] @ unit.T >= 0.98
    assert truth[q, node].all() and len(q) == len({*zip(q.tolist(), node.tolist())})
    assert len(q) >= 0.99 * truth.sum()


def test_islands_of_many_vectors_equal_brute_force(spark):
    """Groups of near but unequal vectors, up to 2,000 of them: a node's nearest are all of its own group."""
    rng = np.random.default_rng(5)
    sizes = [2000, 600, 600, 600, 80, 90, 100]
    x = np.concatenate([c + 0.05 * rng.normal(size=(n, 24)) for n, c in zip(sizes, rng.normal(size=(7, 24)))])
    x = x[rng.permutation(len(x))].astype(np.float32)
    unit = H._unit(x.astype(float))
    links = unit @ unit.T >= 0.98
    label = H.merge(np.arange(len(x)), *np.nonzero(links))
    found = fast(spark, [(i, v, 0, 0) for i, v in enumerate(x.tolist())])
    assert found == [(i, int(links[i].sum()) - 1, int(label[i])) for i in range(len(x))]
    assert not H.SmallWorld(unit).whole


def test_the_audit_leaves_out_self_hits_and_falls_back():
    rng = np.random.default_rng(6)
    unit = H._unit(rng.normal(size=(900, 16)))
    near = H._unit(unit[:300] + 0.01 * rng.normal(size=(300, 16)))
    own, reps = np.r_[unit, near], np.arange(1200)

    class Blind:
        """Finds each query itself and nothing else."""

        whole = True

        def search(self, queries, beam, reach):
            return np.arange(len(queries)), (queries @ own.T).argmax(axis=1)

    ask = lambda graph, ids: H._audited(graph, own[ids], reps[ids], own, reps, 0.98, 48, 0.5, 48)
    assert ask(Blind(), reps) == 0
    assert ask(H.SmallWorld(own), reps) in (0, 48, 96)
    assert H._strongly_connected(np.array([[1, -1], [2, -1], [0, -1]])) and not H._strongly_connected(np.array([[1, -1], [2, -1], [1, -1]]))


def test_recall_of_the_index_over_a_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"], 0) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    found, expected = fast(spark, rows), slow(rows)
    assert sum(n for _, n, _ in found) >= 0.9 * sum(n for _, n, _ in expected)


def test_null_and_shared_ids_lose_no_link(spark):
    a, b, far = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01], [-3.0, 1.0, 0.0]
    rows = [(7, a, 0, 0), (9, a, 0, 0), (None, a, 0, 0), (11, b, 0, 0), (20, far, 0, 0), (20, [-3.0, 1.0, 0.01], 0, 0), (30, [0.0, 0.0, 1.0], 0, 0), (30, [0.0, 1.0, 0.0], 0, 0), (None, [5.0, -5.0, 5.0], 0, 0)]
    found = H.near_duplicate_vectors(spark.createDataFrame(rows, ROWS)).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found), key=str)
    assert got == sorted([(7, 3, 7, True), (9, 3, 7, False), (None, 3, 7, None), (11, 3, 7, False), (20, 1, 20, True), (20, 1, 20, True), (30, 0, 30, True), (30, 0, 30, True), (None, 0, None, None)], key=str)


def test_vectors_that_link_with_nothing_among_others(spark):
    rows = [(1, None, 0, 0), (2, [0.0, 0.0], 0, 0), (3, [1.0, None], 0, 0), (4, [], 0, 0), (5, [3.0, 4.0], 0, 0), (6, [float("inf"), 1.0], 0, 0), (7, [3.0, 4.0], None, 0)]
    read = {r["vec_id"]: r["v"] for r in H.read_vectors(spark.createDataFrame(rows, ROWS)).collect()}
    assert {k for k, v in read.items() if v is not None} == {5} and np.frombuffer(bytes(read[5])).tolist() == [3.0, 4.0]


def test_the_graph_is_searched_while_it_grows():
    """Insertion in batches keeps every node reachable and finds what brute force finds."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x[1::5] = x[0::5] + 0.03 * rng.normal(size=x[1::5].shape)
    unit = H._unit(x)
    graph = H.SmallWorld(unit)
    assert graph.whole
    q, node = graph.search(unit, 48, 0.98)
    truth = unit @ unit.T >= 0.98
    assert len(q) >= 0.99 * truth.sum() and truth[q, node].mean() > 0.999


def test_unrelated_vectors_take_the_graph_and_little_work():
    unit = H._unit(np.random.default_rng(11).normal(size=(8_192, 64)))
    graph, reps = H.SmallWorld(unit), np.arange(8_192)
    assert not (unit[::64] @ unit.T >= 0.98).sum() > 128  # nothing but themselves
    beam = H._audited(graph, unit, reps, unit, reps, 0.98, 24, 0.99, 48)
    assert 0 < beam <= 48
    queries = np.ascontiguousarray(unit[::16], dtype=np.float32)
    at, best = np.zeros(len(queries), dtype=np.int64), queries @ graph.unit[0]
    for k in reversed(range(1, len(graph.links))):
        at, best = graph._walk(k, queries, at, best)
    seen = graph._beam(0, queries, at, best, beam, 0.98)[2]
    assert seen.mean() < 0.2


def test_planted_links_from_098_on_are_found():
    rng = np.random.default_rng(12)
    unit = H._unit(rng.normal(size=(4_000, 64)))
    unit[:200] = H._probes(unit[200:400], 0.98)
    unit[400:600] = H._probes(unit[600:800], 0.999)
    graph, reps = H.SmallWorld(unit), np.arange(4_000)
    beam = H._audited(graph, unit, reps, unit, reps, 0.98, 24, 0.99, 48)
    assert 0 < beam <= 48
    truth = unit @ unit.T >= 0.98
    q, node = graph.search(unit, beam, 0.98 - 1e-4)
    assert truth.sum() == 4_000 + 800 and truth[q, node].sum() >= 0.99 * truth.sum() and truth[:800][q[q < 800], node[q < 800]].sum() >= 800 + 0.99 * 800


def test_probes_lie_just_within_reach():
    unit = H._unit(np.random.default_rng(13).normal(size=(50, 8)))
    cosine = (H._probes(unit, 0.98) * unit).sum(axis=1)
    assert (cosine >= 0.98).all() and (cosine < 0.98 + 1e-6).all()
    assert (H._probes(np.ones((3, 1)), 0.98) == 1).all()


def test_links_of_a_table_with_planted_ones(spark):
    rng = np.random.default_rng(14)
    unit = H._unit(rng.normal(size=(600, 32)))
    unit[:40] = H._probes(unit[40:80], 0.99)
    rows = [(i, [float(np.float32(x)) for x in v], i % 2 * 0, 0) for i, v in enumerate(unit)]
    found = fast(spark, rows)
    assert found == slow(rows) and sum(n for _, n, _ in found) == 80

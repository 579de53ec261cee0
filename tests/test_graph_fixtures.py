"""Hand-made graphs with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattis.operators import gaps as G
from lattis.operators import integrity as I
from lattis.operators import relations as R
from lattis.operators import topology as T

EDGE = "source_id string, target_id string, edge_type string"
NODE = "id string, name string, entity_type string"


def edges(spark, text):
    """``A-B A-F:MENTIONS`` as an edge list."""
    rows = []
    for item in text.split():
        pair, _, kind = item.partition(":")
        rows.append((*pair.split("-"), kind or "RELATED"))
    return spark.createDataFrame(rows, EDGE)


def nodes(spark, **types):
    return spark.createDataFrame([(x, x, kind) for kind, ids in types.items() for x in ids.split()], NODE)


@pytest.fixture(scope="module")
def gap_graph(spark):
    n = nodes(spark, topic="A B C D E G H I J", note="F K", tag="L")
    return n, edges(spark, "A-B B-C C-D D-E E-A G-H H-I I-J J-G A-F:MENTIONS G-K:MENTIONS")


def test_gap_graph_health(gap_graph):
    r = T.structural_health(*gap_graph).first()
    assert (r["nodes"], r["edges"], r["components"], r["largest_component"], r["isolated"]) == (12, 11, 3, 6, 1)
    assert [(x["entity_type"], x["n"]) for x in T.isolates_by_type(*gap_graph).collect()] == [("tag", 1)]


def test_gap_graph_bridges_cycles_and_holes(gap_graph):
    assert {(r["a"], r["b"]) for r in G.bridges(*gap_graph).collect()} == {("A", "F"), ("G", "K")}
    cycles = {r["component"]: r["cycle"] for r in G.cycle_basis(*gap_graph).collect()}
    assert cycles == {"A": ["A", "B", "C", "D", "E"], "G": ["G", "H", "I", "J"]}
    r = G.betti(*gap_graph).first()
    assert (r["component"], r["beta0"], r["beta1"]) == ("A", 1, 1)
    assert T.cyclomatic(*gap_graph).first()["cycles"] == 2


def test_gap_graph_candidates_and_seeds(spark, gap_graph):
    n, e = gap_graph
    placed = n.join(T.components_of(n, e), "id")
    (r,) = G.candidate_gaps(placed).collect()
    assert (r["a"], r["b"], r["shared"]) == ("A", "G", 2) and r["score"] == pytest.approx(2 * 5**0.5, abs=1e-5)
    seeds = spark.createDataFrame([("E", "G"), ("A", "B"), ("E", "missing")], "x string, y string")
    r = G.seeded_recall(placed, seeds, G.candidate_gaps(placed)).first()
    assert (r["seeds"], r["recalled"], r["recall"], r["pair_precision"]) == (2, 1, 0.5, 1.0)


@pytest.mark.parametrize("n", [4, 5, 6, 9, 12])
def test_a_hop_cycle_dies_at_a_third(n):
    near = [[(i - 1) % n, (i + 1) % n] for i in range(n)]
    count, longest = G._h1(G._hops(near))
    assert (count, longest) == (1, -(-n // 3) - 1)


def test_a_tree_and_a_clique_have_no_hole():
    assert G._h1(G._hops([[1], [0, 2], [1]])) == (0, 0.0)
    assert G._h1(G._hops([[j for j in range(5) if j != i] for i in range(5)])) == (0, 0.0)


def test_bridges_between_cycles_and_along_chains(spark):
    e = edges(spark, "a-b b-c c-a c-d d-e e-f f-d " + " ".join(f"x{i}-x{i + 1}" for i in range(20)) + " p-q q-p")
    n = e.select(F.col("source_id").alias("id")).union(e.select("target_id")).distinct()
    found = {(r["a"], r["b"]) for r in G.bridges(n, e).collect()}
    assert found == {("c", "d"), ("p", "q")} | {tuple(sorted((f"x{i}", f"x{i + 1}"))) for i in range(20)}


@pytest.fixture(scope="module")
def duplicate_graph(spark):
    n = spark.createDataFrame([("e1", "Docker", "tool"), ("e2", "docker", "tool"), ("e3", "  Docker  ", "tool"), ("e4", "DOCKER", "tool"), ("e5", "Docker", "project"), ("e6", "Kubernetes", "tool"), ("e7", "Alice", "person"), ("e8", "", "tool")], NODE)
    return n, edges(spark, "e1-e6 e6-e5 e5-e7 e1-e7 e6-e7 e5-e6 e7-e1:MENTIONS e6-e1:LINKS_TO")


def test_duplicates(duplicate_graph):
    n, e = duplicate_graph
    r = I.collisions(n).first()
    assert (r["collisions"], r["unique_keys"], r["groups"]) == (3, 4, 1)
    assert I.required_fields(n).first()["gaps"] == 1
    m = I.monoculture(e).first()
    assert (m["dominant"], m["dominant_share"]) == ("RELATED", 0.75)
    assert {r["id"]: r["degree"] for r in T.raw_degree(e).collect()}["e1"] == 4
    (k,) = I.keepers(n, e).collect()
    assert (k["key"], k["keeper"], k["ids"]) == ("tool::docker", "e1", 4)


def test_reciprocal_edges_share_slots(duplicate_graph):
    found = {r["id"]: r["degree"] for r in T.multigraph_degree(duplicate_graph[1]).collect()}
    assert found == {"e1": 2, "e5": 2, "e6": 3, "e7": 3}


def test_loops_count_twice(spark):
    assert {r["id"]: r["degree"] for r in T.multigraph_degree(edges(spark, "a-a a-b")).collect()} == {"a": 3, "b": 1}


def test_brokers(spark):
    e = edges(spark, "a1-a2 a2-a3 a3-a1 b1-b2 b2-b3 b3-b1 X-a1 X-b1")
    found = {r["id"]: r for r in T.brokers(e).collect()}
    assert found["X"]["constraint"] == pytest.approx(0.5) and found["X"]["effective_size"] == pytest.approx(2)
    assert min(found.values(), key=lambda r: (r["constraint"], -r["effective_size"]))["id"] == "X"
    # by the definition, over every pair
    near = {}
    for a, b in [(r["source_id"], r["target_id"]) for r in e.collect()]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    p = lambda i, j: (j in near[i]) / len(near[i])
    for i in near:
        slow = sum((p(i, j) + sum(p(i, q) * p(q, j) for q in near if q not in (i, j))) ** 2 for j in near[i])
        assert found[i]["constraint"] == pytest.approx(slow)
    partition = spark.createDataFrame([(x, x[0]) for x in near], "id string, community string")
    assert {r["id"] for r in T.brokers(e, partition).collect()} == {"X", "a1", "b1"}
    one = partition.withColumn("community", F.lit("all"))
    assert T.brokers(edges(spark, "a-b a-c a-d b-c b-d c-d"), one.limit(0)).collect() == []


def test_communities_beat_trivial_partitions(spark):
    e = edges(spark, "a1-a2 a2-a3 a3-a1 a1-a4 a2-a4 b1-b2 b2-b3 b3-b1 b1-b4 b2-b4 a4-b4")
    q = lambda part: T.modularity(e, part).first()["modularity"]
    ids = e.select(F.col("source_id").alias("id")).union(e.select("target_id")).distinct()
    found = q(G.label_communities(e))
    assert found >= q(ids.withColumn("community", F.lit("x"))) and found >= q(ids.withColumn("community", F.col("id")))
    assert found == pytest.approx(q(ids.withColumn("community", F.substring("id", 1, 1))))


def test_empty_graph(spark):
    n, e = spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)
    r = T.structural_health(n, e).first()
    assert (r["nodes"], r["edges"], r["components"], r["edge_entropy"], r["largest_ratio"]) == (0, 0, 0, 0.0, 0.0)
    assert I.required_fields(n).first()["coverage"] == 1.0
    assert I.monoculture(e).first()["dominant_share"] == 0.0
    assert G.bridges(n, e).collect() == [] and T.brokers(e).collect() == []


def test_supersession(spark):
    pairs = ["d4-d3", "d3-d2", "d2-d1", "e2-e1", "f2-f1", "g2-g1", "h2-h1", "x9-h1"]
    e = edges(spark, " ".join(f"{p}:Supersedes" for p in pairs) + " d1-z:mentions").withColumn("seq", F.monotonically_increasing_id())
    r = R.supersession_report(e).first()
    assert (r["seeded"], r["resolved"], r["superseded"], r["completeness"]) == (8, 8, 7, 1.0)
    stamped = {(x["source_id"], x["target_id"]): x["superseded_by"] for x in R.stamp_superseded(e).collect()}
    assert stamped[("d1", "z")] == "d2" and stamped[("d2", "d1")] is None
    assert R.stamp_superseded(R.stamp_superseded(e)).where("superseded_by is not null").count() == 1
    chains = {x["head"]: (x["length"], x["chain"]) for x in R.supersession_chains(e.where("source_id <> 'x9'")).collect()}
    assert chains["d4"] == (4, "d1>d2>d3>d4") and len(chains) == 5


def test_contradictions(spark):
    e = edges(spark, "a-b:contradicts b-a:Conflicts-With c-c:contradict d-e:disputes").withColumn("seq", F.monotonically_increasing_id()).withColumn("evidence", F.when(F.col("source_id") == "a", "said so"))
    found = {(r["a"], r["b"]): r["claim_a"] for r in R.contradiction_pairs(e, nodes(spark, x="a b")).collect()}
    assert found == {("a", "b"): "said so", ("c", "c"): "c"}


def test_phantom_edges(spark):
    names = spark.createDataFrame([("Alice", ["Alice"]), ("Bob", ["Bobby", "Bob"]), ("dog", ["The"])], "id string, forms array<string>")
    bodies = spark.createDataFrame([("n1", "Alice met Bob"), ("n2", "")], "source_note string, body string")
    rows = [(1, "Alice", "Bob", "n1"), (2, "Alice", "Bob", "n2"), (3, "Alice", "Bob", "n3"), (4, "Alice", "dog", "n1"), (5, "Bob", "none", "n1")]
    found = {r["seq"]: (r["checkable"], r["phantom"], r["missing"]) for r in R.phantom_edges(spark.createDataFrame(rows, "seq long, source_id string, target_id string, source_note string"), names, bodies).collect()}
    assert found == {1: (True, False, None), 2: (True, True, "both"), 4: (False, False, None), 5: (False, False, None)}


@pytest.mark.parametrize("kind", ["duplicates", "orphans", "broken"])
def test_injected_defects_are_found(spark, gap_graph, kind):
    n, e = gap_graph
    n = n.where("id <> 'L'")
    if kind == "duplicates":
        clones = R.inject_duplicates(n, 3)
        r = R.defect_recall(clones, R.detect_duplicates(n.unionByName(clones), e), R.detect_duplicates(n, e)).first()
    elif kind == "orphans":
        more = R.inject_orphans(spark, 3)
        r = R.defect_recall(more, R.orphans(n.unionByName(more), e), R.orphans(n, e)).first()
    else:
        more = R.inject_broken_refs(n, 3)
        expected = more.select(F.col("target_id").alias("id"))
        r = R.defect_recall(expected, R.broken_refs(e.unionByName(more), n), R.broken_refs(e, n)).first()
    assert (r["expected"], r["recall"], r["delta_precision"]) == (3, 1.0, 1.0)


def test_injected_phantoms_and_monoculture(spark, gap_graph):
    n, e = gap_graph
    p = R.inject_phantoms(n, 3).withColumn("seq", F.monotonically_increasing_id())
    names = n.select("id", F.array("name").alias("forms")).withColumn("forms", F.array(F.concat(F.lit("name "), "id")))
    found = R.phantom_edges(p, names, spark.createDataFrame([("__empty_note", "")], "source_note string, body string")).collect()
    assert len(found) == 3 and all(r["phantom"] for r in found)
    before, after = I.monoculture(e).first(), I.monoculture(e.unionByName(R.inject_monoculture(e, 5))).first()
    assert after["dominant_share"] > before["dominant_share"] and after["entropy"] <= before["entropy"]


def test_entropy_is_bounded(spark):
    rng = np.random.default_rng(0)
    counts = spark.createDataFrame([(int(n),) for n in rng.integers(1, 100, 9)], "n long")
    r = T.entropy(counts).first()
    assert 0 <= r["entropy"] <= np.log2(9) and 0 <= r["normalized"] <= 1


def size_bits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_iterations_do_not_compound_size_estimates(spark):
    """A round's estimate mustn't be a product of those before: its digits would hang the planner."""
    n = 40
    path = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}", "supersedes") for k in range(n)], EDGE)
    nodes = spark.createDataFrame([(f"n{k:02d}", "", "t") for k in range(n + 1)], NODE)
    pairs = spark.createDataFrame([("n00", "n15")], "a string, b string")
    for found in (
        G.label_communities(path, rounds=10, levels=1),
        T.khop(path, spark.createDataFrame([("n00",)], "id string"), 10),
        T.components_of(nodes, path),
        R.supersession_chains(path),
    ):
        assert size_bits(found) < 200
    assert T.shortest_paths(path, pairs).first()["hops"] == 15


def test_supersession_chains_double_their_steps(spark):
    long = [(f"a{k + 1:03d}", f"a{k:03d}", "supersedes") for k in range(300)]
    rows = [*long, ("b2", "b1", "replaces"), ("c", "c0", "supersedes"), ("c", "c1", "supersedes"), (None, "x", "supersedes")]
    found = {r["head"]: (r["length"], r["chain"]) for r in R.supersession_chains(spark.createDataFrame(rows, EDGE)).collect()}
    assert found["a300"] == (301, ">".join(f"a{k:03d}" for k in range(301)))
    assert found["b2"] == (2, "b1>b2") and found["c"] == (2, "c0>c") and len(found) == 3
    assert R.supersession_chains(spark.createDataFrame([], EDGE)).collect() == []
    with pytest.raises(ValueError):
        R.supersession_chains(spark.createDataFrame([("h", "p", "supersedes"), ("p", "q", "supersedes"), ("q", "p", "supersedes")], EDGE)).collect()

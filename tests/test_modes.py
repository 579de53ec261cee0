"""Substring joins, and a store's four modes over a small graph with known answers."""

import random

import pytest

from lattis.operators import modes as M
from lattis.operators.substrings import containing

NODE = "id string, entity_type string, name string, description string, text string"
EDGE = "source_id string, target_id string, edge_type string"


@pytest.mark.parametrize("fold", [True, False])
def test_containing_equals_all_pairs(spark, fold):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abAé \n%.") for _ in range(n))
    bodies = [(i, word(rng.randrange(0, 30))) for i in range(60)] + [(70, None), (71, "zzz"), (71, "b" * 9)]
    terms = {word(rng.randrange(0, 6)) for _ in range(60)} | {"zz", "abc", "."}
    got = {tuple(r) for r in containing(spark.createDataFrame([(t,) for t in [*terms, None, *terms]], "term string"), spark.createDataFrame(bodies, "id int, body string"), fold).collect()}
    low = str.lower if fold else str
    assert got == {(t, i) for t in terms if t for i, b in bodies if b is not None and low(t) in low(b)}


def test_containing_nothing(spark):
    none = spark.createDataFrame([], "term string")
    bodies = spark.createDataFrame([(1, "a")], "id int, body string")
    assert containing(none, bodies).collect() == []
    assert containing(spark.createDataFrame([("a",)], "term string"), bodies.where("id > 1")).collect() == []


@pytest.fixture(scope="module")
def store(spark):
    nodes = [
        ("n1", "note", "Docker setup", "containers", "how to install"),
        ("n2", "note", "Kubernetes notes", "clusters of docker", None),
        ("n3", "tool", "docker", None, "the Kubernetes runtime"),
        ("n4", "tool", "Helm", "charts", None),
        ("n5", "person", "Alice", None, None),
        ("n6", "person", None, "docker", None),
    ]
    edges = [("n1", "n4", "uses"), ("n1", "n3", "uses"), ("n3", "n2", "runs"), ("n2", "n5", "by"), ("n4", "n5", "by"), ("n1", "n2", "links"), ("n5", "n5", "loop"), ("n5", "gone", "by")]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, text string")


def rows(df):
    return [tuple(r) for r in df.orderBy("qid", "rank").collect()]


def test_semantic(spark, store):
    got = rows(M.semantic(ask(spark, "DOCKER kubernetes", "is it", "of", None, "xyz"), store[0], 3))
    assert got == [(0, "semantic", 1, "n3", "2"), (0, "semantic", 2, "n1", "1"), (0, "semantic", 3, "n2", "1"), (2, "semantic", 1, "n2", "0")]


def test_hybrid_and_its_fallback(spark, store):
    got = rows(M.hybrid(ask(spark, "docker", "charts", "nobody here"), *store, 4))
    assert got == [(0, "hybrid", 1, "n2", "links"), (0, "hybrid", 2, "n4", "uses"), (0, "hybrid", 3, "n1", None), (0, "hybrid", 4, "n3", None), (1, "semantic", 1, "n4", "0")]


def test_graph(spark, store):
    got = rows(M.graph(ask(spark, "docker", "of it", "one two three docker"), *store, 9))
    assert got == [(0, "graph", 1, "n1", "0"), (0, "graph", 2, "n3", "0"), (0, "graph", 3, "n2", "1"), (0, "graph", 4, "n4", "1"), (0, "graph", 5, "n5", "2")]
    assert [r[3] for r in rows(M.graph(ask(spark, "docker"), *store, 3))] == ["n1", "n3", "n2"]
    assert len(rows(M.graph(ask(spark, "docker"), *store, 9, depth=1))) == 4


def test_path_and_its_fallbacks(spark, store):
    asked = ask(spark, "docker kubernetes", "helm docker", "docker", "charts clusters", "docker nothing")
    got = rows(M.path(asked, *store, 2))
    assert got == [
        (0, "path", 1, "n1", "n1 --links--> n2"), (0, "path", 2, "n3", "n3 --runs--> n2"),
        (1, "hybrid", 1, "n5", "by"), (1, "hybrid", 2, "n2", "links"),
        (2, "semantic", 1, "n1", "1"), (2, "semantic", 2, "n3", "1"),
        (3, "semantic", 1, "n2", "0"), (3, "semantic", 2, "n4", "0"),
        (4, "hybrid", 1, "n2", "links"), (4, "hybrid", 2, "n4", "uses"),
    ]
    longer = rows(M.path(asked.where("qid = 1"), *store, 2, longest=3))
    assert longer == [(1, "path", 1, "n4", "n4 -- n1")]


def test_no_questions_and_no_nodes(spark, store):
    none = ask(spark).where("qid < 0") if False else spark.createDataFrame([], "qid int, text string")
    for found in (M.semantic(none, store[0]), M.hybrid(none, *store), M.graph(none, *store), M.path(none, *store), M.path(ask(spark, "docker kubernetes"), store[0].where("id = 'x'"), store[1])):
        assert found.collect() == []

"""Set joins and needles against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lattis.operators import needles as N
from lattis.operators import retrieval as R
from lattis.operators.similarity import SetJoin


@pytest.mark.parametrize("seed,least", [(0, 0.8), (1, 0.5), (2, 1.0), (3, 0.8)])
def test_set_join_equals_all_pairs(spark, seed, least):
    rng = random.Random(seed)
    base = [[f"t{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    rows = [(i, [t for t in rng.choice(base) if rng.random() < 0.9] + (["extra"] if rng.random() < 0.2 else [])) for i in range(200)]
    rows += [(300, None), (301, []), (302, [None, "x", "x"]), (303, ["x"]), (None, ["x"])]
    join = SetJoin(spark.createDataFrame(rows, "id int, tokens array<string>"), least)
    sets = {i: frozenset(t for t in ts or [] if t) for i, ts in rows if i is not None}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {tuple(r) for r in join.members().collect()} == {(i, first[s]) for i, s in sets.items() if s}
    reps = sorted(first[s] for s in first if s)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in reps for b in reps if a < b}
    got = {(r["a"], r["b"]): r["similarity"] for r in join.pairs().collect()}
    assert got == pytest.approx({p: s for p, s in want.items() if s >= least})
    met = {tuple(r) for r in join.candidates().collect()}
    assert set(got) <= met and len(met) < len(want)
    with pytest.raises(ValueError):
        SetJoin(spark.createDataFrame(rows, "id int, tokens array<string>"), 0)


@pytest.mark.parametrize("sequential", [False, True])
def test_needles_lie_at_their_depth(spark, sequential):
    rng = random.Random(1)
    docs = [(i, "".join(rng.choice("ab é") for _ in range(rng.choice([0, 1, 40, 300])))) for i in range(30)] + [(40, None), (41, "last")]
    needles = [(k, f"<<needle {k}>>", f"where is {k}") for k in range(25)]
    hay, told = N.insert(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(needles, "ord int, needle string, question string"), 7, sequential)
    texts, told = {r["id"]: r["text"] for r in hay.collect()}, {r["ord"]: r for r in told.collect()}
    assert len(told) == 25 and set(texts) == {i for i, _ in docs} and texts[40] is None
    whole, total = "".join(t or "" for _, t in docs), sum(len(t or "") for _, t in docs)
    spliced, at = "", 0
    for r in sorted(told.values(), key=lambda r: (int(r["depth"] * total), r["ord"])):
        p = int(r["depth"] * total)
        spliced += whole[at:p] + f" {r['needle']} "
        at = p
        assert r["needle"] in texts[r["id"]]
    assert "".join(texts[i] or "" for i, _ in docs) == spliced + whole[at:]
    order = [told[k]["depth"] for k in range(25)]
    assert (order == sorted(order) and min(order) >= 0.0 and max(order) <= 0.95) if sequential else len(set(order)) == 25


def test_what_is_found(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} and some more") for i in range(50)], "id long, text string")
    needles = spark.createDataFrame([(k, f"the code of vault{k} is {k * 7}", f"code of vault{k}") for k in range(5)] + [(5, "no such thing", "plain words")], "ord long, needle string, question string")
    hay, told = N.insert(docs, needles.where("ord < 5"), 3)
    ranked = R.idf_tokens(needles.select(F.col("ord").alias("qid"), F.col("question").alias("text")), hay, 3)
    rows = {r["ord"]: r for r in N.found_by(ranked, hay, told.unionByName(needles.where("ord = 5").select("ord", "needle", "question", F.lit(0.5).alias("depth"), F.lit(None).cast("long").alias("id")))).collect()}
    assert all(rows[k]["rank"] == 1 and rows[k]["in_answer"] and rows[k]["found"] for k in range(5))
    assert rows[5]["rank"] is None and not rows[5]["found"]


def test_an_empty_haystack(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "id int, text string")
    hay, told = N.insert(docs, spark.createDataFrame([(0, "n", "q")], "ord int, needle string, question string"))
    assert told.first()["id"] is None and hay.where("text like '%n%'").isEmpty()

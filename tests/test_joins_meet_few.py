"""Joins that meet hardly more than what they find, and that the driver doesn't carry."""

import re

from lattis.operators import intervals as I
from lattis.operators import needles as N
from lattis.operators import retrieval as R
from lattis.operators.similarity import SetJoin
from lattis.operators.tails import degree_histogram
from lattis.sources.graphs import supply


def test_long_sets_meet_on_all_they_must_share(spark):
    """Nine tokens each, three of which vary: alike are those that differ in one."""
    rows = [(16 * i + 4 * j + k, [*"abcdef", f"size{i}", f"brand{j}", f"type{k}"]) for i in range(4) for j in range(4) for k in range(4)]
    join = SetJoin(spark.createDataFrame(rows, "id int, tokens array<string>"))
    assert join.candidates().count() == join.pairs().count() == 64 * 9 // 2


def test_facts_and_points_meet_without_the_driver(spark):
    points = spark.range(3).selectExpr("id as p", "1 as k", "5L as t")
    facts = spark.range(2).selectExpr("id as f", "1 as k", "1L as valid_from", "9L as valid_to")
    met = I.valid_at(points, facts, "k")
    assert met.count() == 6 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entities_are_scored_where_the_document_is(spark):
    """Equal scores go by id, over blocks of queries and tasks; no pair of a query and a document is a row of a join."""
    docs = spark.createDataFrame([(i, f"Ada met Rosa {'in Rome' if i % 3 else ''} on 2024-03-{i % 5}" if i % 7 else None) for i in range(200)], "id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "Ada and Rosa"), (2, "Rome on 2024-03-4"), (3, "nobody"), (4, None)], "qid long, text string")
    found = R.idf_entities(asked, docs, 3)
    assert "Join" not in _plan(found)
    rows = {(r["qid"], r["rank"]): (r["id"], r["shared"]) for r in found.collect()}
    assert {k: v for k, v in rows.items() if k[0] == 1} == {(1, 1): (1, 2), (1, 2): (2, 2), (1, 3): (3, 2)}
    assert {q for q, _ in rows} == {1, 2} and rows[2, 1] == (4, 2)
    words = docs.select("id", R.entities_in(docs["text"]).alias("words"))
    w = asked.select("qid", R.F.explode(R.entities_in(asked["text"])).alias("word"), R.F.lit(1.0).alias("w"))
    once, cut = (sorted(map(tuple, R.top(R.best_by_words(words, w, 3, 6, block=b), ["qid"], [R.F.desc("total"), R.F.col("id")], 3).select("qid", "rank", "id", "hits").collect())) for b in (100, 1))
    assert once == cut and len(once) == 6


def test_shared_tokens_are_counted_where_the_document_is(spark):
    docs = spark.createDataFrame([(i, f"alpha word{i} " * 3) for i in range(50)], "id long, text string")
    asked = spark.createDataFrame([(1, "alpha word7"), (2, "Alpha")], "qid long, text string")
    found = R.token_overlap(asked, docs, 2, docs_a_task=10)
    text = _plan(found)
    assert "SortMergeJoin" not in text and not re.search(r"hashpartitioning\((qid#\d+L?, id|id#\d+L?, n#)", text)
    assert [tuple(r) for r in found.orderBy("qid", "rank").select("qid", "id").collect()] == [(1, 7), (1, 0), (2, 0), (2, 1)]


def test_ranked_rows_go_to_the_texts(spark):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "id long, text string")
    ranked = spark.createDataFrame([(1, 1, 4), (1, 2, 2)], "qid long, rank int, id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = R.render_context(ranked, texts)
        assert "SortMergeJoin" not in _plan(found) and found.first()["context"] == "[1] 4\ntext 4\n\n[2] 2\ntext 2"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_that_drop_repeats_grow_in_number_not_in_size(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey")
    edges = supply(spark, sf_dir, rows_a_task=100).edges
    assert re.search(rf"hashpartitioning\(l_partkey#\d+L, l_suppkey#\d+L, {1 + lines.count() // 100}\)", _plan(edges))
    assert edges.count() == lines.distinct().count()
    ring = spark.range(300).selectExpr("cast(id % 150 as string) as source_id", "cast((id + 1) % 150 as string) as target_id")
    found = degree_histogram(ring, rows_a_task=10)
    assert "v#" in (text := _plan(found)) and ", 61)" in text
    assert [tuple(r) for r in found.collect()] == [(2, 150)]


def test_needles_go_to_the_texts(spark):
    docs = spark.createDataFrame([(i, "some words of hay") for i in range(9)], "id long, text string")
    needles = spark.createDataFrame([(1, "pin", "where")], "ord long, needle string, question string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hay, told = N.insert(docs, needles)
        assert "SortMergeJoin" not in _plan(hay) and hay.where("text like '% pin %'").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

"""Sources, sinks, text functions and streams on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from lattis.operators import retrieval as R
from lattis.sources import sinks as K
from lattis.sources import stores as P
from lattis.streaming import events as E


def test_projection_by_row_and_by_table(spark):
    rows = spark.createDataFrame([(1, "", "T1", [1.0]), (2, "n2", None, None), (3, None, None, None)], "id int, name string, title string, embedding array<double>")
    names = lambda **how: [r["name"] for r in P.project_nodes(rows, "t", **how).orderBy("id").collect()]
    assert names() == ["1", "n2", "3"] and names(row_wise=True) == ["T1", "n2", "3"]
    assert P.project_nodes(rows.drop("id"), "t") is None


def test_tables_and_registry(spark):
    sizes = {"a": 0, "b": 3, "cache": 9}
    assert P.select_tables(sizes) == ["a", "b"] and P.select_tables(sizes, edges=True) == ["b"]
    assert P.load("flat", spark).entities.collect() == []
    with pytest.raises(KeyError):
        P.load("nothing", spark)
    with pytest.raises(TypeError):
        P.load("flat", spark, colour="red")
    assert P.load("tables", spark, sf_dir="/root/testdata/sf0.001", graph=None).edges.count() > 0


def test_scaffold_without_drawers(spark):
    chunks = spark.createDataFrame([(1, "w1", "r", "hall_b", "f", 1), (2, "w2", "r", "hall_a", "f", 2), (3, "w1", "general", "", None, 3)], "chunk_id long, wing string, room string, hall string, file string, seq long")
    g = P.scaffold(chunks, most_drawers=1)
    assert {(r["id"], r["entity_type"]) for r in g.entities.collect()} == {("wing:w1", "wing"), ("wing:w2", "wing"), ("room:r", "room:hall_a")}
    assert {(r["source_id"], r["target_id"]) for r in P.scaffold(chunks).edges.where("edge_type = 'same_file'").collect()} == {("drawer:1", "drawer:2")}


def test_vault_and_bodies(spark):
    text = lambda *items: "---\n" + "\n".join(items) + "\n---\nBody --- here.\n"
    notes = spark.createDataFrame(
        [("b.md", text("entities:", "  - {id: x, type: late, canonical: Late}", "edges:", "  - {from: x, type: made, to: y}", "  - {from: x, to: y}")), ("a.md", text("entities:", "  - {id: x, type: tool, canonical: 'First One'}")), ("c.md", "no front matter")],
        "path string, text string",
    )
    g = P.vault(notes)
    assert [(r["id"], r["name"], r["entity_type"]) for r in g.entities.collect()] == [("x", "First One", "tool")]
    assert [(r["source_id"], r["edge_type"], r["target_id"]) for r in g.edges.collect()] == [("x", "made", "y")]
    assert {r["path"]: r["body"] for r in P.source_bodies(notes).collect()} == {"a.md": "Body --- here.\n", "b.md": "Body --- here.\n", "c.md": "no front matter"}


def test_dag(spark):
    rows = spark.createDataFrame([("1", "one", "", "T"), ("2", "two", "1|9", "T"), ("2", "zwei", "1", "T")], "ConceptID string, ConceptLabel string, Dependencies string, TaxonomyID string")
    g, problems = P.dag(rows)
    assert [(r["source_id"], r["target_id"]) for r in g.edges.collect()] == [("2", "1")]
    assert sorted((r["problem"], r["id"]) for r in problems.collect()) == [("duplicate", "2"), ("phantom", "9")]


def test_corpora(spark):
    raw = spark.createDataFrame([("q_abs", "multi-session", ["s1", "s2"], ["d1", "d2"], [["t1"], ["t2", "t3"]])], "question_id string, question_type string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<string>>")
    rows = P.haystack_questions(raw).orderBy("i").collect()
    assert [(r["category"], r["abstention"], r["session_id"], r["turns"]) for r in rows] == [("2", True, "s1", ["t1"]), ("2", True, "s2", ["t2", "t3"])]
    with pytest.raises(Exception, match="differ in length"):
        P.haystack_questions(raw.withColumn("haystack_dates", F.array(F.lit("d")))).collect()
    pages = spark.createDataFrame([("1", [["T", "0"], ["bad"]], [("T", ["a", "b"]), ("U", ["c"])])], "_id string, supporting_facts array<array<string>>, context array<struct<title:string,sentences:array<string>>>")
    assert [(r["title"], r["text"], r["gold"]) for r in P.paragraph_questions(pages).collect()] == [("T", "ab", True), ("U", "c", False)]
    refs = spark.createDataFrame([(["D2:1", "D1:3", "D2:9", "x"],)], "r array<string>").select(P.evidence_sessions(F.col("r")).alias("s")).first()["s"]
    assert refs == [2, 1]


def test_jsonl_reports_and_sessions(spark, tmp_path):
    (tmp_path / "runs.jsonl").write_text('{"q": 1, "rr": 0.5}\n\n{"q": 2}\n')
    assert [(r["q"], r["rr"]) for r in P.jsonl(spark, str(tmp_path / "runs.jsonl"), "q long, rr double").orderBy("q").collect()] == [(1, 0.5), (2, None)]
    report = spark.createDataFrame([(3, None)], "n int, x string")
    assert K.scorecard(report, "T").splitlines()[2].split() == ["n", "3"] and '"n": 3' in K.report_json(report)
    K.write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["n"] == 3
    turns = spark.createDataFrame([("q", "s", 1, "assistant", "b"), ("q", "s", 0, "user", "a")], "question_id string, session_id string, turn_idx int, role string, content string")
    K.write_sessions(turns, str(tmp_path / "vault"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "vault")).collect()] == ["**user**: a", "**assistant**: b"]
    K.write_sessions(turns, str(tmp_path / "user"), user_only=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "user")).collect()] == ["a"]
    K.pinned_context(report, str(tmp_path / "pinned"))
    assert spark.read.parquet(str(tmp_path / "pinned")).count() == 1


def test_compile_and_cache(spark):
    notes = spark.createDataFrame([("a", "First para.\n\nSecond."), ("b", "x")], "path string, body string")
    once = K.changed_notes(notes, spark.createDataFrame([], "path string, digest string"))
    assert once.count() == 2 and K.changed_notes(notes, once.select("path", "digest")).count() == 0
    assert {r["path"]: r["summary"] for r in K.compile_index(notes).collect()}["a"] == "First para."
    keys = notes.select(K.cache_key(F.lit("r"), "body", F.lit("m"), F.lit("p"), F.lit("1")).alias("k")).distinct()
    assert keys.count() == 2


@pytest.mark.parametrize(("text", "by"), [('token = "abc123" x', "token = [SECRET] x"), ("at 10.0.0.1 now", "at [IP] now"), ("mail a.b@c.example.org.", "mail [EMAIL]."), ("aa:bb:cc:dd:ee:ff", "[MAC]"), ("d" * 40, "[BLOB]"), ("plain", "plain")])
def test_redact(spark, text, by):
    assert spark.createDataFrame([(text,)], "t string").select(R.redact(F.col("t"))).first()[0] == by


def test_chunks_and_review(spark):
    d = spark.createDataFrame([("short\n\nalso short\n \n" + "x" * 130 + "\n\nlast",), (None,)], "t string")
    assert [r[0] for r in d.select(R.chunk_paragraphs(F.col("t"))).collect()] == [["short\n\nalso short", "x" * 130 + "\n\nlast"], []]
    notes = spark.createDataFrame([("n", 'It cost 12.5 euros, he said "far too much money".')], "path string, body string")
    assert {(r["kind"], r["i"]) for r in K.review_surface(notes).collect()} == {("number", 0), ("quote", 0)}


def test_numbers_are_found_as_by_trying_each_place(spark):
    """Numbers far apart, at every distance about 60, inside words, by signs of any script, at the start and the end."""
    rng = random.Random(1)
    odd = ["7", "1,234.5", "a1", "x_9", "\u00e92", "\U0001f600", "\u0663", "\n", "3.", ".4", '"', " "]
    texts = ["", "x", "5", "b5", "5" * 200, "b" + "5" * 200 + " 6", " " * 500, *(" " * k + "1" + "y" * m for k in (59, 60, 61, 62, 119, 120, 121, 181) for m in (0, 60, 61))]
    for _ in range(400):
        texts.append("".join(rng.choice(odd) if rng.random() < p else rng.choice("ab \u00e9") for p in (0.02, 0.2) for _ in range(rng.randrange(300))))
    notes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "path int, body string")
    plain = notes.select("path", F.posexplode(F.slice(F.regexp_extract_all("body", F.lit(r"(?s)(.{0,60}\b\d[\d.,]*.{0,60})"), F.lit(1)), 1, 30)).alias("i", "text"))
    want = sorted(map(tuple, plain.collect()))
    assert sorted((r["path"], r["i"], r["text"]) for r in K.review_surface(notes).where("kind = 'number'").collect()) == want and len(want) > 400


def test_long_texts_are_reviewed_in_one_pass(spark):
    """Ten million characters without a number, which trying each place reads sixty times; a note is read once for both kinds."""
    notes = spark.createDataFrame([(1, 10_000_000), (2, 10_000_000)], "path int, n int").select("path", F.concat(F.lit("1 "), F.repeat(F.when(F.col("path") == 1, "word ").otherwise("w9rd "), F.col("n") / 5), F.lit(" 2")).alias("body"))
    found = K.review_surface(notes)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [len(r["text"]) for r in found.orderBy("path", "i").collect()] == [61, 61, 61, 61]


def stream(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def drain(out, name, mode):
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return out.sparkSession.table(name)


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = drain(E.tumbling(stream(spark, events, tmp_path), late="1 hour"), "tumbled", "complete")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, E.tumbling(events).collect()))


def test_stream_dedupe(spark, tmp_path):
    events = spark.sql("select id % 5 as event_id, timestamp '2024-01-01 00:00:00' as ts from range(20)")
    assert drain(E.dedupe(stream(spark, events, tmp_path)), "deduped", "append").count() == 5


@pytest.mark.parametrize(
    "text, by",
    [
        ("see http://box.lan:80/a?b now", "see [ENDPOINT] now"),
        ("disk.local:22 and lan.example.org", "[HOST] and lan.example.org"),
        ("on Vault-1 and vault-12", "on [PRIVATE] and vault-12"),
        ("to me@a.org or you@a.org or me@a.org.uk", "to me@a.org or [EMAIL] or [EMAIL]"),
    ],
)
def test_redact_private_machines_and_allowed_addresses(spark, text, by):
    found = R.redact(F.col("t"), private_hosts=("vault-1",), allowed_emails=("Me@a.org",))
    assert spark.createDataFrame([(text,), (None,)], "t string").select(found).collect() == [(by,), (None,)]


def test_pollution_needs_two_markers(spark):
    rows = ["recall= tokens=", "recall=", "expected: [ min_hops", "elapsed_ms --questions runs/corpora", "elapsed_ms --questions x", None]
    texts = spark.createDataFrame([(x,) for x in rows], "t string")
    assert [r[0] for r in texts.select(R.is_pollution(F.col("t"), "runs/corpora")).collect()] == [True, False, True, True, False, False]


def test_relevance_by_name_and_glob(spark):
    rows = [("a/b/c.md", "the rain"), ("c.md", None), (None, "the")]
    p = spark.createDataFrame(rows, "s string, t string")
    none, the = F.array().cast("array<string>"), F.array(F.lit("the"))
    assert [r[0] for r in p.select(R.relevant_by_name(F.col("s"), F.lit("c.md"))).collect()] == [True, True, False]
    assert [r[0] for r in p.select(R.relevant_by_glob(F.col("s"), F.col("t"), "c.*", none)).collect()] == [True, True, False]
    assert [r[0] for r in p.select(R.relevant_by_glob(F.col("s"), F.col("t"), "a/*", the)).collect()] == [True, False, False]
    assert [r[0] for r in p.select(R.relevant_by_glob(F.col("s"), F.col("t"), None, the)).collect()] == [True, False, True]


def test_contained_equals_every_pair(spark):
    items = [(1, "rain in the plain"), (2, "in the"), (3, "ain in the plai"), (4, "plain rain"), (5, None), (6, ""), (7, "hill\n of  wind "), (7, "a b c")]
    docs = [(1, "the rain in the plain falls"), (2, None), (3, "the hill\n of  wind blows"), (3, ""), (4, "wind of hill rain")]
    expected = {q for q, x in items for _, d in docs if x is not None and d is not None and x in d}
    found = R.contained(spark.createDataFrame(items, "qid long, text string"), spark.createDataFrame(docs, "id long, text string"))
    assert {r["qid"] for r in found.collect()} == expected


def test_cached_statistics(spark, tmp_path):
    at = str(tmp_path / "stats")
    assert P.cached_statistics(spark, at) is None
    spark.createDataFrame([(3, 0.5)], "component_count long, modularity double").write.parquet(at)
    assert P.cached_statistics(spark, at).first()["component_count"] == 3 and P.cached_statistics(spark, at, "absent") is None


def test_knowledge_graph_of_odd_tables(spark):
    entities = spark.createDataFrame([("1", None, None, '{"a": 1, "_table": "x"}', "then"), ("2", "n", "", "[1", None), ("3", "n", "t", None, None)], "id string, name string, type string, properties string, created_at string")
    g = P.knowledge_graph(entities, spark.createDataFrame([("1", "2")], "subject string, object string"))
    assert {r["id"]: (r["entity_type"], r["properties"]) for r in g.entities.collect()} == {
        "kg:1": ("kg:unknown", {"a": "1", "_table": "kg_entity", "_created_at": "then"}),
        "kg:2": ("kg:unknown", {"_table": "kg_entity", "_created_at": None}),
        "kg:3": ("kg:t", {"_table": "kg_entity", "_created_at": None}),
    }
    assert [(r["source_id"], r["target_id"], r["edge_type"]) for r in g.edges.collect()] == [("kg:1", "kg:2", "kg_related")]

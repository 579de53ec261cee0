"""The command line, irregular corpora, injected models and calibration."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattis import cli
from lattis.functions import models as M
from lattis.operators import stats as T
from lattis.schema import Graph, empty_graph
from lattis.sources import corpora as C


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("graph")
    spark.createDataFrame([("a", "A", "t"), ("b", "a ", "t"), ("c", "C", "u"), ("d", "D", "u")], "id string, name string, entity_type string").write.parquet(str(at / "entities"))
    spark.createDataFrame([("a", "c", "supersedes"), ("b", "c", "contradicts")], "source_id string, target_id string, edge_type string").write.parquet(str(at / "edges"))
    spark.createDataFrame([("A", 1, 0.5), ("B", 1, 0.9), ("C", 1, 0.5)], "condition string, min_hops int, recall double").write.parquet(str(at / "runs"))
    spark.createDataFrame([("x", True), ("x", False)], "kind string, success boolean").write.parquet(str(at / "probes"))
    spark.createDataFrame([("q", "one two"), ("r", "three")], "qid string, context string").write.parquet(str(at / "contexts"))
    spark.createDataFrame([("q", ["two", "four"]), ("r", ["three"])], "qid string, expected array<string>").write.parquet(str(at / "questions"))
    spark.createDataFrame([("s", 1, 1, False), ("s", 1, 2, True)], "strategy string, qid int, rank int, relevant boolean").write.parquet(str(at / "hits"))
    spark.createDataFrame([("p", "body")], "path string, body string").write.parquet(str(at / "notes"))
    spark.createDataFrame([("c", 1.0, "CORRECT"), ("c", 0.0, "INCORRECT")], "category string, recall double, label string").write.parquet(str(at / "judged"))
    return at


COMMANDS = [
    ("analyze", "", None, "components", 2),
    ("check", "", None, "collisions", 1),
    ("cat3", "", None, "detection", 1.0),
    ("cat4", "", None, "types", 2),
    ("cat5", "", None, "bridges", 2),
    ("cat6", "", None, "seeded", 1),
    ("cat8", "", None, "coverage", 1.0),
    ("cat9", "probes", None, "rate", 0.5),
    ("cat2c", "runs", None, "verdict", "structure helps"),
    ("retrieve", "contexts", "questions", "mean_recall", 0.75),
    ("candidate-strategy", "hits", None, "mrr", 0.5),
    ("compile-wiki", "notes", None, "changed", 1),
    ("longmem", "judged", None, "accuracy", 0.5),
]


def test_every_command_is_tested():
    assert {c[0] for c in COMMANDS} == set(cli.COMMANDS)


@pytest.mark.parametrize(("name", "table", "other", "key", "value"), COMMANDS)
def test_command(spark, folder, tmp_path, capsys, name, table, other, key, value):
    args = [name, str(folder / table), "--json", str(tmp_path / "out.json")]
    if other:
        args += ["--other", str(folder / other)]
    assert cli.main(args, spark) == 0
    assert json.loads((tmp_path / "out.json").read_text())[key] == value
    assert name in capsys.readouterr().out


def test_dialogues(spark):
    conversation = {"speaker_a": "x", "session_10": [{"speaker": "x", "dia_id": "D10:1", "text": "ten"}], "session_2": [{"speaker": "y", "dia_id": "D2:1", "text": "two"}], "session_2_date_time": "May"}
    flat = {k: v if isinstance(v, str) else json.dumps(v) for k, v in conversation.items()}
    qa = [{"question": "a", "answer": "b", "category": 1, "evidence": ["D2:1", "D10:1", "D2:3"]}, {"question": "c", "adversarial_answer": "no", "category": 5}, {"question": "i", "category": 1, "image": "x.png"}]
    raw = spark.createDataFrame([("s", json.dumps(flat), json.dumps(qa))], "sample_id string, conversation string, qa string")
    found = C.dialogue_sessions(raw).orderBy("session").collect()
    assert [(r["session"], r["date"], r["turns"][0]["text"]) for r in found] == [(2, "May", "two"), (10, None, "ten")]
    asked = C.dialogue_questions(raw).orderBy("i").collect()
    assert [(r["answer"], r["adversarial"], r["sessions"]) for r in asked] == [("b", False, [2, 10]), ("no", True, [])]
    assert C.dialogue_questions(raw, skip_images=False).count() == 3


def test_probing_questions(spark):
    literal = str({"recall": [{"question": "q?", "answer": 4, "source_chat_ids": {"x": [1, 5]}}], "order": [{"question": "o?"}]})
    raw = spark.createDataFrame([("c", literal), ("j", '{"recall": [{"question": "j", "answer": null}]}'), ("bad", "{nope"), ("null", None)], "conversation_id string, probing_questions string")
    found = {(r["conversation_id"], r["category"]): r for r in C.probing_questions(raw).collect()}
    assert set(found) == {("c", "recall"), ("c", "order"), ("j", "recall")}
    assert (found["c", "recall"]["answer"], found["c", "recall"]["source_ids"]) == ("4", [1, 5])
    sessions = spark.createDataFrame([("c", 1, [0, 1]), ("c", 2, [2, 5]), ("c", 3, [9])], "conversation_id string, session int, turn_ids array<long>")
    (r,) = C.sessions_of_sources(C.probing_questions(raw), sessions).collect()
    assert r["sessions"] == [1, 2]


def test_listed_graph(spark):
    g = empty_graph(spark)
    other = Graph(spark.createDataFrame([("w", "w", "wing")], "id string, name string, entity_type string"), g.edges)
    assert C.listed_graph(g.entities, g.edges, other) is other
    edges = spark.createDataFrame([("kg:a", "kg:b", "knows"), ("kg:a", "kg:b", "knows")], "source_id string, target_id string, edge_type string")
    found = C.listed_graph(g.entities, edges, other)
    assert found.edges.count() == 1 and found.entities.count() == 2


def test_models(spark):
    df = spark.createDataFrame([("Is it?",), (None,)], "p string")
    stub = M.hash_stub(["CORRECT", "ABSTAIN"])
    assert [r[0] for r in df.select(M.complete(F.col("p"), stub)).collect()] == [stub(["Is it?"])[0], None]

    def down(prompts):
        raise OSError("no service")

    assert [r[0] for r in df.select(M.complete(F.col("p"), down)).collect()] == ["ERROR: no service", None]
    scores = df.select(M.score_pairs(F.col("p"), F.lit("abc"), lambda pairs: [len(a) - len(b) for a, b in pairs]))
    assert [r[0] for r in scores.collect()] == [3.0, None]
    labels = spark.createDataFrame([("It is CORRECT.",), ("INCORRECTLY so",), (None,)], "r string").select(M.verdict_label(F.col("r"), ["CORRECT", "INCORRECT"]))
    assert [r[0] for r in labels.collect()] == ["CORRECT", "ERROR", "ERROR"]
    assert df.select(M.count_tokens(F.col("p"))).first()[0] == 1


def test_interpolation_and_cross_validation(spark):
    fit = spark.createDataFrame([(0.2, 1, 0.1), (0.6, 1, 0.5)], "x double, n long, fitted double")
    asked = spark.createDataFrame([(0.0,), (0.2,), (0.4,), (0.6,), (0.9,)], "score double")
    assert [round(r["p"], 6) for r in T.interpolate(fit, asked).orderBy("score").collect()] == [0.1, 0.1, 0.3, 0.5, 0.5]
    rng = np.random.default_rng(0)
    s = rng.random(2000)
    rows = spark.createDataFrame([(i, float(round(x, 2)), int(rng.random() < x**2)) for i, x in enumerate(s)], "id long, score double, y int")
    r = T.cross_validated_calibration(rows, "id").first()
    assert r["n"] == 2000 and r["ece"] < 0.05 < T.calibration_error(rows.withColumnRenamed("score", "p")).first()["ece"]


def test_mrr_interval(spark):
    rows = spark.createDataFrame([("f", i, 0.1 + 0.01 * (i % 5)) for i in range(50)], "family string, ord int, diff double")
    r = T.mrr_delta_interval(rows, "family").first()
    assert r["n"] == 50 and r["low"] <= r["delta"] <= r["high"]

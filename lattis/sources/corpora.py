"""Question corpora with irregular layouts, and knowledge graphs listed over RPC."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.schema import Graph
from lattis.sources.stores import evidence_sessions, synthesize_endpoints


def dialogue_sessions(raw: DataFrame) -> DataFrame:
    """``(sample_id, session, date, turns)`` of conversations with ``session_N`` keys (SRC22, SRC23).

    ``raw`` is ``(sample_id, conversation)`` with the conversation as JSON.
    Sessions come in the order of their numbers, not of their names; a
    session without a date has a null one.
    """
    entries = raw.select("sample_id", F.explode(F.from_json("conversation", "map<string,string>")).alias("key", "value"))
    number = F.regexp_extract("key", r"^session_(\d+)", 1)
    numbered = entries.where(F.col("key").rlike(r"^session_\d+(_date_time)?$")).withColumn("session", number.cast("int"))
    dated = F.col("key").endswith("_date_time")
    rows = numbered.groupBy("sample_id", "session").agg(F.max(F.when(dated, F.col("value"))).alias("date"), F.max(F.when(~dated, F.col("value"))).alias("body"))
    turn = "array<struct<speaker:string,dia_id:string,text:string>>"
    return rows.where("body is not null").select("sample_id", "session", "date", F.from_json("body", turn).alias("turns"))


def dialogue_questions(raw: DataFrame, skip_images: bool = True) -> DataFrame:
    """``(sample_id, i, question, answer, category, adversarial, sessions)`` (SRC22, SRC23).

    Category 5 asks for what isn't there: its answer is the adversarial one.
    Evidence turns become distinct sessions, in order.
    """
    kind = "array<struct<question:string,answer:string,adversarial_answer:string,category:int,evidence:array<string>,image:string>>"
    rows = raw.select("sample_id", F.posexplode(F.from_json("qa", kind)).alias("i", "q"))
    if skip_images:
        rows = rows.where("coalesce(q.image, '') = ''")
    adversarial = F.col("q.category") == 5
    answer = F.when(adversarial, F.coalesce("q.adversarial_answer", "q.answer")).otherwise(F.col("q.answer"))
    none = F.array().cast("array<string>")
    return rows.select("sample_id", "i", "q.question", answer.alias("answer"), "q.category", F.coalesce(adversarial, F.lit(False)).alias("adversarial"), evidence_sessions(F.coalesce("q.evidence", none)).alias("sessions"))


def _loose(text: str | None) -> dict:
    """A dictionary written as a Python literal or as JSON; anything else is empty."""
    for read in (ast.literal_eval, json.loads):
        try:
            found = read(text or "")
            return found if isinstance(found, dict) else {}
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    return {}


def probing_questions(raw: DataFrame) -> DataFrame:
    """``(conversation_id, category, i, question, answer, source_ids)`` of stringified dictionaries (SRC25)."""
    schema = "conversation_id string, category string, i int, question string, answer string, source_ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                for category, asked in sorted(_loose(text).items()):
                    for i, q in enumerate(asked if isinstance(asked, list) else []):
                        ids = q.get("source_chat_ids") or []
                        ids = [x for v in ids.values() for x in v] if isinstance(ids, dict) else ids
                        out.append((key, category, i, q.get("question"), str(q["answer"]) if "answer" in q else None, [int(x) for x in ids]))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()))
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["conversation_id", "category", "i", "question", "answer", "source_ids"])

    return raw.select("conversation_id", "probing_questions").mapInArrow(run, schema)


def sessions_of_sources(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Questions with the sessions ``(conversation_id, session, turn_ids)`` that hold their source turns (SRC25)."""
    asked = questions.select("conversation_id", "category", "i", F.explode("source_ids").alias("turn"))
    held = sessions.select("conversation_id", "session", F.explode("turn_ids").alias("turn"))
    return asked.join(held, ["conversation_id", "turn"]).groupBy("conversation_id", "category", "i").agg(F.sort_array(F.collect_set("session")).alias("sessions"))


def listed_graph(entities: DataFrame, relations: DataFrame, fallback: Graph) -> Graph:
    """A graph listed entity by entity: relations once, missing ends made up (SRC12).

    A store without a relation and without an entity gives the fallback.
    """
    edges = relations.dropDuplicates(["source_id", "edge_type", "target_id"])
    if entities.isEmpty() and edges.isEmpty():
        return fallback
    return Graph(synthesize_endpoints(entities, edges), edges)

"""Column layouts of the tables that operators exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

ENTITY = "id string, name string, entity_type string"
EDGE = "seq long, source_id string, target_id string, edge_type string"
ENTITY_FULL = ENTITY + ", properties map<string,string>, aliases array<string>, source_note string, embedding array<float>"
EDGE_FULL = EDGE + ", properties map<string,string>, created_by string, created_at string, superseded_by string, evidence string, source_note string, needs_grounding boolean"
QUESTION = "qid string, text string, expected_sources array<string>, min_hops int, category string"
TURN = "question_id string, session_id string, turn_idx int, role string, content string, has_answer boolean"
RUN = "condition string, qid string, min_hops int, recall double, hit boolean, tokens long"


@dataclass(frozen=True)
class Graph:
    """A snapshot: entities (``ENTITY`` and more) and edges (``EDGE`` and more)."""

    entities: DataFrame
    edges: DataFrame


def empty_graph(spark: SparkSession) -> Graph:
    """The snapshot of a store that holds no graph."""
    return Graph(spark.createDataFrame([], ENTITY), spark.createDataFrame([], EDGE))

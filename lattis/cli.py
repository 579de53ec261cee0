"""Command line: reports over graphs and runs kept as Parquet.

A graph is a folder with ``entities`` and ``edges``; a run is a Parquet
table. Every command prints a scorecard, and writes it as JSON if asked to.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.operators import gaps, integrity, ontology, ranks, relations, stats, topology
from lattis.schema import Graph
from lattis.sources import sinks

Command = Callable[[SparkSession, argparse.Namespace], DataFrame]
COMMANDS: dict[str, tuple[str, Command]] = {}


def command(name: str, text: str) -> Callable[[Command], Command]:
    def add(f: Command) -> Command:
        COMMANDS[name] = (text, f)
        return f

    return add


def graph_at(spark: SparkSession, folder: str) -> Graph:
    edges = spark.read.parquet(f"{folder}/edges")
    if "seq" not in edges.columns:
        edges = edges.withColumn("seq", F.monotonically_increasing_id())
    return Graph(spark.read.parquet(f"{folder}/entities"), edges)


@command("analyze", "structural health")
def analyze(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    g = graph_at(spark, a.input)
    return topology.structural_health(g.entities, g.edges)


@command("check", "health and integrity in one row")
def check(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    g = graph_at(spark, a.input)
    fields = integrity.required_fields(g.entities).select("gaps", "coverage")
    return topology.structural_health(g.entities, g.edges).crossJoin(integrity.collisions(g.entities)).crossJoin(fields)


@command("cat3", "contradictions: seeded edges against surfaced pairs (--other, a table of a and b)")
def cat3(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    typed = graph_at(spark, a.input).edges.where(relations.is_contradicts(F.col("edge_type"))).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return relations.contradiction_report(typed, spark.read.parquet(a.other) if a.other else typed)


@command("cat4", "ingestion integrity")
def cat4(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    g = graph_at(spark, a.input)
    return integrity.collisions(g.entities).crossJoin(integrity.required_fields(g.entities)).crossJoin(integrity.monoculture(g.edges).select("types", "entropy", "normalized", "dominant", "dominant_share"))


@command("cat5", "gaps: components, bridges, candidates")
def cat5(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    g = graph_at(spark, a.input)
    placed = g.entities.join(topology.components_of(g.entities, g.edges), "id")
    found = gaps.candidate_gaps(placed).agg(F.count("*").alias("candidates"), F.max("score").alias("best_score"))
    cut = gaps.bridges(g.entities, topology.valid_edges(g.edges, g.entities)).agg(F.count("*").alias("bridges"))
    return placed.agg(F.count_distinct("component").alias("components")).crossJoin(found).crossJoin(cut)


@command("cat6", "supersession")
def cat6(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return relations.supersession_report(graph_at(spark, a.input).edges)


@command("cat8", "ontology coherence against declared types (--other, a table of entity_type)")
def cat8(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    nodes = graph_at(spark, a.input).entities
    return ontology.type_coverage(nodes, spark.read.parquet(a.other) if a.other else nodes.select("entity_type"))


@command("cat9", "call-through of a probe log (kind, success)")
def cat9(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.read.parquet(a.input).agg(F.count("*").alias("probes"), F.count_if("success").alias("passed"), ranks.share(F.count_if("success"), F.count("*")).alias("rate"))


@command("cat2c", "multi-hop verdict over runs (condition, min_hops, recall)")
def cat2c(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return ranks.verdict(ranks.condition_deltas(spark.read.parquet(a.input)))


@command("retrieve", "recall of retrieved contexts (qid, context) against questions (--other: qid, expected)")
def retrieve(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from lattis.operators.retrieval import contains_recall

    rows = contains_recall(spark.read.parquet(a.other), spark.read.parquet(a.input))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))


@command("candidate-strategy", "rank metrics of the best strategy over hits (strategy, qid, rank, relevant)")
def candidate_strategy(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return ranks.rank_metrics(ranks.first_hits(spark.read.parquet(a.input))).orderBy(F.desc("mrr"), "strategy").limit(1)


@command("compile-wiki", "notes (path, body) that changed since a manifest (--other)")
def compile_wiki(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    notes = spark.read.parquet(a.input)
    known = spark.read.parquet(a.other) if a.other else spark.createDataFrame([], "path string, digest string")
    return sinks.changed_notes(notes, known).agg(F.count("*").alias("changed"))


@command("longmem", "recall and judged accuracy over records (category, recall, label)")
def longmem(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return stats.dual_metric(spark.read.parquet(a.input)).where("category is null").drop("category")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lattis", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (text, _) in COMMANDS.items():
        p = sub.add_parser(name, help=text)
        p.add_argument("input")
        p.add_argument("--other")
        p.add_argument("--json")
    a = parser.parse_args(argv)
    if spark is None:
        from lattis.session import build_session

        spark = build_session("lattis")
    report = COMMANDS[a.command][1](spark, a)
    print(sinks.scorecard(report, a.command))
    if a.json:
        Path(a.json).write_text(sinks.report_json(report))
    return 0


if __name__ == "__main__":
    sys.exit(main())

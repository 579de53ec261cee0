"""Ingestion integrity: canonical keys, collisions, required fields, edge vocabularies, bands."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattis.operators.topology import entropy, raw_degree

#: Spellings of the two typed relations.
SUPERSEDES = ("supersedes", "superseded_by", "supersede", "replaces", "replaced_by")
CONTRADICTS = ("contradicts", "contradicted_by", "contradict", "conflicts_with")


def normalize_predicate(edge_type: Column) -> Column:
    """Null as empty, trimmed, lower-cased, hyphens and spaces as underscores (FLT1)."""
    return F.translate(F.lower(F.trim(F.coalesce(edge_type, F.lit("")))), "- ", "__")


def canonical_key(name: Column, entity_type: Column) -> Column:
    """``type::name`` with white space collapsed and case folded; '' for a blank name (CAT4a)."""
    folded = F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")))
    return F.when(folded == "", F.lit("")).otherwise(F.concat(F.coalesce(entity_type, F.lit("")), F.lit("::"), folded))


def collision_groups(nodes: DataFrame, key: Callable[[Column, Column], Column] = canonical_key) -> DataFrame:
    """``(key, ids)`` of keys that more than one id has, with the number of ids (CAT4a).

    Counts only: the members of a group stay in their rows, however many.
    """
    keyed = nodes.select("id", key(F.col("name"), F.col("entity_type")).alias("key")).where("key <> ''")
    return keyed.groupBy("key").agg(F.count("*").alias("ids"), F.min("id").alias("first_id")).where("ids > 1")


def collisions(nodes: DataFrame, key: Callable[[Column, Column], Column] = canonical_key) -> DataFrame:
    """One row: nodes, unique keys, colliding groups, collisions (ids beyond the first of a group)."""
    keyed = nodes.select(key(F.col("name"), F.col("entity_type")).alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("n"))
    return keyed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("keyed"),
        F.count("*").alias("unique_keys"),
        F.count_if(F.col("n") > 1).alias("groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collisions"),
    )


def keepers(nodes: DataFrame, edges: DataFrame, largest_id: bool = False, key: Callable[[Column, Column], Column] = canonical_key) -> DataFrame:
    """``(key, keeper, ids)``: of each colliding group the id of most edges (CAT4d).

    Ties keep the smallest id, or with ``largest_id`` the largest.
    """
    degree = raw_degree(edges)
    keyed = nodes.select("id", key(F.col("name"), F.col("entity_type")).alias("key")).where("key <> ''").join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    pick = F.max_by("id", F.struct("degree", "id"))
    if not largest_id:
        top = F.max("degree").over(Window.partitionBy("key"))
        keyed = keyed.withColumn("top", top)
        pick = F.min(F.when(F.col("degree") == F.col("top"), F.col("id")))
    return keyed.groupBy("key").agg(pick.alias("keeper"), F.count("*").alias("ids")).where("ids > 1")


def required_fields(nodes: DataFrame, fields: Sequence[str] = ("name", "entity_type")) -> DataFrame:
    """One row: nodes, gaps (a field null or empty), coverage; 1.0 of no nodes (CAT4b)."""
    gap = F.lit(False)
    for f in fields:
        gap = gap | (F.coalesce(F.col(f), F.lit("")) == "")
    gaps = F.count_if(gap)
    return nodes.agg(F.count("*").alias("nodes"), gaps.alias("gaps"), F.round(F.coalesce(F.try_divide((F.count("*") - gaps).cast("double"), F.count("*")), F.lit(1.0)), 6).alias("coverage"))


def edge_type_distribution(edges: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """``(edge_type, n)``; null and empty types are left out; exact counts may be given instead (SRC13)."""
    if override is not None:
        return override.select("edge_type", F.col("n").cast("long").alias("n"))
    return edges.where("edge_type is not null and edge_type <> ''").groupBy("edge_type").agg(F.count("*").alias("n"))


def monoculture(edges: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """One row: the types' entropy and the dominant type and share (CAT4c); ties: the first type."""
    counts = edge_type_distribution(edges, override)
    top = counts.agg(F.min_by("edge_type", F.struct(-F.col("n"), "edge_type")).alias("dominant"), F.max("n").alias("top"))
    return entropy(counts).crossJoin(top).select("types", "total", F.round("entropy", 6).alias("entropy"), F.round("normalized", 6).alias("normalized"), "dominant", F.round(F.coalesce(F.try_divide(F.col("top").cast("double"), F.col("total")), F.lit(0.0)), 6).alias("dominant_share"))


def band(value: Column, healthy: float, warn: float, lower_is_better: bool = True) -> Column:
    """healthy, warning or concerning (CAT4e); null for no value."""
    if lower_is_better:
        return F.when(value.isNull(), None).when(value <= healthy, "healthy").when(value <= warn, "warning").otherwise("concerning")
    return F.when(value.isNull(), None).when(value >= healthy, "healthy").when(value >= warn, "warning").otherwise("concerning")


#: What to do about a metric that isn't healthy.
ADVICE = {
    "canonical_collisions": "merge entities that share a canonical key",
    "required_fields": "fill missing names and types at ingestion",
    "edge_monoculture": "use more specific edge types",
    "isolates": "link isolated entities or drop them",
    "fragmentation": "add edges between components that share types",
    "phantom_edges": "re-extract edges whose ends their source doesn't name",
}


def remediations(metrics: DataFrame) -> DataFrame:
    """``(metric, band, advice)`` for each metric that isn't healthy (GAP3)."""
    advice = F.create_map(*(F.lit(x) for kv in ADVICE.items() for x in kv))
    return metrics.where("band is not null and band <> 'healthy'").select("metric", "band", F.coalesce(advice[F.col("metric")], F.lit("review")).alias("advice"))


def bcubed(items: DataFrame) -> DataFrame:
    """B-Cubed precision, recall and F1 of ``(item, predicted, truth)`` (BC1).

    Means over items, from the counts of each (predicted, truth) cell; items
    must not repeat. No items give zeros.
    """
    cells = items.groupBy("predicted", "truth").agg(F.count("*").alias("n"))
    p = cells.withColumn("size", F.sum("n").over(Window.partitionBy("predicted"))).agg(F.sum(F.col("n") * F.col("n") / F.col("size")).alias("p"), F.sum("n").alias("items"))
    r = cells.withColumn("size", F.sum("n").over(Window.partitionBy("truth"))).agg(F.sum(F.col("n") * F.col("n") / F.col("size")).alias("r"))
    both = p.crossJoin(r).select(F.coalesce("items", F.lit(0)).alias("items"), F.coalesce(F.col("p") / F.col("items"), F.lit(0.0)).alias("precision"), F.coalesce(F.col("r") / F.col("items"), F.lit(0.0)).alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return both.select("items", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def alias_resolution(nodes: DataFrame, gold: DataFrame) -> DataFrame:
    """B-Cubed of collision groups against gold ``(id, truth)`` over the ids in both (CAT4f).

    A node whose key collides with no other's is a cluster of its own; gold
    clusters of one id are left out.
    """
    own = gold.withColumn("size", F.count("*").over(Window.partitionBy("truth"))).where("size >= 2").select("id", "truth")
    key = canonical_key(F.col("name"), F.col("entity_type"))
    shared = nodes.select("id", key.alias("key")).join(own, "id")
    return bcubed(shared.select(F.col("id").alias("item"), F.when(F.col("key") == "", F.col("id")).otherwise(F.col("key")).alias("predicted"), "truth"))

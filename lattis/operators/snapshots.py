"""Comparing and validating graph snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(source_id, target_id, change, before, after)`` of edges added, removed or retyped (STR7).

    A pair has one type in a snapshot; of several the smallest counts.
    """
    one = lambda df, name: df.groupBy("source_id", "target_id").agg(F.min("edge_type").alias(name))
    both = one(before, "before").join(one(after, "after"), ["source_id", "target_id"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("retyped")
    return both.select("source_id", "target_id", change.alias("change"), "before", "after")


def validate(nodes: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """``(violation, id, detail)``: unregistered types, missing ends, orphans, blank fields (FLT11)."""
    row = lambda df, what, key, detail: df.select(F.lit(what).alias("violation"), F.col(key).alias("id"), F.col(detail).alias("detail"))
    ids = nodes.select("id").distinct()
    unregistered = nodes.where("coalesce(entity_type, '') <> ''").join(types, "entity_type", "left_anti")
    blank = nodes.where("coalesce(name, '') = '' or coalesce(entity_type, '') = ''")
    missing = edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti").unionByName(edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti"))
    named = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    orphan = nodes.join(named, "id", "left_anti")
    return row(unregistered, "unregistered_type", "id", "entity_type").union(row(missing, "missing_endpoint", "source_id", "target_id")).union(row(orphan, "orphan", "id", "entity_type")).union(row(blank, "blank_field", "id", "entity_type"))


def inconsistent(rows: DataFrame, key: str, field: str) -> DataFrame:
    """``(id, variants)`` of keys with more than one value of a field (FLT12)."""
    return rows.groupBy(F.col(key).alias("id")).agg(F.count_distinct(field).alias("variants")).where("variants > 1")

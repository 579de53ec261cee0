"""A total order over a table that doesn't fit one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattis.session import cut_lineage


def global_index(df: DataFrame, order: Sequence[str | Column], name: str = "i") -> DataFrame:
    """``df`` with each row's place, from 1, in ``order``.

    Rows are dealt by range and sorted within their task; only the tasks'
    counts meet in one window. Ties are numbered in no particular order,
    but every number occurs once.
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    counts = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("_task", before.alias("_before"))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_task", task).join(F.broadcast(first), "_task").withColumn(name, F.col("_before") + local + 1).drop("_task", "_before", "_at")


def running(df: DataFrame, order: Sequence[str | Column], value: str | Column, over: Callable[[Column], Column], name: str) -> DataFrame:
    """``df`` with ``over`` (F.sum, F.min or F.max) of ``value`` over all rows up to each, itself included, in ``order``.

    Rows are dealt by range; a window runs within each range, and only one
    row a range meets in another one. ``order`` must tell all rows apart.
    """
    placed = cut_lineage(df.withColumn("_value", F.col(value) if isinstance(value, str) else value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = placed.withColumn("_task", F.shiftright("_at", 33))
    both = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}[over.__name__]
    totals = ranged.groupBy("_task").agg(over(F.col("_value")).alias("_total"))
    before = totals.select("_task", over(F.col("_total")).over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = ranged.withColumn("_own", over(F.col("_value")).over(Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    met = both(F.col("_own"), F.col("_before"))
    joined = own.join(F.broadcast(before), "_task")  # a row a range
    return joined.withColumn(name, F.coalesce(met, "_own", "_before")).drop("_task", "_before", "_own", "_at", "_value")


def summed_in_order(df: DataFrame, by: str, value: str, order: str, name: str) -> DataFrame:
    """``(by, name)``: each group's sum of ``value``, added up from the first row to the last in ``order``.

    A sum of doubles depends on the order of its terms, and partial sums meet
    in any; this one is the same in every run. A window adds row by row, so
    no group is held.
    """
    so_far = F.sum(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.select(by, order, so_far.alias("_sum")).groupBy(by).agg(F.max_by("_sum", order).alias(name))

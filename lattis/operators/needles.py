"""Needles put into a haystack at seeded depths, and what retrieval finds of them (RET29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattis.operators.intervals import last_before
from lattis.operators.ordering import running
from lattis.operators.retrieval import NEAR
from lattis.session import materialize


def seeded_share(*parts: Column | str) -> Column:
    """A number from 0 to below 1 that the parts decide."""
    key = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def depths(needles: DataFrame, seed: int = 42, sequential: bool = False) -> DataFrame:
    """``needles`` with ``depth``, the share of the haystack that lies before each.

    Literal needles lie anywhere. Sequential ones lie in the order of
    ``ord``, evenly but for up to 15 % of a step either way, from 0.05 to
    0.95. Needles are the stated, small side: they are numbered in one window.
    """
    share = seeded_share(str(seed), F.col("ord"))
    if not sequential:
        return needles.withColumn("depth", share)
    step = 1 / (F.count("*").over(Window.partitionBy()) + 1)
    at = F.row_number().over(Window.orderBy("ord")) * step + (share - 0.5) * 0.3 * step
    return needles.withColumn("depth", F.greatest(F.least(at, F.lit(0.95)), F.lit(0.05)))


def insert(docs: DataFrame, needles: DataFrame, seed: int = 42, sequential: bool = False) -> tuple[DataFrame, DataFrame]:
    """The haystack ``(id, text)`` with the needles in it, and ``(ord, needle, question, depth, id)``: where each is.

    ``docs`` is ``(id, text)``, a haystack in the order of ``id``;
    ``needles`` is ``(ord, needle, question)``. A depth is a place among all
    characters, found by running sums of the texts' lengths; the needle goes
    between the characters there, a blank on either side. Null texts count
    as empty, and no text has room for a needle unless it has a character;
    without any, needles are nowhere (``id`` is null).
    """
    lengths = docs.where("id is not null").select("id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("_len")).where("_len > 0")
    placed = materialize(running(lengths, ["id"], "_len", F.sum, "_end"), "places")
    total = placed.agg(F.coalesce(F.max("_end"), F.lit(0)).alias("_total"))
    asked = depths(needles, seed, sequential).crossJoin(total)
    at = asked.withColumn("t", F.floor(F.col("depth") * F.col("_total"))).withColumn("_one", F.lit(1))
    starts = placed.select(F.lit(1).alias("_one"), (F.col("_end") - F.col("_len")).alias("t"), "id")
    found = materialize(last_before(at, starts, "_one", take=["id"]).select("ord", "needle", "question", "depth", "id", (F.col("t") - F.col("right_t")).alias("_off")), "needles")
    held = found.where("id is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_off", "ord", "needle"))).alias("_n"))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def put(acc: Column, x: Column) -> Column:
        piece = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (x["_off"] - acc["at"]).cast("int"))
        return F.struct(F.concat(acc["done"], piece, F.lit(" "), x["needle"], F.lit(" ")).alias("done"), x["_off"].alias("at"))

    spliced = F.aggregate("_n", start, put, lambda acc: F.concat(acc["done"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"))))
    near = F.broadcast if found.count() <= NEAR else lambda df: df  # few needles go to the texts, which stay where they are
    return docs.join(near(held), "id", "left").select("id", F.when(F.col("_n").isNull(), F.col("text")).otherwise(spliced).alias("text")), found.drop("_off")


def found_by(ranked: DataFrame, haystack: DataFrame, needles: DataFrame) -> DataFrame:
    """``(ord, depth, rank, in_answer, in_context, found)``: a row a needle.

    ``ranked`` is ``(qid, rank, id)``, the retrieval of each needle's
    question. The context is all texts of a question, the answer the first;
    ``rank`` is that of the first text that holds the needle.
    """
    ranked = materialize(ranked.select("qid", "rank", "id"), "ranked")
    near = F.broadcast if ranked.count() <= NEAR else lambda df: df
    texts = haystack.join(near(ranked), "id").join(needles.select(F.col("ord").alias("qid"), "needle"), "qid").where(F.contains("text", "needle"))
    first = texts.groupBy("qid").agg(F.min("rank").alias("rank"))
    joined = needles.select("ord", "depth").join(first, F.col("ord") == F.col("qid"), "left")
    held = F.col("rank").isNotNull()
    return joined.select("ord", "depth", "rank", F.coalesce(F.col("rank") == 1, F.lit(False)).alias("in_answer"), held.alias("in_context"), held.alias("found"))

"""Which strings lie in which texts, by join on a part of a few characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Terms of as many characters or more meet bodies by parts of so many: of long numbers, three digits are in most.
LONG = 8


def grams(text: Column, size: int) -> Column:
    """The distinct parts of ``size`` characters of the text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def containing(terms: DataFrame, bodies: DataFrame, fold: bool = True) -> DataFrame:
    """``(term, id)``: each of ``terms`` (``term``) with every row of ``bodies`` (``id``, ``body``) that holds it.

    With ``fold``, case doesn't matter. Repeats count once. Null and empty
    terms and null bodies match nothing.

    A term and a body meet by the one of the term's parts of ``GRAM``
    characters, or ``LONG`` if it has as many, that the fewest bodies hold
    (a shorter term is a part of its own); then
    the body is searched for the whole term. So what meets is as many rows
    as hold the rarest part, never all pairs.
    """
    low = F.lower if fold else lambda c: F.col(c)
    wanted = terms.where("term <> ''").select("term").distinct().withColumn("_t", low("term"))
    texts = bodies.where("body is not null").select("id", low("body").alias("_b"))
    size = F.when(F.length("_t") >= LONG, LONG).otherwise(F.least(F.length("_t"), F.lit(GRAM)))
    sizes = [r["n"] for r in wanted.select(size.alias("n")).distinct().collect()]  # 1, 2, GRAM or LONG
    if not sizes:
        return wanted.select("term").join(bodies.select("id"), F.lit(False))
    parts = wanted.select("term", F.explode(reduce(lambda a, n: F.when(size == n, grams(F.col("_t"), n)).otherwise(a), sorted(sizes)[1:], grams(F.col("_t"), min(sizes)))).alias("_gram"))
    held = reduce(DataFrame.unionAll, (texts.select("id", F.explode(grams(F.col("_b"), n)).alias("_gram")) for n in sorted(sizes)))
    asked = held.join(parts.select("_gram").distinct(), "_gram", "left_semi")
    counts = asked.groupBy("_gram").agg(F.count("*").alias("_n"))
    # a part that no body holds rules its term out: it comes first, with no count
    rare = parts.join(counts, "_gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("x")).where("x.n > 0").select("term", F.col("x._gram").alias("_gram"))
    met = held.join(rare, "_gram").select("term", "id")
    return met.join(texts, "id").where(F.contains("_b", low("term"))).select("term", "id").distinct()

"""Latencies in log-linear buckets: counts that combine, of bounded number, and percentiles from them (L7b)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The range of the histogram in microseconds, 1 to an hour.
LEAST_US, MOST_US = 1, 3_600_000_000
#: Bits of a bucket's number: 1,024 buckets between a power of two and the next, so a bucket is under 0.1 % of its values wide.
BITS = 11


def bucket_of(us: Column) -> Column:
    """The least whole number of microseconds in the bucket of ``us``."""
    shift = F.greatest(F.length(F.bin(us)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", us, shift), shift)


def latency_histogram(rows: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """``(by..., bucket, n, total, least, most)`` of latencies ``x`` in milliseconds.

    Values are rounded to microseconds and brought into the range, so a
    group has some 23,000 buckets at most, however many rows it has. Nulls
    and NaN are left out. Histograms of parts combine: :func:`merged`.
    """
    given = rows.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    us = F.greatest(F.least(F.round(F.col(x).cast("double") * 1000), F.lit(float(MOST_US))), F.lit(float(LEAST_US))).cast("long")
    return given.select(*by, us.alias("_us")).groupBy(*by, bucket_of(F.col("_us")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("_us").alias("total"), F.min("_us").alias("least"), F.max("_us").alias("most"))


def merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """One histogram a group from the rows of several."""
    return parts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def percentiles(histogram: DataFrame, by: Sequence[str], q: Sequence[tuple[str, float]] = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))) -> DataFrame:
    """``(by..., n, p50, p95, p99, p999, mean, min, max)`` in milliseconds.

    A percentile lies between two neighbours in order, as with linear
    interpolation over the values themselves; each neighbour is taken as the
    middle of its bucket, so a percentile is within 0.1 % of the exact one
    (or half a microsecond). Mean, least and greatest are exact in
    microseconds.
    """
    shift = F.greatest(F.length(F.bin("bucket")) - BITS, F.lit(0))
    middle = F.col("bucket") + (F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1) / 2
    upto = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    ranked = histogram.select(*by, "n", "total", "least", "most", middle.alias("_mid"), F.sum("n").over(upto).alias("_upto"), F.sum("n").over(whole).alias("_all"))

    def at(p: float) -> Column:
        h = F.lit(p) * (F.col("_all") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(h), F.col("_mid")))
        high = F.min(F.when(F.col("_upto") > F.ceil(h), F.col("_mid")))
        return low + (high - low) * F.max(h - F.floor(h))

    ms = lambda c: F.round(c / 1000, 6)
    return ranked.groupBy(*by).agg(F.sum("n").alias("n"), *(ms(at(p)).alias(name) for name, p in q), ms(F.sum("total") / F.sum("n")).alias("mean"), ms(F.min("least")).alias("min"), ms(F.max("most")).alias("max"))

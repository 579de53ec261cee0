"""What held when: joins of moments to intervals, and to what came last before them (§2.4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.operators.ordering import running

#: A day is 2 ** 36.3 microseconds; 2 ** 62 of them are more than any timestamp.
TOP = 62


def valid_at(points: DataFrame, facts: DataFrame, key: str, at: str = "t", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Each point with every fact of its key that holds at its time: ``start <= at < end``.

    Columns are those of ``points`` and those of ``facts`` but ``key``, all
    under names of their own. ``at``, ``start`` and ``end`` are long. A null
    start or end is open; an interval that isn't longer than 0 holds never.
    Points and facts without a key, and points without a time, match
    nothing. Repeated rows match as often as they occur.

    An interval falls in one or two bins of a power of two that is at least
    its length; a point looks once at each power that occurs, of which there
    are 62 at most. So a fact is at most two rows however long it is, the
    rows of a frequent key are split by bins, and the join has equal keys;
    the interval is then compared exactly.
    """
    span = points.where(F.col(key).isNotNull()).agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    low, high = (span["low"], span["high"]) if span["low"] is not None else (0, 0)
    a, b = F.greatest(F.coalesce(start, F.lit(low)), F.lit(low)), F.least(F.coalesce(end, F.lit(high + 1)), F.lit(high + 1))
    cut = facts.where(F.col(key).isNotNull()).withColumns({"_a": a, "_b": b - 1}).where("_a <= _b")  # what can meet a point
    level = F.least(F.length(F.bin(F.col("_b") - F.col("_a"))), F.lit(TOP))
    binned = cut.withColumn("_level", level).withColumn("_bin", F.explode(F.array_distinct(F.array(F.expr("shiftright(_a, _level)"), F.expr("shiftright(_b, _level)")))))
    levels = sorted(r["_level"] for r in binned.select("_level").distinct().collect())
    looking = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*(F.lit(n) for n in levels)).cast("array<int>"))).withColumn("_bin", F.expr(f"shiftright(`{at}`, _level)"))
    met = looking.join(binned.hint("merge"), [key, "_level", "_bin"])  # neither side goes through the driver
    return met.where((F.col(at) >= F.col("_a")) & (F.col(at) <= F.col("_b"))).drop("_level", "_bin", "_a", "_b")


def last_before(left: DataFrame, right: DataFrame, key: str, at: str = "t", take: Sequence[str] = (), or_equal: bool = True) -> DataFrame:
    """``left`` with ``right_<at>`` and the columns ``take`` of the latest row of ``right`` of its key at or before its time.

    With ``or_equal`` False, strictly before. Of rows of ``right`` of one
    key and time that with the greatest values of ``take`` counts. Rows of
    ``left`` without a match, a key or a time stay, with nulls; such rows of
    ``right`` match nothing. Every row of ``left`` comes once.

    Both sides are put in one order by key and time, dealt out by range, and
    the latest row of ``right`` is carried on within each range and from one
    range to the next. A key that holds half of all rows is so many ranges.
    """
    side = 1 if or_equal else -1  # where times are equal: right before left, or after
    held = F.struct(F.col(key).alias("k"), F.col(at).alias("t"), F.struct(*(F.col(c) for c in take), F.lit(0).alias("_")).alias("x"))
    rows = left.select(F.col(key).alias("_key"), F.col(at).alias("_t"), F.lit(0).alias("_side"), F.struct("*").alias("_row"))
    row_type, known = rows.schema["_row"].dataType, right.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    marks = known.select(F.col(key).alias("_key"), F.col(at).alias("_t"), F.lit(-side).alias("_side"), F.lit(None).cast(row_type).alias("_row"), held.alias("_held"))
    both = rows.withColumn("_held", F.lit(None).cast(marks.schema["_held"].dataType)).unionByName(marks)
    told = running(both.withColumn("_n", F.monotonically_increasing_id()), ["_key", "_t", "_side", "_n"], "_held", F.max, "_last").where("_side = 0")
    own = lambda c: F.when((F.col("_last.k") == F.col("_key")) & F.col("_t").isNotNull(), F.col(f"_last.{c}"))
    return told.select("_row.*", own("t").alias(f"right_{at}"), *(own(f"x.{c}").alias(c) for c in take))

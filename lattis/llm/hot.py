"""Joins to a table of groups when a few groups hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is heavy from one part in this many of all rows on, so there are this many heavy groups at most.
HEAVY = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` inner-joined to ``groups`` on ``key``, which is unique in ``groups`` and null on neither side.

    ``size`` is the column of ``groups`` with the number of rows of each and
    ``total`` their sum. Heavy groups, of which there can be ``HEAVY`` at
    most, are broadcast, so their rows stay where they are; the rows of the
    others meet their group in a shuffled join, where no key has over a
    ``HEAVY``-th of all rows.
    """
    is_heavy = F.col(size) > total // HEAVY
    heavy, rest = F.broadcast(groups.where(is_heavy)), groups.where(~is_heavy)
    here = rows.join(heavy, key)
    there = rows.join(F.broadcast(groups.where(is_heavy).select(key)), key, "left_anti").join(rest.hint("merge"), key)
    return here.unionByName(there)

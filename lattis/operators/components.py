"""Connected components: large graphs shrink by contraction, small ones end in alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.session import cut_lineage, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rows_a_task: int = 250_000) -> DataFrame:
    """``(node, component)`` for every node that an edge touches.

    The component is its smallest node. Self-loops and edges with a null
    end link nothing (a node that has only self-loops is still returned);
    repeated edges count once; no edges give no rows.

    Every round is a few aggregations and equi-joins over the edge list: no
    neighbour list is ever gathered. A hub's minimum is combined map-side;
    where the links are more than a task's, a node in over a ``HEAVY``-th of
    them has its minimum broadcast, of which there are ``HEAVY`` at most, so
    its links stay where they are. More links than a task's are contracted
    first (:func:`_contracted`). The star
    rounds are logarithmic in the longest path; each ends in a reliable
    checkpoint of a task for every ``rows_a_task`` links, so small graphs
    don't leave hundreds of small files a round.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    links = cut_lineage(_low(pairs))
    n = links.count()
    if n > rows_a_task:
        return _contracted(nodes, links, n, rows_a_task)
    links = _stars(links, n, rows_a_task)
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("component")
    )


def _stars(links: DataFrame, n: int, rows_a_task: int) -> DataFrame:
    """The ``n`` links as ``(u, v)``: each node but the smallest of its component, and that smallest."""
    tasks = 1 + n // rows_a_task
    before = None
    while True:
        large = 0 if n <= rows_a_task else n
        links = cut_lineage(_small_star(_large_star(links, large), large).coalesce(tasks))
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or now["n"] == 0:
            break
        before, n = now, now["n"]
    return links


def _contracted(nodes: DataFrame, links: DataFrame, n: int, rows_a_task: int) -> DataFrame:
    """The result of :func:`connected_components` for ``n`` links that are more than a task's.

    Nodes get numbers, so that minima are combined in hash maps. In a round
    each node goes over to the first of its neighbours and itself, in an
    order that is drawn anew by an exclusive or; links between what they
    went over to remain, each once. About half of the nodes stay, or fewer,
    so all rounds together cost about as much as the first two. What fits a
    task is finished in one; if a round takes less than a tenth of the links
    away, star rounds finish the rest.
    """
    named = materialize(nodes.withColumn("x", F.monotonically_increasing_id()), "numbers")
    number = named.select("node", F.col("x").alias("to"))
    by = lambda df, at: _looked_up(df, at, number.withColumnRenamed("node", "x"), n).withColumn(at, F.col("to")).drop("to")
    links = materialize(_low(by(by(links, "u"), "v")), "links")
    went: list[DataFrame] = []
    while n > rows_a_task:
        mask = F.xxhash64(F.lit(len(went))).bitwiseAND(F.lit((1 << 62) - 1))
        both = links.unionAll(links.select("v", "u"))
        first = both.groupBy("u").agg(F.min(F.col("v").bitwiseXOR(mask)).alias("m"))
        to = materialize(first.select(F.col("u").alias("x"), F.least("m", F.col("u").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to")), "went")
        went.append(to)
        at_u = _looked_up(links, "u", to, n).select(F.col("to").alias("u"), "v")
        links = materialize(_low(_looked_up(at_u, "v", to, n).select("u", F.col("to").alias("v"))), "links")
        before, n = n, links.count()
        if n > 0.9 * before:
            break
    if n > rows_a_task:
        at = _stars(links, n, rows_a_task).select(F.col("u").alias("to"), F.col("v").alias("root"))
    else:
        at = links.repartition(1).mapInPandas(_united, "to long, root long")
    for to in reversed(went):
        rows = _looked_up(to, "to", materialize(at, "roots").withColumnRenamed("to", "x").withColumnRenamed("root", "r"), to.count(), "left")
        at = rows.select(F.col("x").alias("to"), F.coalesce("r", "to").alias("root"))
    placed = materialize(named.join(at.withColumnRenamed("to", "x"), "x", "left").select("node", F.coalesce("root", "x").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("node").alias("component"))
    return _looked_up(placed, "root", least.withColumnRenamed("root", "x"), placed.count()).select("node", "component")


def _looked_up(rows: DataFrame, at: str, table: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """``rows``, of which there are ``n``, with the columns of ``table`` whose ``x`` is that of column ``at``; heavy values are looked up where the rows are."""
    own = [c for c in table.columns if c != "x"]
    table, keyed = table.withColumnRenamed("x", "_x"), rows.withColumn("_at", F.col(at))
    heavy = materialize(rows.groupBy(at).agg(F.count("*").alias("k")).where(F.col("k") > n // HEAVY).select(F.col(at).alias("_x"), F.lit(True).alias("_heavy")), "heavy")
    if heavy.isEmpty():
        return keyed.join(table, F.col("_at") == F.col("_x"), how).select(*rows.columns, *own)
    known = table.join(F.broadcast(heavy), "_x", "right")
    marked = keyed.join(F.broadcast(known), F.col("_at") == F.col("_x"), "left").drop("_x")
    rest = marked.where("_heavy is null").drop("_heavy", *own).join(table, F.col("_at") == F.col("_x"), how)
    return marked.where("_heavy").select(*rows.columns, *own).unionAll(rest.select(*rows.columns, *own))


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The few links that are left as each end and the end that stands for its component."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    yield pd.DataFrame([(x, root(x)) for x in list(up)], columns=["to", "root"])


#: The share of all links, as one part of this many, from which a node is heavy.
HEAVY = 1_000


def _minima(links: DataFrame, at: str, n: int) -> DataFrame:
    """``links`` with ``m``, the smallest neighbour of the node in column ``at``, or null if none is smaller.

    ``n`` is the number of links if they are many, so that heavy nodes are told from others; else 0.
    """
    lowest = links.groupBy("u").agg(F.min("v").alias("m"))
    if not n:
        return links.join(lowest.select(F.col("u").alias("x"), "m"), F.col(at) == F.col("x"), "left").select("u", "v", "m")
    heavy = links.groupBy(at).agg(F.count("*").alias("k")).where(F.col("k") > n // HEAVY).select(F.col(at).alias("x"))
    known = heavy.join(lowest.select(F.col("u").alias("x"), "m"), "x", "left").select("x", "m", F.lit(True).alias("heavy"))
    marked = links.join(F.broadcast(known), F.col(at) == F.col("x"), "left").drop("x")
    rest = marked.where("heavy is null").drop("m", "heavy").join(lowest.select(F.col("u").alias("x"), "m"), F.col(at) == F.col("x"), "left")
    return marked.where("heavy").select("u", "v", "m").union(rest.select("u", "v", "m"))


def _low(pairs: DataFrame) -> DataFrame:
    """Distinct edges from the larger end ``u`` to the smaller end ``v``."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(links: DataFrame, n: int) -> DataFrame:
    """Join every larger neighbour of a node to the node's smallest one.

    Links lead from the larger end ``u``, so a node's smallest neighbour is
    the least ``v`` of its own links; a node without any is the smallest.
    """
    return _low(_minima(links, "v", n).select("u", F.coalesce("m", "v").alias("v")))


def _small_star(links: DataFrame, n: int) -> DataFrame:
    """Join a node and all its smaller neighbours to the smallest of them."""
    met = _minima(links, "u", n)
    return _low(met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))))

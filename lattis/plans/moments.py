"""Queries over distributions and time: tails, latency buckets, what held when."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattis.operators import histograms as H
from lattis.operators import intervals as I
from lattis.operators import tails
from lattis.plans.registry import query
from lattis.sources import graphs as S


@query("degree_tail")
def degree_tail(spark, sf_dir):
    """A row a graph: the power law that fits the tail of its degrees, and whether an exponential fits better."""
    graphs = {"trade": S.trade, "supply": S.supply, "conversations": S.conversations, "web": S.web, "duplicates": S.duplicates, "orders": S.order_chain}
    edges = reduce(DataFrame.unionByName, (f(spark, sf_dir).edges.select(F.lit(name).alias("graph"), "source_id", "target_id") for name, f in graphs.items()))
    return tails.tail_fit(tails.degree_histogram(edges, ["graph"]), ["graph"])


@query(
    "degree_counts",
    f"""WITH {S.TRADE_SQL}, {S.SUPPLY_SQL}, e AS (SELECT 'trade' AS graph, source_id AS u, target_id AS v FROM trade_edges UNION ALL SELECT 'supply', source_id, target_id FROM supply_edges),
    d AS (SELECT graph, u, count(*) AS degree FROM (SELECT graph, u, v FROM e WHERE u <> v UNION SELECT graph, v, u FROM e WHERE u <> v) GROUP BY graph, u)
    SELECT graph, degree, count(*) AS n FROM d GROUP BY graph, degree""",
)
def degree_counts(spark, sf_dir):
    """The histogram that the tail is fitted to."""
    edges = reduce(DataFrame.unionByName, (f(spark, sf_dir).edges.select(F.lit(name).alias("graph"), "source_id", "target_id") for name, f in {"trade": S.trade, "supply": S.supply}.items()))
    return tails.degree_histogram(edges, ["graph"])


_buckets = """v AS (SELECT event_type, CAST(greatest(least(round(value * 1000), 3600000000), 1) AS BIGINT) AS us FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
    b AS (SELECT *, greatest(length(bin(us)) - 11, 0) AS shift FROM v),
    h AS (SELECT event_type, (us >> shift) << shift AS bucket, max(shift) AS shift, count(*) AS n, CAST(sum(us) AS BIGINT) AS total, min(us) AS least, max(us) AS most FROM b GROUP BY 1, 2)"""


@query("latency_histogram", f"WITH {_buckets} SELECT event_type, bucket, n, total, least, most FROM h")
def latency_histogram(spark, sf_dir):
    return H.latency_histogram(S.read(spark, sf_dir, "events"), ["event_type"], "value")


def _percentile_sql(name: str, p: float) -> str:
    low, high = (f"min(CASE WHEN upto > {f}({p} * (whole - 1)) THEN mid END)" for f in ("floor", "ceil"))
    return f"round(({low} + ({high} - {low}) * max({p} * (whole - 1) - floor({p} * (whole - 1)))) / 1000, 6) AS {name}"


@query(
    "latency_hdr",
    f"""WITH {_buckets}, r AS (SELECT *, bucket + ((1::BIGINT << shift) - 1) / 2 AS mid, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY event_type) AS whole FROM h)
    SELECT event_type, CAST(sum(n) AS BIGINT) AS n, {", ".join(_percentile_sql(*x) for x in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)))},
           round(sum(total) / sum(n) / 1000, 6) AS mean, round(min(least) / 1000, 6) AS min, round(max(most) / 1000, 6) AS max FROM r GROUP BY event_type""",
)
def latency_hdr(spark, sf_dir):
    """Percentiles of a bounded state a group, where the exact ones would hold all of a group's values."""
    return H.percentiles(H.latency_histogram(S.read(spark, sf_dir, "events"), ["event_type"], "value"), ["event_type"])


def _orders(spark, sf_dir):
    return S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"), F.col("o_orderpriority").alias("priority"))


@query(
    "facts_valid_at",
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders),
    f AS (SELECT k AS fact, c, t AS valid_from, lead(t) OVER (PARTITION BY c ORDER BY t, k) AS valid_to FROM o)
    SELECT o.k AS point, fact FROM o JOIN f ON o.c = f.c AND o.t + 45 * 86400 >= valid_from AND (valid_to IS NULL OR o.t + 45 * 86400 < valid_to)""",
)
def facts_valid_at(spark, sf_dir):
    """A customer's order holds until the next one: which held 45 days after each?"""
    o = _orders(spark, sf_dir)
    facts = o.select(F.col("k").alias("fact"), "c", F.col("t").alias("valid_from"), F.lead("t").over(Window.partitionBy("c").orderBy("t", "k")).alias("valid_to"))
    points = o.select(F.col("k").alias("point"), "c", (F.col("t") + 45 * 86400).alias("t"))
    return I.valid_at(points, facts, "c").select("point", "fact")


@query(
    "last_urgent",
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(epoch(o_orderdate) AS BIGINT) AS t, o_orderpriority AS priority FROM orders),
    u AS (SELECT c, t, max(k) AS k FROM o WHERE priority LIKE '1%' GROUP BY c, t)
    SELECT o.k, u.t AS right_t, u.k AS urgent FROM o ASOF LEFT JOIN u ON o.c = u.c AND o.t > u.t""",
)
def last_urgent(spark, sf_dir):
    """Each order with its customer's last order of the first priority before it."""
    o = _orders(spark, sf_dir)
    urgent = o.where("priority like '1%'").select("c", "t", F.col("k").alias("urgent"))
    return I.last_before(o.select("k", "c", "t"), urgent, "c", take=["urgent"], or_equal=False).select("k", "right_t", "urgent")

"""Knowledge graphs projected from the relational tables, and the same in SQL.

Every projection is a plain select over Parquet, so column pruning and
filters reach the scan; nothing is cached or collected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.schema import Graph
from lattis.session import deal


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _node(df: DataFrame, prefix: str, key: str, name: str, kind) -> DataFrame:
    return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), kind.alias("entity_type"))


def _edge(df: DataFrame, a: str, akey: str, b: str, bkey: str, kind: str) -> DataFrame:
    return df.select(F.concat(F.lit(a), F.col(akey).cast("string")).alias("source_id"), F.concat(F.lit(b), F.col(bkey).cast("string")).alias("target_id"), F.lit(kind).alias("edge_type"))


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers and suppliers with their foreign keys."""
    region, nation, customer, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    entities = (
        _node(region, "region:", "r_regionkey", "r_name", F.lit("region"))
        .unionByName(_node(nation, "nation:", "n_nationkey", "n_name", F.lit("nation")))
        .unionByName(_node(customer, "customer:", "c_custkey", "c_name", F.concat(F.lit("customer:"), "c_mktsegment")))
        .unionByName(_node(supplier, "supplier:", "s_suppkey", "s_name", F.lit("supplier")))
    )
    edges = (
        _edge(nation, "nation:", "n_nationkey", "region:", "n_regionkey", "part_of")
        .unionByName(_edge(customer, "customer:", "c_custkey", "nation:", "c_nationkey", "located_in"))
        .unionByName(_edge(supplier, "supplier:", "s_suppkey", "nation:", "s_nationkey", "based_in"))
    )
    return Graph(entities, edges)


TRADE_SQL = """
trade_nodes AS (
    SELECT 'region:' || r_regionkey AS id, r_name AS name, 'region' AS entity_type FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation' FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer:' || c_mktsegment FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier' FROM supplier
),
trade_edges AS (
    SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'part_of' AS edge_type FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in' FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'based_in' FROM supplier
)"""


def supply(spark: SparkSession, sf_dir: str, rows_a_task: int = 1 << 20) -> Graph:
    """Parts and suppliers, an edge for each pair that a line item names; about ``rows_a_task`` line items meet in a task."""
    part, supplier, line = (read(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    entities = _node(part, "part:", "p_partkey", "p_name", F.concat(F.lit("part:"), "p_type")).unionByName(_node(supplier, "supplier:", "s_suppkey", "s_name", F.lit("supplier")))
    pairs = deal(line.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", least=1 + line.count() // rows_a_task).distinct()
    return Graph(entities, _edge(pairs, "part:", "l_partkey", "supplier:", "l_suppkey", "supplied_by"))


SUPPLY_SQL = """
supply_nodes AS (
    SELECT 'part:' || p_partkey AS id, p_name AS name, 'part:' || p_type AS entity_type FROM part
    UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier' FROM supplier
),
supply_edges AS (
    SELECT DISTINCT 'part:' || l_partkey AS source_id, 'supplier:' || l_suppkey AS target_id, 'supplied_by' AS edge_type FROM lineitem
)"""


def conversations(spark: SparkSession, sf_dir: str) -> Graph:
    """Conversations and turns: each turn in its conversation, after the turn before."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    conv = turns.select("conv_id").distinct().select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("name"), F.lit("conv").alias("entity_type"))
    key = F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    before = F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - 1).cast("string"))
    nodes = turns.select(key.alias("id"), F.col("role").alias("name"), F.concat(F.lit("turn:"), "role").alias("entity_type"))
    within = turns.select(key.alias("source_id"), F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("target_id"), F.lit("turn_of").alias("edge_type"))
    follows = turns.where("turn > 0").select(key.alias("source_id"), before.alias("target_id"), F.lit("follows").alias("edge_type"))
    return Graph(conv.unionByName(nodes), within.unionByName(follows))


CONV_SQL = """
conv_nodes AS (
    SELECT DISTINCT 'conv:' || conv_id AS id, CAST(conv_id AS VARCHAR) AS name, 'conv' AS entity_type FROM conversations
    UNION ALL SELECT 'turn:' || conv_id || ':' || turn, role, 'turn:' || role FROM conversations
),
conv_edges AS (
    SELECT 'turn:' || conv_id || ':' || turn AS source_id, 'conv:' || conv_id AS target_id, 'turn_of' AS edge_type FROM conversations
    UNION ALL SELECT 'turn:' || conv_id || ':' || turn, 'turn:' || conv_id || ':' || (turn - 1), 'follows' FROM conversations WHERE turn > 0
)"""

HOST = r"^https?://([^/]+)"
#: The first path segment of two letters names a page's language.
LANG = r"^https?://[^/]+/([a-z]+)/"


def web(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages, by language, on hosts."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", HOST, 1).alias("host"), F.regexp_extract("url", LANG, 1).alias("lang"))
    nodes = pages.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("name"), F.concat(F.lit("page:"), "lang").alias("entity_type"))
    hosts = pages.select("host").distinct().select(F.concat(F.lit("host:"), "host").alias("id"), F.col("host").alias("name"), F.lit("host").alias("entity_type"))
    edges = pages.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("source_id"), F.concat(F.lit("host:"), "host").alias("target_id"), F.lit("hosted_on").alias("edge_type"))
    return Graph(nodes.unionByName(hosts), edges)


WEB_SQL = r"""
web_pages AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang FROM pages),
web_nodes AS (
    SELECT 'page:' || page_id AS id, url AS name, 'page:' || lang AS entity_type FROM web_pages
    UNION ALL SELECT DISTINCT 'host:' || host, host, 'host' FROM web_pages
),
web_edges AS (SELECT 'page:' || page_id AS source_id, 'host:' || host AS target_id, 'hosted_on' AS edge_type FROM web_pages)"""


def duplicates(spark: SparkSession, sf_dir: str) -> Graph:
    """Documents, each linked to the smallest id with an equal text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("digest"))
    nodes = _node(docs, "doc:", "doc_id", "digest", F.concat(F.lit("doc:"), "lang"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    edges = _edge(docs.join(first, "digest").where("doc_id <> first"), "doc:", "doc_id", "doc:", "first", "same_text")
    return Graph(nodes, edges)


DUP_SQL = """
dup_docs AS (SELECT doc_id, lang, source, md5(text) AS digest, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents),
dup_nodes AS (SELECT 'doc:' || doc_id AS id, digest AS name, 'doc:' || lang AS entity_type FROM dup_docs),
dup_edges AS (SELECT 'doc:' || doc_id AS source_id, 'doc:' || first AS target_id, 'same_text' AS edge_type FROM dup_docs WHERE doc_id <> first)"""


def order_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders, each superseding the customer's order before it."""
    from pyspark.sql import Window

    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    nodes = _node(orders, "order:", "o_orderkey", "o_orderpriority", F.lit("order"))
    edges = _edge(orders.withColumn("before", before).where("before is not null"), "order:", "o_orderkey", "order:", "before", "supersedes")
    return Graph(nodes, edges)


ORDER_SQL = """
order_nodes AS (SELECT 'order:' || o_orderkey AS id, o_orderpriority AS name, 'order' AS entity_type FROM orders),
order_edges AS (
    SELECT 'order:' || o_orderkey AS source_id, 'order:' || before AS target_id, 'supersedes' AS edge_type
    FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS NOT NULL
)"""

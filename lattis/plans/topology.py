"""Queries over graph topology."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattis.operators import forests
from lattis.operators import gaps as G
from lattis.operators import paths as P
from lattis.operators import topology as T
from lattis.operators.components import connected_components
from lattis.plans.registry import query
from lattis.session import materialize
from lattis.sources import graphs as S

#: Components of the web graph, by reachability over distinct pairs.
WEB_COMPONENTS = """
web_steps AS (SELECT source_id AS u, target_id AS v FROM web_edges UNION SELECT target_id, source_id FROM web_edges),
web_reach AS (SELECT id AS x, id AS y FROM web_nodes UNION SELECT r.x, s.v FROM web_reach r JOIN web_steps s ON r.y = s.u),
web_placed AS (SELECT x AS id, min(y) AS component FROM web_reach GROUP BY x)"""


@query("valid_edges", f"WITH {S.TRADE_SQL} SELECT e.* FROM trade_edges e WHERE source_id IN (SELECT id FROM trade_nodes WHERE entity_type <> 'supplier') AND target_id IN (SELECT id FROM trade_nodes WHERE entity_type <> 'supplier')")
def valid_edges(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    return T.valid_edges(g.edges, g.entities.where("entity_type <> 'supplier'"))


@query(
    "structural_health",
    f"""
    WITH RECURSIVE {S.TRADE_SQL},
    deg AS (SELECT id, count(s) AS d FROM trade_nodes LEFT JOIN (SELECT source_id AS s FROM trade_edges UNION ALL SELECT target_id FROM trade_edges) ON id = s GROUP BY id),
    et AS (SELECT edge_type, count(*) AS n FROM trade_edges GROUP BY 1),
    tot AS (SELECT sum(n) AS t FROM et),
    -- every foreign key holds, so nations hang on regions and everything hangs on nations
    comp AS (
        SELECT 'region:' || r_regionkey AS component, 1 + count(DISTINCT n_nationkey) + count(DISTINCT 'c' || c_custkey) + count(DISTINCT 's' || s_suppkey) AS n
        FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1
    )
    SELECT CAST((SELECT count(*) FROM comp) AS BIGINT) AS components, CAST((SELECT max(n) FROM comp) AS BIGINT) AS largest_component, CAST(count(*) AS BIGINT) AS nodes,
           round(avg(d), 6) AS avg_degree, CAST(max(d) AS BIGINT) AS max_degree, CAST(count(*) FILTER (d = 0) AS BIGINT) AS isolated,
           CAST((SELECT t FROM tot) AS BIGINT) AS edges, CAST((SELECT count(*) FROM et) AS BIGINT) AS edge_types,
           (SELECT round(sum(-(n / t) * log2(n / t)), 6) FROM et, tot) AS edge_entropy,
           CAST((SELECT count(DISTINCT entity_type) FROM trade_nodes) AS BIGINT) AS entity_types,
           round((SELECT max(n) FROM comp) / count(*), 6) AS largest_ratio
    FROM deg
    """,
)
def structural_health(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    return T.structural_health(g.entities, g.edges)


@query("connected_components", f"WITH RECURSIVE {S.WEB_SQL}, {WEB_COMPONENTS} SELECT id, component FROM web_placed")
def components(spark, sf_dir):
    g = S.web(spark, sf_dir)
    return T.components_of(g.entities, g.edges)


@query(
    "component_sizes",
    f"""WITH RECURSIVE {S.WEB_SQL}, {WEB_COMPONENTS}, s AS (SELECT component, count(*) AS n FROM web_placed GROUP BY 1)
    SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS bucket, count(*) AS components, CAST(sum(n) AS BIGINT) AS nodes FROM s GROUP BY 1""",
)
def component_sizes(spark, sf_dir):
    g = S.web(spark, sf_dir)
    return G.component_sizes(g.entities, g.edges)


@query("isolates_by_type", f"WITH {S.DUP_SQL} SELECT entity_type, count(*) AS n FROM dup_nodes WHERE id NOT IN (SELECT source_id FROM dup_edges UNION SELECT target_id FROM dup_edges) GROUP BY 1")
def isolates_by_type(spark, sf_dir):
    g = S.duplicates(spark, sf_dir)
    return T.isolates_by_type(g.entities, g.edges)


@query(
    "degree_stats",
    f"""WITH {S.CONV_SQL},
    e AS (SELECT source_id AS s, target_id AS t, count(*) AS m FROM (SELECT * FROM conv_edges UNION ALL SELECT target_id, source_id, 'back' FROM conv_edges WHERE edge_type = 'follows') GROUP BY 1, 2),
    p AS (SELECT least(s, t) AS a, greatest(s, t) AS b, max(m) AS m FROM e GROUP BY 1, 2)
    SELECT id, CAST(sum(m) AS BIGINT) AS degree FROM (SELECT a AS id, m FROM p UNION ALL SELECT b, m FROM p) GROUP BY id""",
)
def degree_stats(spark, sf_dir):
    g = S.conversations(spark, sf_dir)
    back = g.edges.where("edge_type = 'follows'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("back").alias("edge_type"))
    return T.multigraph_degree(g.edges.unionByName(back))


@query("raw_degree", f"WITH {S.SUPPLY_SQL} SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM supply_edges UNION ALL SELECT target_id FROM supply_edges) GROUP BY id")
def raw_degree(spark, sf_dir):
    return T.raw_degree(S.supply(spark, sf_dir).edges)


@query("filtered_subgraph", f"WITH {S.TRADE_SQL} SELECT * FROM trade_edges WHERE edge_type NOT IN ('located_in')")
def filtered_subgraph(spark, sf_dir):
    return T.filtered_subgraph(S.trade(spark, sf_dir).edges, ["located_in"], include=False)


@query(
    "edge_type_components",
    f"""WITH {S.TRADE_SQL}, n AS (SELECT count(*) AS n FROM trade_nodes),
    touched AS (SELECT edge_type, count(DISTINCT id) AS touched, count(DISTINCT target_id) AS own FROM (SELECT edge_type, source_id AS id, target_id FROM trade_edges UNION ALL SELECT edge_type, target_id, target_id FROM trade_edges) GROUP BY 1)
    SELECT edge_type, CAST(n - touched + own AS BIGINT) AS components FROM touched, n""",
)
def edge_type_components(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    return T.edge_type_components(g.entities, g.edges)


_conv_steps = "steps AS (SELECT source_id AS u, target_id AS v FROM conv_edges UNION SELECT target_id, source_id FROM conv_edges)"


@query(
    "khop",
    f"""WITH RECURSIVE {S.CONV_SQL}, {_conv_steps},
    walk AS (SELECT id AS root, id, 0 AS depth FROM conv_nodes WHERE entity_type = 'turn:system' UNION SELECT root, v, depth + 1 FROM walk JOIN steps ON id = u WHERE depth < 2)
    SELECT root, id, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY 1, 2""",
)
def khop(spark, sf_dir):
    g = S.conversations(spark, sf_dir)
    return T.khop(g.edges, g.entities.where("entity_type = 'turn:system'"), 2)


@query("induced_edges", f"WITH {S.CONV_SQL} SELECT e.* FROM conv_edges e WHERE source_id IN (SELECT id FROM conv_nodes WHERE entity_type LIKE 'turn:%') AND target_id IN (SELECT id FROM conv_nodes WHERE entity_type LIKE 'turn:%')")
def induced_edges(spark, sf_dir):
    g = S.conversations(spark, sf_dir)
    return T.induced_edges(g.edges, g.entities.where("entity_type like 'turn:%'"))


@query(
    "shortest_paths",
    f"""WITH RECURSIVE {S.CONV_SQL}, {_conv_steps},
    asked AS (SELECT 'turn:' || conv_id || ':0' AS a, 'turn:' || conv_id || ':' || max(turn) AS b FROM conversations GROUP BY conv_id
              UNION SELECT 'turn:' || conv_id || ':0', 'turn:' || (conv_id + 1) || ':0' FROM conversations),
    walk AS (SELECT DISTINCT a, a AS id, 0 AS d FROM asked UNION SELECT a, v, d + 1 FROM walk JOIN steps ON id = u WHERE d < 6),
    dist AS (SELECT a, id, min(d) AS d FROM walk GROUP BY 1, 2)
    SELECT asked.a, asked.b, CAST(d AS INT) AS hops FROM asked LEFT JOIN dist ON dist.a = asked.a AND dist.id = asked.b""",
)
def shortest_paths(spark, sf_dir):
    turns = S.read(spark, sf_dir, "conversations")
    key = lambda c, t: F.concat(F.lit("turn:"), c.cast("string"), F.lit(":"), t.cast("string"))
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("last")).select(key(F.col("conv_id"), F.lit(0)).alias("a"), key(F.col("conv_id"), F.col("last")).alias("b"))
    apart = turns.select(key(F.col("conv_id"), F.lit(0)).alias("a"), key(F.col("conv_id") + 1, F.lit(0)).alias("b"))
    return T.shortest_paths(S.conversations(spark, sf_dir).edges, ends.union(apart), longest=6)


def _chained(orders, key):
    """``(node, component)`` of the orders ``(k, c, day)``: all of a customer's are in one chain, as are a day's, so customers and days are linked in place of orders."""
    rows = orders.where("k is not null").select("k", *(F.concat(F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("c", "day")))
    each = materialize(rows.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), "orders")
    repeated = rows.join(each.where("lo <> hi"), "k").select("c", "lo")  # a key of several customers
    within = connected_components(rows.select("c", "day").union(repeated), "c", "day")
    return each.join(within, F.col("lo") == F.col("node")).select(key("k").alias("node"), "component")


def _paths_sql(steps: str, longest: int) -> str:
    """CTEs ``dist`` (by levels from each ``b`` of ``asked``) and ``found`` (walks from ``a`` to the least node that is nearer), over ``steps`` (u, v)."""
    parts = ["l0 AS MATERIALIZED (SELECT DISTINCT b AS root, b AS id FROM asked)"]
    for k in range(1, longest + 1):
        seen = " ".join(f"EXCEPT SELECT root, id FROM l{j}" for j in (k - 1, k - 2) if j >= 0)
        parts.append(f"l{k} AS MATERIALIZED (SELECT DISTINCT root, v AS id FROM l{k - 1} JOIN {steps} s ON s.u = id {seen})")
    parts.append("dist AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT root, id, {k} AS d FROM l{k}" for k in range(longest + 1)) + ")")
    parts.append("w0 AS MATERIALIZED (SELECT a, b, d AS hops, a AS id, a AS path FROM asked JOIN dist ON root = b AND dist.id = a)")
    for k in range(1, longest + 1):
        parts.append(f"w{k} AS MATERIALIZED (SELECT w.a, w.b, w.hops, min(v) AS id, w.path || '>' || min(v) AS path FROM w{k - 1} w JOIN {steps} s ON s.u = w.id JOIN dist ON root = w.b AND dist.id = v AND d = w.hops - {k} WHERE w.hops >= {k} GROUP BY w.a, w.b, w.hops, w.path)")
    parts.append("found AS (" + " UNION ALL ".join(f"SELECT a, b, hops, path FROM w{k} WHERE hops = {k}" for k in range(longest + 1)) + ")")
    return ", ".join(parts)


@query(
    "paths",
    f"""WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_custkey AS c, date_trunc('day', o_orderdate) AS day FROM orders),
    e AS (SELECT k AS x, lag(k) OVER (PARTITION BY c ORDER BY k) AS y FROM o UNION ALL SELECT k, lag(k) OVER (PARTITION BY day ORDER BY k) FROM o),
    chain AS MATERIALIZED (SELECT 'order:' || x AS u, 'order:' || y AS v FROM e WHERE y IS NOT NULL UNION SELECT 'order:' || y, 'order:' || x FROM e WHERE y IS NOT NULL),
    asked AS MATERIALIZED (SELECT 'order:' || k AS a, 'order:' || (k + 1) AS b FROM o WHERE k % 100 = 0),
    cc(id, comp) USING KEY (id) AS (
        SELECT DISTINCT u, u FROM chain
        UNION SELECT s.v, min(c.comp) FROM cc c JOIN chain s ON s.u = c.id JOIN recurring.cc r ON r.id = s.v GROUP BY s.v, r.comp HAVING min(c.comp) < r.comp),
    {_paths_sql("chain", 10)}
    SELECT q.a, q.b, CAST(hops AS INT) AS hops, CASE WHEN path IS NOT NULL THEN 'found' WHEN x.comp = y.comp THEN 'further' ELSE 'apart' END AS status, path
    FROM asked q LEFT JOIN found USING (a, b) LEFT JOIN cc x ON x.id = q.a LEFT JOIN cc y ON y.id = q.b""",
)
def paths(spark, sf_dir):
    """From every hundredth order to the one after it, along customers' and days' chains of orders, up to 10 hops."""
    orders = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.date_trunc("day", "o_orderdate").alias("day"))
    key = lambda c: F.concat(F.lit("order:"), F.col(c).cast("string"))
    chain = lambda by: orders.withColumn("y", F.lag("k").over(Window.partitionBy(by).orderBy("k"))).where("y is not null").select(key("k").alias("source_id"), key("y").alias("target_id"))
    asked = orders.where("k % 100 = 0").select(key("k").alias("a"), F.concat(F.lit("order:"), (F.col("k") + 1).cast("string")).alias("b"))
    return P.shortest_paths(chain("c").unionByName(chain("day")), asked, longest=10, placed=_chained(orders, key)).withColumn("path", F.array_join("path", ">"))


@query(
    "reasoning_paths",
    f"""WITH {S.CONV_SQL}, step AS MATERIALIZED (SELECT source_id AS u, target_id AS v FROM conv_edges UNION SELECT target_id, source_id FROM conv_edges),
    points AS MATERIALIZED (
        SELECT conv_id AS qid, turn AS pos, 'turn:' || conv_id || ':' || turn AS id FROM conversations WHERE role = 'user'
        UNION ALL SELECT conv_id, max(turn) + 1, 'turn:' || (conv_id + 1) || ':0' FROM conversations GROUP BY conv_id),
    seg AS MATERIALIZED (SELECT qid, id AS a, lead(id) OVER (PARTITION BY qid ORDER BY pos, id) AS b FROM points),
    asked AS MATERIALIZED (SELECT DISTINCT a, b FROM seg WHERE a IN (SELECT u FROM step) AND b IN (SELECT u FROM step)),
    {_paths_sql("step", 4)},
    told AS (SELECT qid, a, b, path FROM seg JOIN asked USING (a, b) LEFT JOIN found USING (a, b)),
    node AS (SELECT DISTINCT qid, unnest(string_split(path, '>')) AS id FROM told)
    SELECT qid, (SELECT count(*) FROM told t WHERE t.qid = p.qid) AS segments, (SELECT count(*) FILTER (path IS NULL) FROM told t WHERE t.qid = p.qid) AS disconnected, CAST(0 AS BIGINT) AS further,
           coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM node n WHERE n.qid = p.qid AND (n.qid, n.id) NOT IN (SELECT (qid, id) FROM points)), '') AS interior
    FROM (SELECT DISTINCT qid FROM points) p""",
)
def reasoning_paths(spark, sf_dir):
    """The nodes between a conversation's user turns, and then the next conversation's first turn, which nothing joins to it."""
    turns = S.read(spark, sf_dir, "conversations")
    key = lambda c, t: F.concat(F.lit("turn:"), c.cast("string"), F.lit(":"), t.cast("string"))
    asked = turns.where("role = 'user'").select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), key(F.col("conv_id"), F.col("turn")).alias("id"))
    then = turns.groupBy(F.col("conv_id").alias("qid")).agg((F.max("turn") + 1).alias("pos")).withColumn("id", key(F.col("qid") + 1, F.lit(0)))
    return P.between_waypoints(S.conversations(spark, sf_dir).edges, asked.unionByName(then)).withColumn("interior", F.array_join("interior", ","))


_nation = """part AS (SELECT id, CASE WHEN id LIKE 'nation:%' THEN id WHEN id LIKE 'region:%' THEN 'r' ELSE (SELECT max(target_id) FROM trade_edges WHERE source_id = trade_nodes.id) END AS community FROM trade_nodes)"""


def _by_nation(g):
    up = g.edges.where("edge_type <> 'part_of'").select(F.col("source_id").alias("id"), F.col("target_id").alias("community"))
    own = g.entities.where("entity_type in ('nation', 'region')").select("id", F.when(F.col("entity_type") == "nation", F.col("id")).otherwise(F.lit("r")).alias("community"))
    return up.unionByName(own)


@query(
    "modularity",
    f"""WITH {S.TRADE_SQL}, {_nation},
    e AS (SELECT a.community AS ca, b.community AS cb FROM trade_edges JOIN part a ON source_id = a.id JOIN part b ON target_id = b.id),
    m AS (SELECT count(*) AS m FROM e),
    ins AS (SELECT ca AS community, count(*) AS l FROM e WHERE ca = cb GROUP BY 1),
    d AS (SELECT community, count(*) AS d FROM (SELECT ca AS community FROM e UNION ALL SELECT cb FROM e) GROUP BY 1)
    SELECT count(*) AS communities, round(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)), 6) AS modularity FROM d LEFT JOIN ins USING (community), m""",
)
def modularity(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    return T.modularity(g.edges, _by_nation(g))


@query(
    "intercommunity_density",
    f"""WITH {S.TRADE_SQL}, {_nation},
    e AS (SELECT a.community AS ca, b.community AS cb FROM trade_edges JOIN part a ON source_id = a.id JOIN part b ON target_id = b.id)
    SELECT count(*) AS edges, count(*) FILTER (ca <> cb) AS across, round(count(*) FILTER (ca <> cb) / count(*), 6) AS density FROM e""",
)
def intercommunity_density(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    return T.intercommunity_density(g.edges, _by_nation(g))


@query(
    "type_homogeneity",
    f"""WITH {S.TRADE_SQL}, {_nation}, c AS (SELECT community, entity_type, count(*) AS n FROM trade_nodes JOIN part USING (id) GROUP BY 1, 2),
    t AS (SELECT community, max(n) AS top, sum(n) AS size FROM c GROUP BY 1)
    SELECT count(*) AS communities, round(sum(top) / sum(size), 6) AS homogeneity FROM t""",
)
def type_homogeneity(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    return T.type_homogeneity(g.entities, _by_nation(g))


def _louvain_sql(rounds: int = 6, levels: int = 3) -> str:
    """The rounds of community search written out, and the modularity of what they give."""
    parts = [
        "w AS MATERIALIZED (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, count(*) AS w FROM trade_edges GROUP BY 1, 2)",
        "links0 AS MATERIALIZED (SELECT a AS u, b AS v, w FROM w WHERE a <> b UNION ALL SELECT b, a, w FROM w WHERE a <> b UNION ALL SELECT a, a, 2 * w FROM w WHERE a = b)",
        "m2 AS MATERIALIZED (SELECT CAST(sum(w) AS DOUBLE) AS m2 FROM links0)",
    ]
    for level in range(levels):
        links, at = f"links{level}", f"at{level}"
        parts.append(f"{at}_0 AS MATERIALIZED (SELECT u AS id, sum(w) AS k, u AS community FROM {links} GROUP BY u)")
        for i in range(rounds):
            parts.append(f"""{at}_{i + 1} AS MATERIALIZED (
                WITH total AS (SELECT community, sum(k) AS kc FROM {at}_{i} GROUP BY 1),
                near AS (SELECT u AS id, community, sum(w) AS kin FROM {links} JOIN {at}_{i} n ON v = n.id WHERE u <> v GROUP BY 1, 2),
                gains AS (
                    SELECT n.id, n.community AS own, x.community, CAST(kin AS DOUBLE) - 1.0::DOUBLE * n.k * (kc - CASE WHEN x.community = n.community THEN n.k ELSE 0 END) / m2 AS gain
                    FROM {at}_{i} n JOIN near x ON n.id = x.id JOIN total t ON x.community = t.community, m2),
                best AS (SELECT id, first(community ORDER BY gain DESC, community) AS wish, max(gain) AS top, max(gain) FILTER (community = own) AS stay FROM gains GROUP BY 1)
                SELECT n.id, n.k, CASE WHEN md5(n.id || ':{i}') < '8' AND top > coalesce(stay, 0) + 1e-12 THEN wish ELSE n.community END AS community FROM {at}_{i} n LEFT JOIN best USING (id))""")
        last = f"{at}_{rounds}"
        parts.append(
            f"placed{level} AS MATERIALIZED (SELECT id, community FROM {last})" if not level else f"placed{level} AS MATERIALIZED (SELECT p.id, x.community FROM placed{level - 1} p JOIN {last} x ON p.community = x.id)"
        )
        parts.append(f"links{level + 1} AS MATERIALIZED (SELECT a.community AS u, b.community AS v, sum(w) AS w FROM {links} JOIN {last} a ON u = a.id JOIN {last} b ON v = b.id GROUP BY 1, 2)")
    return f"""WITH {S.TRADE_SQL}, {", ".join(parts)},
    e AS (SELECT x.community AS cx, y.community AS cy FROM trade_edges JOIN placed{levels - 1} x ON source_id = x.id JOIN placed{levels - 1} y ON target_id = y.id),
    d AS (SELECT c, count(*) AS d FROM (SELECT cx AS c FROM e UNION ALL SELECT cy FROM e) GROUP BY 1),
    i AS (SELECT cx AS c, count(*) AS n FROM e WHERE cx = cy GROUP BY 1)
    SELECT count(*) AS communities, round(sum(coalesce(n, 0) / (SELECT count(*) FROM e) - pow(d / (2.0 * (SELECT count(*) FROM e)), 2)), 6) AS modularity FROM d LEFT JOIN i USING (c)"""


@query("louvain", _louvain_sql())
def louvain(spark, sf_dir):
    """Communities found on the trade graph, and their modularity."""
    g = S.trade(spark, sf_dir)
    return T.modularity(g.edges, G.label_communities(g.edges, rounds=6, levels=3))


@query("communities")
def communities(spark, sf_dir):
    """``(id, community)`` of brands, sizes and types that parts join, searched until the modularity rises no more.

    SQL can't express a search of unknown length; tests hold it against a plain sequential one.
    """
    return G.label_communities(_triangles(spark, sf_dir))


#: The supply graph of customers' nations and suppliers of their orders: small, with triangles.
_tri = """
tri AS (
    SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (
        SELECT 'b:' || p_brand AS x, 's:' || p_size AS y FROM part UNION SELECT 'b:' || p_brand, 't:' || p_type FROM part UNION SELECT 's:' || p_size, 't:' || p_type FROM part WHERE p_size <= 12)
),
w AS (SELECT a AS u, b AS v FROM tri UNION ALL SELECT b, a FROM tri),
deg AS (SELECT u, count(*) AS d FROM w GROUP BY u)"""


def _triangles(spark, sf_dir):
    part = S.read(spark, sf_dir, "part").select(F.concat(F.lit("b:"), "p_brand").alias("b"), F.concat(F.lit("s:"), F.col("p_size").cast("string")).alias("s"), F.concat(F.lit("t:"), "p_type").alias("t"), "p_size")
    pairs = part.select("b", "s").union(part.select("b", "t")).union(part.where("p_size <= 12").select("s", "t")).distinct().toDF("source_id", "target_id")
    return pairs.withColumn("edge_type", F.lit("has"))


@query(
    "burt_constraint",
    f"""WITH {_tri},
    ind AS (SELECT w1.u AS i, w2.v AS j, sum(1.0 / dq.d) AS s FROM w w1 JOIN w w2 ON w1.v = w2.u AND w1.u <> w2.v JOIN deg dq ON dq.u = w1.v JOIN w w3 ON w3.u = w1.u AND w3.v = w2.v GROUP BY 1, 2)
    SELECT w.u AS id, round(sum(pow((1 + coalesce(s, 0)) / d, 2)), 6) AS burt FROM w JOIN deg ON deg.u = w.u LEFT JOIN ind ON ind.i = w.u AND ind.j = w.v GROUP BY 1""",
)
def burt_constraint(spark, sf_dir):
    return T.brokers(_triangles(spark, sf_dir)).select("id", F.round("constraint", 6).alias("burt"))


@query(
    "effective_size",
    f"""WITH {_tri},
    ties AS (SELECT w1.u AS i, count(*) / 2 AS t FROM w w1 JOIN w w2 ON w1.u = w2.u AND w1.v <> w2.v JOIN w w3 ON w3.u = w1.v AND w3.v = w2.v GROUP BY 1)
    SELECT u AS id, d AS degree, round(d - 2.0 * coalesce(t, 0) / d, 6) AS effective_size FROM deg LEFT JOIN ties ON i = u""",
)
def effective_size(spark, sf_dir):
    return T.brokers(_triangles(spark, sf_dir)).select("id", "degree", F.round("effective_size", 6).alias("effective_size"))


@query(
    "gini",
    """WITH r AS (SELECT c_mktsegment AS segment, greatest(c_acctbal, 0) AS x, row_number() OVER (PARTITION BY c_mktsegment ORDER BY greatest(c_acctbal, 0)) AS i FROM customer)
    SELECT segment, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM r GROUP BY 1""",
)
def gini(spark, sf_dir):
    c = S.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.greatest("c_acctbal", F.lit(0.0)).alias("x"))
    return T.gini(c, "x", ["segment"])


@query("bridges", f"WITH {S.WEB_SQL} SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM web_edges")
def bridges(spark, sf_dir):
    """Every edge of a star is a bridge."""
    g = S.web(spark, sf_dir)
    return G.bridges(g.entities, g.edges)


@query(
    "order_bridges",
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, lag(o_orderkey) OVER w AS y, row_number() OVER w AS i, o_orderpriority AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    s AS (SELECT c, count(*) AS n, arg_min(k, i) AS first, arg_min(p, i) = arg_max(p, i) AS closed FROM o GROUP BY c),
    e AS (
        SELECT 'order:' || k AS x, 'order:' || y AS y FROM o JOIN s USING (c) WHERE y IS NOT NULL AND NOT (closed AND n > 2)
        UNION ALL SELECT 'order:' || first, 'customer:' || c FROM s
        UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer)
    SELECT least(x, y) AS a, greatest(x, y) AS b FROM e""",
)
def order_bridges(spark, sf_dir):
    """Customers on nations, and each customer's orders in a chain, which is a ring where the first and the last have one priority."""
    orders, customer = S.read(spark, sf_dir, "orders"), S.read(spark, sf_dir, "customer")
    w = Window.partitionBy("c").orderBy("k")
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda a, b: F.struct(a.alias("source_id"), b.alias("target_id"))
    o = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"))
    o = o.select("k", "c", "p", F.lag("k").over(w).alias("y"), F.lead("k").over(w).alias("z"), F.first(F.when(F.col("k").isNotNull(), F.struct("k", "p")), ignorenulls=True).over(w).alias("s"))
    o = o.select("*", F.col("s.k").alias("first"), F.col("s.p").alias("q"))
    chain = F.when(F.col("y").isNotNull(), edge(key("order", "k"), key("order", "y"))).otherwise(edge(key("order", "k"), key("customer", "c")))
    ring = F.when(F.col("z").isNull() & (F.col("p") == F.col("q")), edge(key("order", "first"), key("order", "k")))
    held = o.select(F.explode(F.array_compact(F.array(chain, ring))).alias("e")).select("e.*")
    return G.bridges(None, held.union(customer.select(key("customer", "c_custkey"), key("nation", "c_nationkey"))))


def _bars_sql(squarings: int) -> str:
    """Deaths from the least greatest time on a way between two users, by squaring; a user ends when it meets a smaller one."""
    parts = ["d0 AS MATERIALIZED (SELECT x, y, min(w) AS w FROM (SELECT x, y, w FROM link UNION ALL SELECT y, x, w FROM link) GROUP BY x, y)"]
    for k in range(squarings):
        parts.append(f"d{k + 1} AS MATERIALIZED (SELECT x, y, min(w) AS w FROM (FROM d{k} UNION ALL SELECT p.x, q.y, greatest(p.w, q.w) FROM d{k} p JOIN d{k} q ON p.y = q.x WHERE p.x <> q.y) GROUP BY x, y)")
    return f"""WITH link AS MATERIALIZED (
        SELECT 'user:' || user_id AS x, 'slot:' || event_type || ':' || strftime(ts, '%Y-%m-%d') AS y, ts AS w FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL),
    {", ".join(parts)},
    node AS (SELECT x FROM link UNION SELECT y FROM link),
    died AS (SELECT x, min(w) AS death FROM d{squarings} WHERE y < x GROUP BY x)
    SELECT death, count(*) AS bars FROM node LEFT JOIN died USING (x) GROUP BY death"""


@query("component_bars", _bars_sql(8))
def component_bars(spark, sf_dir):
    """When groups of users end by joining: an event links its user to its type's day."""
    slot = F.concat(F.lit("slot:"), "event_type", F.lit(":"), F.date_format("ts", "yyyy-MM-dd"))
    return forests.component_bars(S.read(spark, sf_dir, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("a"), slot.alias("b"), F.col("ts").alias("w")))


@query(
    "cyclomatic_number",
    f"""WITH {S.CONV_SQL}, e AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM conv_edges)
    SELECT (SELECT count(*) FROM e) AS e, (SELECT count(*) FROM conv_nodes) AS v, (SELECT count(DISTINCT conv_id) FROM conversations) AS c,
           (SELECT count(*) FROM e) - (SELECT count(*) FROM conv_nodes) + (SELECT count(DISTINCT conv_id) FROM conversations) AS cycles""",
)
def cyclomatic_number(spark, sf_dir):
    g = S.conversations(spark, sf_dir)
    return T.cyclomatic(g.entities, g.edges)


@query(
    "cycle_basis",
    """SELECT 'conv:' || conv_id AS component, CAST(3 AS INT) AS length, 'conv:' || conv_id || ',turn:' || conv_id || ':' || (turn - 1) || ',turn:' || conv_id || ':' || turn AS cycle FROM conversations WHERE turn > 0""",
)
def cycle_basis(spark, sf_dir):
    """A conversation's cycles are its pairs of neighbouring turns."""
    g = S.conversations(spark, sf_dir)
    return G.cycle_basis(g.entities, g.edges).select("component", "length", F.array_join("cycle", ",").alias("cycle"))


@query("betti", "SELECT 'conv:' || conv_id AS component, CAST(count(*) + 1 AS INT) AS nodes, CAST(1 AS INT) AS beta0, CAST(0 AS INT) AS beta1, CAST(0 AS DOUBLE) AS max_persistence FROM conversations GROUP BY conv_id")
def betti(spark, sf_dir):
    """A conversation is a fan of triangles: no hole outlives its birth."""
    g = S.conversations(spark, sf_dir)
    return G.betti(g.entities, g.edges, largest_only=False).drop("skipped")


@query(
    "dag_shape",
    f"""WITH {S.SUPPLY_SQL}, p AS (SELECT source_id AS id, count(DISTINCT target_id) AS p FROM supply_edges GROUP BY 1), c AS (SELECT target_id AS id, count(DISTINCT source_id) AS c FROM supply_edges GROUP BY 1),
    n AS (SELECT id, coalesce(p, 0) AS p, coalesce(c, 0) AS c FROM supply_nodes LEFT JOIN p USING (id) LEFT JOIN c USING (id))
    SELECT max(p) AS max_parents, max(c) AS max_children, round(count(*) FILTER (p > 1) / count(*), 6) AS multi_parent_share, count(*) FILTER (p = 0 AND c = 0) AS orphans FROM n""",
)
def dag_shape(spark, sf_dir):
    g = S.supply(spark, sf_dir)
    return T.dag_shape(g.edges, g.entities)


@query(
    "taxonomy_pairs",
    f"""WITH {S.TRADE_SQL}, p AS (SELECT c.entity_type AS child_type, p.entity_type AS parent_type, count(*) AS n FROM trade_edges LEFT JOIN trade_nodes c ON c.id = source_id LEFT JOIN trade_nodes p ON p.id = target_id GROUP BY 1, 2)
    SELECT CAST(row_number() OVER (ORDER BY n DESC, child_type, parent_type) AS INT) AS rank, child_type, parent_type, n, (SELECT count(*) FROM p) AS pairs FROM p QUALIFY rank <= 5""",
)
def taxonomy_pairs(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    return T.taxonomy_pairs(g.edges, g.entities)


@query(
    "degree_ccdf",
    f"""WITH {S.SUPPLY_SQL}, d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM supply_edges UNION ALL SELECT target_id FROM supply_edges) GROUP BY id),
    c AS (SELECT degree, count(*) AS n FROM d GROUP BY 1)
    SELECT degree, n, round(sum(n) OVER (ORDER BY degree DESC) / (SELECT count(*) FROM d), 6) AS ccdf FROM c""",
)
def degree_ccdf(spark, sf_dir):
    return T.degree_ccdf(S.supply(spark, sf_dir).edges)


@query(
    "prereq_tree",
    f"""WITH RECURSIVE {S.CONV_SQL}, f AS (SELECT * FROM conv_edges WHERE edge_type = 'follows'),
    t AS (SELECT id AS root, 0 AS depth, id, id AS path FROM conv_nodes WHERE entity_type = 'turn:assistant'
          UNION ALL SELECT root, depth + 1, target_id, path || '>' || target_id FROM t JOIN f ON source_id = t.id WHERE depth < 3)
    SELECT root, CAST(depth AS INT) AS depth, id, path FROM t""",
)
def prereq_tree(spark, sf_dir):
    g = S.conversations(spark, sf_dir)
    return T.prerequisite_tree(g.edges.where("edge_type = 'follows'"), g.entities.where("entity_type = 'turn:assistant'"))


@query(
    "candidate_gaps",
    f"""WITH RECURSIVE {S.WEB_SQL}, {WEB_COMPONENTS},
    s AS (SELECT component, count(*) AS size FROM web_placed GROUP BY 1 HAVING count(*) >= 3),
    held AS (SELECT DISTINCT component, size, entity_type FROM web_placed JOIN web_nodes USING (id) JOIN s USING (component)),
    sp AS (SELECT entity_type, count(*) AS n FROM held GROUP BY 1),
    told AS (SELECT entity_type, 1 / (1 + log2(n)) AS rarity FROM sp WHERE n <= 0.5 * (SELECT count(*) FROM s)),
    pairs AS (SELECT x.component AS a, y.component AS b, x.size AS size_a, y.size AS size_b, count(*) AS shared, sum(rarity) AS r FROM held x JOIN held y ON x.entity_type = y.entity_type AND x.component < y.component JOIN told ON told.entity_type = x.entity_type GROUP BY ALL)
    SELECT a, b, size_a, size_b, shared, round(r * sqrt(least(size_a, size_b)), 6) AS score FROM pairs ORDER BY score DESC, a, b LIMIT 10""",
)
def candidate_gaps(spark, sf_dir):
    g = S.web(spark, sf_dir)
    return G.candidate_gaps(g.entities.join(T.components_of(g.entities, g.edges), "id"))


@query(
    "seeded_gap_recall",
    f"""WITH RECURSIVE {S.WEB_SQL}, {WEB_COMPONENTS},
    seeds AS (SELECT 'page:' || page_id AS x, 'page:' || (page_id + 1) AS y FROM pages),
    known AS (SELECT least(p.component, q.component) AS a, greatest(p.component, q.component) AS b FROM seeds JOIN web_placed p ON p.id = x JOIN web_placed q ON q.id = y),
    top AS (SELECT component FROM web_placed GROUP BY 1 HAVING count(*) >= 6),
    rep AS (SELECT p.component AS a, q.component AS b FROM top p JOIN top q ON p.component < q.component)
    SELECT count(*) AS seeds, count(rep.a) AS recalled, (SELECT count(*) FROM rep) AS pairs, round(count(rep.a) / count(*), 6) AS recall,
           round(coalesce(count(rep.a) / nullif((SELECT count(*) FROM rep), 0), 0), 6) AS seed_precision,
           round(coalesce((SELECT count(*) FROM rep SEMI JOIN known ON rep.a = known.a AND rep.b = known.b) / nullif((SELECT count(*) FROM rep), 0), 0), 6) AS pair_precision
    FROM known LEFT JOIN rep ON rep.a = known.a AND rep.b = known.b""",
)
def seeded_gap_recall(spark, sf_dir):
    g = S.web(spark, sf_dir)
    placed = T.components_of(g.entities, g.edges)
    seeds = S.read(spark, sf_dir, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("x"), F.concat(F.lit("page:"), (F.col("page_id") + 1).cast("string")).alias("y"))
    top = placed.groupBy("component").count().where("count >= 6")
    reported = top.select(F.col("component").alias("a")).join(top.select(F.col("component").alias("b")), F.col("a") < F.col("b"))
    return G.seeded_recall(placed, seeds, reported)


@query(
    "fragmentation_two_ways",
    f"""WITH {S.DUP_SQL}, c AS (SELECT digest, count(*) AS n FROM dup_docs GROUP BY 1)
    SELECT (SELECT count(*) FROM c) AS components_all, (SELECT count(*) FROM c WHERE n > 1) AS components_linked, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS nodes_all, (SELECT CAST(sum(n) AS BIGINT) FROM c WHERE n > 1) AS nodes_linked""",
)
def fragmentation_two_ways(spark, sf_dir):
    g = S.duplicates(spark, sf_dir)
    sizes = T.components_of(g.entities, g.edges).groupBy("component").agg(F.count("*").alias("n"))
    linked = F.col("n") > 1
    return sizes.agg(F.count("*").alias("components_all"), F.count_if(linked).alias("components_linked"), F.sum("n").alias("nodes_all"), F.sum(F.when(linked, F.col("n"))).alias("nodes_linked"))

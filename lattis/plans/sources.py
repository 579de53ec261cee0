"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattis.plans.registry import query
from lattis.sources import graphs as S
from lattis.sources import sinks as K
from lattis.sources import stores as P


@query("graph_snapshot", f"WITH {S.TRADE_SQL} SELECT 'node' AS part, id, name, entity_type AS kind FROM trade_nodes UNION ALL SELECT 'edge', source_id, target_id, edge_type FROM trade_edges")
def graph_snapshot(spark, sf_dir):
    g = P.load("tables", spark, sf_dir=sf_dir)
    return g.entities.select(F.lit("node").alias("part"), "id", "name", F.col("entity_type").alias("kind")).union(g.edges.select(F.lit("edge"), "source_id", "target_id", "edge_type"))


@query("project_nodes", "SELECT 'documents:' || doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id AS VARCHAR) ELSE source END AS name, CASE WHEN doc_id % 3 = 0 THEN 'documents' ELSE lang END AS entity_type FROM documents")
def project_nodes(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).otherwise("").alias("title"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("category"))
    return P.project_nodes(d, "documents")


@query("project_edges", "SELECT 'orders:' || o_orderkey AS source_id, 'customer:' || o_custkey AS target_id, CASE WHEN o_orderstatus = 'P' THEN 'placed' ELSE o_orderstatus END AS edge_type, o_orderpriority AS created_by, CAST(NULL AS VARCHAR) AS source_pattern FROM orders")
def project_edges(spark, sf_dir):
    o = S.read(spark, sf_dir, "orders").withColumn("edge_type", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("")).withColumn("extraction_source", F.col("o_orderpriority"))
    return P.project_edges(o, "placed", "orders", "customer", "o_orderkey", "o_custkey")


_chunk_sql = """chunks AS (SELECT doc_id, lang AS wing, CASE WHEN doc_id % 13 = 0 THEN 'general' WHEN doc_id % 17 = 0 THEN '' ELSE 'r' || doc_id % 40 END AS room, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'hall_' || doc_id % 3 END AS hall, source AS file FROM documents),
named AS (SELECT * FROM chunks WHERE room NOT IN ('', 'general')), held AS (SELECT DISTINCT wing, room FROM named)"""


def _chunks(spark, sf_dir):
    k = F.col("doc_id")
    room = F.when(k % 13 == 0, "general").when(k % 17 == 0, "").otherwise(F.concat(F.lit("r"), (k % 40).cast("string")))
    hall = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("hall_"), (k % 3).cast("string")))
    return S.read(spark, sf_dir, "documents").select(k.alias("chunk_id"), F.col("lang").alias("wing"), room.alias("room"), hall.alias("hall"), F.col("source").alias("file"), k.alias("seq"))


@query(
    "scaffold_projection",
    f"""WITH {_chunk_sql}
    SELECT 'room:' || room AS a, CAST(NULL AS VARCHAR) AS b, 'room:' || coalesce(min(nullif(hall, '')), 'untyped') AS kind FROM named GROUP BY room
    UNION ALL SELECT DISTINCT 'wing:' || wing, NULL, 'wing' FROM chunks
    UNION ALL SELECT 'drawer:' || doc_id, NULL, 'drawer:' || coalesce(nullif(hall, ''), 'untyped') FROM chunks
    UNION ALL SELECT 'room:' || room, 'wing:' || wing, 'member_of' FROM held
    UNION ALL SELECT 'wing:' || x.wing, 'wing:' || y.wing, 'tunnel' FROM held x JOIN held y ON x.room = y.room AND x.wing < y.wing
    UNION ALL SELECT 'drawer:' || doc_id, 'room:' || room, 'filed_in' FROM named
    UNION ALL SELECT 'drawer:' || hub, 'drawer:' || doc_id, 'same_file' FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY file) AS hub FROM chunks) WHERE hub <> doc_id""",
)
def scaffold_projection(spark, sf_dir):
    g = P.scaffold(_chunks(spark, sf_dir))
    return g.entities.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("entity_type").alias("kind")).union(g.edges.select("source_id", "target_id", "edge_type"))


@query("tunnel_pairs", f"WITH {_chunk_sql} SELECT x.room AS room, x.wing AS a, y.wing AS b FROM held x JOIN held y ON x.room = y.room AND x.wing < y.wing")
def tunnel_pairs(spark, sf_dir):
    return P.tunnels(_chunks(spark, sf_dir).where("room not in ('', 'general')").select("wing", "room").distinct())


@query("endpoint_synthesis", f"WITH {S.TRADE_SQL}, n AS (SELECT * FROM trade_nodes WHERE entity_type <> 'nation') SELECT * FROM n UNION ALL SELECT DISTINCT id, split_part(id, ':', 2), 'kg:entity' FROM (SELECT source_id AS id FROM trade_edges UNION SELECT target_id FROM trade_edges) WHERE id NOT IN (SELECT id FROM n)")
def endpoint_synthesis(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    return P.synthesize_endpoints(g.entities.where("entity_type <> 'nation'"), g.edges)


@query(
    "native_contradictions",
    """WITH p AS (SELECT DISTINCT least('m' || doc_id, 'm' || (doc_id * 7) % n) AS a, greatest('m' || doc_id, 'm' || (doc_id * 7) % n) AS b FROM documents, (SELECT count(*) AS n FROM documents)),
    t AS (SELECT 'm' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN source WHEN doc_id % 3 = 0 THEN lang END AS said FROM documents)
    SELECT a, b, coalesce(said, a) AS claim_a FROM p LEFT JOIN t ON id = a""",
)
def native_contradictions(spark, sf_dir):
    """Each document against that of seven times its id, modulo their number."""
    d = S.read(spark, sf_dir, "documents")
    m = lambda c: F.concat(F.lit("m"), c.cast("string"))
    pairs = d.crossJoin(d.agg(F.count("*").alias("n"))).select(m(F.col("doc_id")).alias("x"), m(F.col("doc_id") * 7 % F.col("n")).alias("y"))
    texts = d.select(m(F.col("doc_id")).alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("text"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("description"))
    return P.native_contradictions(pairs, texts)


@query("dag_ingest", "SELECT 'edge' AS part, 'p' || p_partkey AS a, 'p' || (p_partkey - p_size) AS b FROM part WHERE p_partkey - p_size >= (SELECT min(p_partkey) FROM part) UNION ALL SELECT DISTINCT 'phantom', 'p' || (p_partkey - p_size), NULL FROM part WHERE p_partkey - p_size < (SELECT min(p_partkey) FROM part)")
def dag_ingest(spark, sf_dir):
    p = S.read(spark, sf_dir, "part")
    key = lambda c: F.concat(F.lit("p"), c.cast("string"))
    rows = p.select(key(F.col("p_partkey")).alias("ConceptID"), F.col("p_name").alias("ConceptLabel"), F.concat(key(F.col("p_partkey") - F.col("p_size")), F.lit("| ")).alias("Dependencies"), F.col("p_type").alias("TaxonomyID"))
    g, problems = P.dag(rows)
    return g.edges.select(F.lit("edge").alias("part"), F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(problems.select("problem", "id", F.lit(None).cast("string")))


@query("evidence_sessions", "SELECT conv_id, array_to_string(list_distinct(list_sort(list(CAST(turn // 2 AS INT)))), ',') AS sessions FROM conversations GROUP BY 1".replace("list_distinct(list_sort(", "list_sort(list_distinct("))
def evidence_sessions(spark, sf_dir):
    refs = F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.concat(F.lit("D"), F.floor(t / 2).cast("string"), F.lit(":"), t.cast("string")))
    c = S.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(refs.alias("refs"))
    return c.select("conv_id", F.array_join(P.evidence_sessions(F.concat("refs", F.array(F.lit("odd")))), ",").alias("sessions"))


@query("eav_pivot", "SELECT o_custkey AS id, max(o_orderpriority) FILTER (o_orderstatus = 'F') AS F, max(o_orderpriority) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY 1")
def eav_pivot(spark, sf_dir):
    o = S.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("key"), F.col("o_orderpriority").alias("value"))
    return P.eav_pivot(o, ("F", "O"))


@query("incremental_compile", "SELECT doc_id AS path, sha256(text) AS digest FROM documents WHERE doc_id % 4 <> 0")
def incremental_compile(spark, sf_dir):
    """Every fourth note is in the manifest unchanged, every fifth under another digest."""
    d = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("body"))
    digest = F.sha2(F.col("body").cast("binary"), 256)
    manifest = d.where("path % 4 = 0").select("path", digest.alias("digest")).unionByName(d.where("path % 5 = 0 and path % 4 <> 0").select("path", F.lit("old").alias("digest")))
    return K.changed_notes(d, manifest).select("path", "digest")


@query("cache_evict", "WITH l AS (SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 20 DAY FROM events)), k AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER () AS n FROM l) SELECT event_id AS key FROM k WHERE n <= 500 OR r <= 400")
def cache_evict(spark, sf_dir):
    e = S.read(spark, sf_dir, "events").select(F.col("event_id").alias("key"), "ts")
    return K.evict(e, "key", "ts", days=20, most=500).select("key")


@query("review_surface")
def review_surface(spark, sf_dir):
    """Numbers with their context and quotes, for a reader (look-around: checked by unit tests)."""
    return K.review_surface(S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("body")))


def _notes(spark, sf_dir):
    """A note a document: it declares its source as an entity and its language as an edge."""
    d = S.read(spark, sf_dir, "documents")
    key = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    head = F.concat(F.lit("---\nentities:\n  - {id: "), "source", F.lit(", type: source, canonical: note "), key, F.lit("}\nedges:\n  - {from: "), "source", F.lit(", type: writes, to: "), "lang", F.lit("}\n  - {from: "), "source", F.lit(", to: none}\n---\n"))
    return d.select(key.alias("path"), F.concat(head, "text").alias("text"))


@query("vault_graph", "SELECT 'entity' AS part, source AS a, 'note ' || lpad(CAST(min(doc_id) AS VARCHAR), 8, '0') AS b, 'source' AS kind FROM documents GROUP BY source UNION ALL SELECT 'edge', source, lang, 'writes' FROM documents")
def vault_graph(spark, sf_dir):
    g = P.vault(_notes(spark, sf_dir))
    return g.entities.select(F.lit("entity").alias("part"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("entity_type").alias("kind")).union(g.edges.select(F.lit("edge"), "source_id", "target_id", "edge_type"))


@query("source_bodies", "SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path, md5(text) AS body_md5 FROM documents")
def source_bodies(spark, sf_dir):
    return P.source_bodies(_notes(spark, sf_dir)).select("path", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("lme_questions", "SELECT 'q' || conv_id || CASE WHEN conv_id % 4 = 0 THEN '_abs' ELSE '' END AS question_id, CASE WHEN conv_id % 2 = 0 THEN '2' ELSE '6' END AS category, conv_id % 4 = 0 AS abstention, 's' || turn AS session_id, md5(text) AS turn_md5 FROM conversations")
def lme_questions(spark, sf_dir):
    """A conversation's turns as the sessions of one question."""
    c = S.read(spark, sf_dir, "conversations")
    t = F.array_sort(F.collect_list(F.struct("turn", "text")))
    k = F.col("conv_id")
    raw = c.groupBy("conv_id").agg(t.alias("t")).select(
        F.concat(F.lit("q"), k.cast("string"), F.when(k % 4 == 0, "_abs").otherwise("")).alias("question_id"),
        F.when(k % 2 == 0, "multi-session").otherwise("temporal-reasoning").alias("question_type"),
        F.transform("t", lambda x: F.concat(F.lit("s"), x["turn"].cast("string"))).alias("haystack_session_ids"),
        F.transform("t", lambda x: x["turn"].cast("string")).alias("haystack_dates"),
        F.transform("t", lambda x: F.array(x["text"])).alias("haystack_sessions"),
    )
    return P.haystack_questions(raw).select("question_id", "category", "abstention", "session_id", F.md5(F.get("turns", F.lit(0)).cast("binary")).alias("turn_md5"))


_kg_json = "CASE WHEN s_suppkey % 3 = 0 THEN '{\"nation\": \"' || s_nationkey || '\"}' WHEN s_suppkey % 3 = 1 THEN 'not json {' END"


@query(
    "knowledge_graph",
    """SELECT 'node' AS part, 'kg:' || s_suppkey AS a, s_name AS b, CASE WHEN s_suppkey % 5 = 0 THEN 'kg:unknown' ELSE 'kg:n' || s_nationkey END AS kind, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey::VARCHAR END AS detail, 'kg_entity' AS came_from FROM supplier
    UNION ALL SELECT 'edge', 'kg:' || o_custkey, 'kg:' || o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'kg_related' ELSE o_orderstatus END, o_orderpriority, 'kg_triple' FROM orders""",
)
def knowledge_graph(spark, sf_dir):
    """Suppliers as entities, a third with properties that aren't JSON, and orders as triples."""
    kind = F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    entities = S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), kind.alias("type"), F.expr(_kg_json).alias("properties"))
    o = S.read(spark, sf_dir, "orders")
    triples = o.select(F.col("o_custkey").alias("subject"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).otherwise("").alias("predicate"), F.col("o_orderkey").alias("object"), F.col("o_orderpriority").alias("source_file"))
    g = P.knowledge_graph(entities, triples)
    p = F.col("properties")
    nodes = g.entities.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("entity_type").alias("kind"), p["nation"].alias("detail"), p["_table"].alias("came_from"))
    return nodes.unionByName(g.edges.select(F.lit("edge").alias("part"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("edge_type").alias("kind"), p["source_file"].alias("detail"), p["_table"].alias("came_from")))

"""Queries over readers, written inputs and outputs, and defect injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattis.functions.models import count_tokens
from lattis.operators import relations as R
from lattis.operators import topology as T
from lattis.plans.registry import query
from lattis.schema import Graph
from lattis.session import new_shared_path
from lattis.sources import corpora as C
from lattis.sources import graphs as S
from lattis.sources import paged
from lattis.sources import sinks as K
from lattis.sources import stores as P


def _memories(spark, sf_dir):
    """Where the documents are written as flat memories (SNK6)."""
    path = new_shared_path(spark, "memories")
    K.pinned_context(S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("category")), path)
    return path


@query("memory_snapshot", "SELECT 'memory:' || doc_id AS id, coalesce(nullif(source, ''), doc_id::VARCHAR) AS name, coalesce(nullif(lang, ''), 'memory') AS entity_type FROM documents")
def memory_snapshot(spark, sf_dir):
    """Flat memories are nodes without edges (SRC15)."""
    return P.load("memories", spark, path=_memories(spark, sf_dir)).entities


@query("source_sizes", f"WITH {S.TRADE_SQL} SELECT 'flat' AS alias, 0 AS nodes, 0 AS edges UNION ALL SELECT 'memories', (SELECT count(*) FROM documents), 0 UNION ALL SELECT 'tables', (SELECT count(*) FROM trade_nodes), (SELECT count(*) FROM trade_edges)")
def source_sizes(spark, sf_dir):
    """Each registered source's snapshot, by alias; options that are None are left out (SRC2, SRC16)."""
    found = {"flat": P.load("flat", spark, path=None), "memories": P.load("memories", spark, path=_memories(spark, sf_dir)), "tables": P.load("tables", spark, sf_dir=sf_dir, graph=None)}
    rows = [(a, g.entities.count(), g.edges.count()) for a, g in found.items()]
    return spark.createDataFrame(rows, "alias string, nodes long, edges long")


@query("project_nodes_by_row", "SELECT 'notes:' || doc_id AS id, coalesce(CASE WHEN doc_id % 2 = 0 THEN nullif(source, '') END, CASE WHEN doc_id % 3 = 0 THEN nullif(lang, '') END, doc_id::VARCHAR) AS name, CASE WHEN doc_id % 5 = 0 THEN 'c' || doc_id % 4 ELSE 'notes' END AS entity_type FROM documents")
def project_nodes_by_row(spark, sf_dir):
    """The first candidate column that isn't empty in a row (SRC6)."""
    k = F.col("doc_id")
    d = S.read(spark, sf_dir, "documents").select(k.alias("id"), F.when(k % 2 == 0, F.col("source")).otherwise("").alias("name"), F.when(k % 3 == 0, F.col("lang")).alias("title"), F.lit("").alias("type"), F.when(k % 5 == 0, F.concat(F.lit("c"), (k % 4).cast("string"))).alias("category"))
    return P.project_nodes(d, "notes", row_wise=True)


@query("table_selection", "SELECT p AS purpose, t AS table_name FROM (VALUES ('nodes'), ('edges'), ('discovered')) a(p), (SELECT 'region' AS t, (SELECT count(*) FROM region) AS n UNION ALL SELECT 'nation', (SELECT count(*) FROM nation) UNION ALL SELECT 'links', 0) WHERE n > 0 OR p = 'nodes'")
def table_selection(spark, sf_dir):
    """Which tables are read; operational ones never (SRC5)."""
    sizes = {t: S.read(spark, sf_dir, t).count() for t in ("region", "nation")} | {"links": 0, "cache": S.read(spark, sf_dir, "events").count()}
    chosen = {"nodes": P.select_tables(sizes), "edges": P.select_tables(sizes, edges=True), "discovered": P.select_tables(sizes, auto_discover=True)}
    return spark.createDataFrame([(p, t) for p, ts in chosen.items() for t in ts], "purpose string, table_name string")


@query("listed_graph", "WITH e AS (SELECT DISTINCT 'p:' || l_partkey AS a, 's:' || l_suppkey AS b, l_returnflag AS kind FROM lineitem), n AS (SELECT 's:' || s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0) SELECT 'edge' AS part, a, b, kind FROM e UNION ALL SELECT 'node', id, name, 'supplier' FROM n UNION ALL SELECT DISTINCT 'node', id, split_part(id, ':', 2), 'kg:entity' FROM (SELECT a AS id FROM e UNION SELECT b FROM e) WHERE id NOT IN (SELECT id FROM n)")
def listed_graph(spark, sf_dir):
    """Relations listed again and again count once; ends that aren't listed are made up (SRC12)."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    own = S.read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(key("s:", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type"))
    listed = S.read(spark, sf_dir, "lineitem").select(key("p:", "l_partkey").alias("source_id"), F.col("l_returnflag").alias("edge_type"), key("s:", "l_suppkey").alias("target_id"))
    g = C.listed_graph(own, listed, S.trade(spark, sf_dir))
    return g.edges.select(F.lit("edge").alias("part"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("edge_type").alias("kind")).union(g.entities.select(F.lit("node"), "id", "name", "entity_type"))


@query("cached_statistics", f"WITH {S.TRADE_SQL} SELECT count(*) AS nodes, true AS absent FROM trade_nodes")
def cached_statistics(spark, sf_dir):
    """Statistics are read where they were written, and None elsewhere (SRC14)."""
    path = new_shared_path(spark, "statistics")
    S.trade(spark, sf_dir).entities.agg(F.count("*").alias("nodes")).write.parquet(path)
    absent = P.cached_statistics(spark, path + "-none", "nodes") is None
    return P.cached_statistics(spark, path, "nodes").withColumn("absent", F.lit(absent))


@query("run_files", "SELECT event_id, user_id, value FROM events UNION ALL SELECT NULL, NULL, NULL FROM events WHERE event_id % 50 = 0")
def run_files(spark, sf_dir):
    """Events as JSON lines, some followed by a blank line and some by a broken one (SRC26)."""
    path = new_shared_path(spark, "runs")
    line = F.concat(F.to_json(F.struct("event_id", "user_id", "value")), F.when(F.col("event_id") % 10 == 0, "\n").otherwise(""), F.when(F.col("event_id") % 50 == 0, "\n{broken").otherwise(""))
    S.read(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return P.jsonl(spark, path, "event_id long, user_id long, value double")


@query("retrieve_results", "SELECT event_type AS adapter, event_id AS id, value AS recall FROM events UNION ALL SELECT event_type, -event_id, NULL FROM events")
def retrieve_results(spark, sf_dir):
    """One row a question of each result file (SRC27)."""
    one = lambda k, r: F.struct(k.alias("id"), r.cast("double").alias("recall"))
    raw = S.read(spark, sf_dir, "events").select(F.col("event_type").alias("adapter"), F.array(one(F.col("event_id"), F.col("value")), one(-F.col("event_id"), F.lit(None))).alias("questions"))
    return P.retrieve_results(raw)


@query("paragraph_questions", "SELECT doc_id::VARCHAR AS id, source AS title, md5(coalesce(text, '') || '!') AS text_md5, true AS gold FROM documents UNION ALL SELECT doc_id::VARCHAR, 'other', md5(coalesce(lang, '')), false FROM documents")
def paragraph_questions(spark, sf_dir):
    """Two paragraphs a question; a malformed supporting fact is skipped (SRC24)."""
    one = lambda title, *parts: F.struct(title.alias("title"), F.array(*parts).alias("sentences"))
    d = S.read(spark, sf_dir, "documents")
    raw = d.select(F.col("doc_id").cast("string").alias("_id"), F.array(F.array("source", F.lit("0")), F.array(F.lit("other"))).alias("supporting_facts"), F.array(one(F.col("source"), F.col("text"), F.lit("!")), one(F.lit("other"), F.col("lang"))).alias("context"))
    return P.paragraph_questions(raw).select("id", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"), "gold")


_report = "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events"


def _health(spark, sf_dir):
    return S.read(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("report_file", _report)
def report_file(spark, sf_dir):
    """A report as it is read back from its JSON record (SNK1)."""
    report, path = _health(spark, sf_dir), new_shared_path(spark, "report")
    K.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("scorecard", f"WITH r AS ({_report}) SELECT 0 AS i, 'events' AS line UNION ALL SELECT 1, '======' UNION ALL SELECT 2, '  ' || rpad('n', 24, ' ') || ' ' || n FROM r UNION ALL SELECT 3, '  ' || rpad('errors', 24, ' ') || ' ' || errors FROM r")
def scorecard(spark, sf_dir):
    """A report as text, a row a line (SNK2)."""
    return spark.createDataFrame(list(enumerate(K.scorecard(_health(spark, sf_dir), "events").split("\n"))), "i int, line string")


_spellings = ["supersedes", "Superseded-By", "SUPERSEDE", " replaces ", "replaced by", "contradicts", "contradicted_by", "Contradict", "conflicts-with", "obsoletes", "disputes", ""]


@query("predicate_classes", "SELECT o_orderkey, o_orderkey % 12 <= 4 AS supersedes, o_orderkey % 12 BETWEEN 5 AND 8 AS contradicts FROM orders")
def predicate_classes(spark, sf_dir):
    """Every spelling of the two relations, and some that are neither (FLT2)."""
    kind = F.element_at(F.array(*map(F.lit, _spellings)), (F.col("o_orderkey") % 12 + 1).cast("int"))
    return S.read(spark, sf_dir, "orders").select("o_orderkey", R.is_supersedes(kind).alias("supersedes"), R.is_contradicts(kind).alias("contradicts"))


@query("modularity_no_edges", "SELECT 0 AS communities, 0.0::DOUBLE AS modularity")
def modularity_no_edges(spark, sf_dir):
    """Without edges the modularity is 0 (TOP11)."""
    g = S.trade(spark, sf_dir)
    return T.modularity(g.edges.where("false"), g.entities.select("id", F.col("entity_type").alias("community")))


@query("token_counts", "SELECT doc_id, length(coalesce(text, '')) // 4 AS tokens FROM documents")
def token_counts(spark, sf_dir):
    """The estimate that needs no vocabulary (RET28)."""
    return S.read(spark, sf_dir, "documents").select("doc_id", count_tokens(F.col("text")).alias("tokens"))


_drawn = "SELECT *, row_number() OVER (ORDER BY md5('42|' || id), id) AS r FROM trade_nodes"


@query("inject_orphans", "SELECT '__orphan_' || i AS id, 'orphan ' || i AS name, 'orphan' AS entity_type FROM range(5) t(i)")
def inject_orphans(spark, sf_dir):
    return R.inject_orphans(spark, 5)


@query("inject_broken_refs", f"WITH {S.TRADE_SQL}, d AS ({_drawn}) SELECT id AS source_id, '__absent_' || id AS target_id, 'refers_to' AS edge_type FROM d WHERE r <= 4")
def inject_broken_refs(spark, sf_dir):
    return R.inject_broken_refs(S.trade(spark, sf_dir).entities, 4)


@query("inject_phantoms", f"WITH {S.TRADE_SQL}, d AS ({_drawn}) SELECT x.id AS source_id, y.id AS target_id, 'phantom_link' AS edge_type, '__empty_note' AS source_note FROM d x JOIN d y ON y.r = x.r + 1 WHERE x.r <= 4")
def inject_phantoms(spark, sf_dir):
    return R.inject_phantoms(S.trade(spark, sf_dir).entities, 4)


@query("inject_monoculture", f"WITH {S.TRADE_SQL}, c AS (SELECT edge_type, count(*) AS n FROM trade_edges GROUP BY 1) SELECT source_id, target_id, edge_type FROM trade_edges WHERE edge_type = (SELECT last(edge_type ORDER BY n, edge_type) FROM c) ORDER BY md5(source_id || '|' || target_id), source_id, target_id LIMIT 20")
def inject_monoculture(spark, sf_dir):
    return R.inject_monoculture(S.trade(spark, sf_dir).edges, 20).select("source_id", "target_id", "edge_type")


@query(
    "paged_graph",
    f"""WITH {S.TRADE_SQL}, listed AS (SELECT * FROM trade_nodes WHERE entity_type = 'nation'),
    ends AS (SELECT source_id AS id FROM trade_edges UNION SELECT target_id FROM trade_edges)
    SELECT id, name, entity_type FROM listed UNION ALL SELECT id, regexp_replace(id, '^[^:]*:', ''), 'kg:entity' FROM ends WHERE id NOT IN (SELECT id FROM listed)""",
)
def paged_graph(spark, sf_dir):
    """Nations and all relations as a server lists them, a page a task; ends that aren't listed are made up."""
    g = S.trade(spark, sf_dir)
    listed = paged.folder_pages(g.entities, "entities").where("entity_type = 'nation'")
    return C.listed_graph(listed, paged.folder_pages(g.edges, "relations"), Graph(g.entities, g.edges)).entities


@query(
    "dialogue_sessions",
    """SELECT CAST(conv_id AS VARCHAR) AS sample_id, CAST(turn // 2 + 1 AS INT) AS session, CASE WHEN conv_id % 2 = 0 THEN 'day ' || (turn // 2 + 1) END AS date, count(*) AS turns,
           md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS said FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY conv_id, turn // 2""",
)
def dialogue_sessions(spark, sf_dir):
    """Conversations as JSON with a key a session, read back session by session (SRC23); every second one has no dates."""
    turns = S.read(spark, sf_dir, "conversations").where("role is not null and text is not null").withColumn("k", F.expr("cast(turn div 2 + 1 as string)"))
    line = F.struct("turn", F.col("role").alias("speaker"), F.concat_ws(":", "conv_id", "turn").alias("dia_id"), "text")
    held = turns.groupBy("conv_id", "k").agg(F.to_json(F.array_sort(F.collect_list(line))).alias("body"))
    keys = held.select("conv_id", F.concat(F.lit("session_"), "k").alias("key"), "body").unionByName(
        held.where("conv_id % 2 = 0").select("conv_id", F.concat(F.lit("session_"), "k", F.lit("_date_time")).alias("key"), F.concat(F.lit("day "), "k").alias("body"))
    )
    raw = keys.groupBy(F.col("conv_id").cast("string").alias("sample_id")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "body")))).alias("conversation"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["speaker"], F.lit(":"), t["text"])), "\n")
    return C.dialogue_sessions(raw).select("sample_id", "session", "date", F.size("turns").cast("long").alias("turns"), F.md5(said.cast("binary")).alias("said"))


@query(
    "probing_sessions",
    """SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 'recall' AS category, CAST(0 AS INT) AS i, md5(max(text)) AS question, array_to_string(list_sort(list(DISTINCT turn // 2 + 1)), ',') AS sessions
       FROM conversations WHERE text IS NOT NULL AND role = 'user' GROUP BY conv_id""",
)
def probing_sessions(spark, sf_dir):
    """A question on each conversation's user turns, written as a dictionary's text, and the sessions that hold them (SRC25)."""
    turns = S.read(spark, sf_dir, "conversations").where("text is not null and role = 'user'")
    ids = F.array_join(F.array_sort(F.collect_set("turn")), ", ")
    text = F.concat(F.lit("{'recall': [{'question': '"), F.md5(F.max("text").cast("binary")), F.lit("', 'source_chat_ids': {'a': ["), ids, F.lit("]}}], 'none': None}"))
    raw = turns.groupBy(F.col("conv_id").cast("string").alias("conversation_id")).agg(text.alias("probing_questions"))
    asked = C.probing_questions(raw)
    sessions = turns.groupBy(F.col("conv_id").cast("string").alias("conversation_id"), F.expr("turn div 2 + 1").alias("session")).agg(F.collect_set("turn").alias("turn_ids"))
    found = C.sessions_of_sources(asked, sessions)
    return asked.join(found, ["conversation_id", "category", "i"]).select("conversation_id", "category", "i", "question", F.array_join("sessions", ",").alias("sessions"))

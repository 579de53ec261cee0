"""Queries over retrieval: benchmark items ask, documents answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattis.operators import modes as M
from lattis.operators import retrieval as R
from lattis.operators.topology import khop
from lattis.plans.registry import query
from lattis.sources import graphs as S

_tok = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_q = f"q AS (SELECT item_id AS qid, text, {_tok.format('text')} AS t FROM benchmark)"
_d = f"d AS (SELECT doc_id AS id, text, {_tok.format('text')} AS t FROM documents)"


def _queries(spark, sf_dir):
    return S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _docs(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query(
    "vector_topk",
    """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT q.id AS qid, e.id, round(list_cosine_similarity(q.v, e.v), 12) AS score FROM e q JOIN e ON q.id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
    SELECT qid, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def vector_topk(spark, sf_dir):
    """Queries are the vectors whose id is divisible by 100, against all."""
    e = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    found = R.vector_topk(e.where("id % 100 = 0").select(F.col("id").alias("qid"), "v"), e, 5)
    return found.withColumn("score", F.round("score", 6))


@query(
    "routed_topk",
    """WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 3),
    s AS (SELECT q.id AS qid, e.id, round(list_cosine_similarity(q.v, e.v), 12) AS score FROM e q JOIN e ON q.id % 100 < 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
    SELECT qid, CAST(rank AS INT) AS rank, id FROM r WHERE rank <= 3""",
)
def routed_topk(spark, sf_dir):
    """A room's vectors only: the filter reaches the scan."""
    e = S.read(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return R.vector_topk(e.where("id % 100 < 10").select(F.col("id").alias("qid"), "v"), e, 3).drop("score")


@query(
    "flat_token_overlap",
    f"""WITH {_q}, {_d}, i AS (SELECT id, len(t) AS n, unnest(t) AS token FROM d), a AS (SELECT DISTINCT qid, unnest(t) AS token FROM q),
    s AS (SELECT qid, id, round(count(*) / sqrt(n), 9) AS score FROM i JOIN a USING (token) GROUP BY qid, id, n),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
    SELECT qid, CAST(rank AS INT) AS rank, id, score FROM r WHERE rank <= 5""",
)
def flat_token_overlap(spark, sf_dir):
    return R.token_overlap(_queries(spark, sf_dir), _docs(spark, sf_dir))


@query(
    "idf_token_retrieval",
    f"""WITH {_q}, {_d}, i AS (SELECT DISTINCT id, unnest(t) AS token FROM d), df AS (SELECT token, count(*) AS df FROM i GROUP BY 1), a AS (SELECT qid, unnest(t) AS token FROM q),
    s AS (SELECT qid, id, round(sum(ln(((SELECT count(*) FROM d) + 1) / (df + 0.5))), 6) AS score FROM a JOIN df USING (token) JOIN i USING (token) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
    SELECT qid, CAST(rank AS INT) AS rank, id, score FROM r WHERE rank <= 5""",
)
def idf_token_retrieval(spark, sf_dir):
    return R.idf_tokens(_queries(spark, sf_dir), _docs(spark, sf_dir))


def _entities_sql(text: str) -> str:
    """The seven kinds of entities, written for DuckDB's regular expressions.

    These take accented letters for no part of a word, so such a letter is
    first made one that the pattern doesn't hold but that is part of a word.
    """
    month = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
    names = """list_filter(regexp_extract_all({0}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{0,3}}\\b'), lambda x: length(x) >= 3 AND NOT list_contains(string_split(
        'The This That These Those There Their They What When Where Why How Who Which Hello Hi Hey Thanks Thank Please Sure Okay Yes No Maybe Some Any All Each Every User Assistant Bot AI Human '
        || 'Could Would Should Will Shall May Might Have Has Had Was Were Been Being Get Got Make Made Take Took Give Gave Know Knew Think Thought See Saw Say Said I You He She It We Me Him Her Us Them '
        || 'Mr Ms Mrs Dr Like Want Need Use Used Try Tried', ' '), x))"""
    dates = f"regexp_extract_all({{0}}, '(?i)\\b(?:\\d{{{{4}}}}-\\d{{{{1,2}}}}-\\d{{{{1,2}}}}|\\d{{{{4}}}}|{month}\\s+\\d{{{{1,2}}}}|\\d{{{{1,2}}}}\\s+{month}|\\d+\\s+(?:year|month|week|day|hour|minute)s?\\s+ago)\\b')"
    numbers = "list_transform(regexp_extract_all({0}, '(?i)\\b\\d+(?:\\.\\d+)?\\s*(?:km|mi|kg|lb|cm|mm|ft|in|m|g|mg|hour|min|sec|year|month|day|week|%|usd|eur|gbp|tl|jpy|inr|cny)\\b'), lambda x: replace(x, ' ', ''))"
    money = "regexp_extract_all({0}, '\\$\\d+(?:,\\d{{3}})*(?:\\.\\d+)?')"
    address = "regexp_extract_all({0}, 'https?://\\S+|\\b\\w+@\\w+\\.\\w+')"
    words = "list_filter(regexp_extract_all({0}, '\\b(?:[A-Z][a-z]+(?:[A-Z][a-z]+)+|[a-z]+_[a-z]+(?:_[a-z]+)*|[a-z]+-[a-z]+(?:-[a-z]+)*)\\b'), lambda x: length(x) >= 4)"
    quotes = """list_filter(list_transform(regexp_extract_all({0}, '"[^"]{{3,80}}"|\\x27[^\\x27]{{3,80}}\\x27'), lambda x: regexp_replace(x[2:-2], '^\\s+|\\s+$', '', 'g')), lambda x: length(x) BETWEEN 8 AND 80)"""
    plain = lambda sql, by: sql.format(f"regexp_replace({text}, '[À-ÖØ-öø-ɏ]', '{by}', 'g')")
    kinds = (plain(names, "_"), plain(dates, "_"), plain(numbers, "_"), money.format(text), address.format(text), plain(words, "0"), quotes.format(text))
    return f"list_distinct(list_transform(flatten([{', '.join(kinds)}]), lambda x: lower(x)))"


#: What is said of a benchmark item and of every document besides: each kind of entity, varied by the id.
_spoken = {
    "documents": "coalesce(text, '') || ' Ada Lovelace' || ' met Dr Rosa on 2024-03-' || doc_id % 28 || ', 12 March, ' || doc_id % 7 || ' days ago; 3.5 km, $1,20' || doc_id % 9 || ' at https://h' || doc_id % 50 || '.org/a b' || doc_id % 30 || '@c.org, a GraphStore, snake_case, kebab-case-' || 'x \"a quoted text ' || doc_id % 20 || '\"'",
    "benchmark": "text || ' Rosa Luxem and Ada Lovelace on 2024-03-' || item_id % 28 || ', ' || item_id % 7 || ' days ago; 3.5 km, $1,20' || item_id % 9 || ' at https://h' || item_id || '.org/a b' || item_id % 30 || '@c.org, GraphStore, kebab-case-x \"a quoted text ' || item_id % 20 || '\"'",
}


@query(
    "idf_entity_retrieval",
    f"""WITH i AS (SELECT doc_id AS id, unnest({_entities_sql("t")}) AS e FROM (SELECT doc_id, {_spoken["documents"]} AS t FROM documents)),
    a AS (SELECT item_id AS qid, unnest({_entities_sql("t")}) AS e FROM (SELECT item_id, {_spoken["benchmark"]} AS t FROM benchmark)),
    df AS (SELECT e, count(*) AS df FROM i GROUP BY 1),
    s AS (SELECT qid, id, count(*) AS shared, round(sum(ln(((SELECT count(*) FROM documents) + 1) / df)), 6) AS score FROM a JOIN df USING (e) JOIN i USING (e) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, shared DESC, id) AS rank FROM s)
    SELECT qid, CAST(rank AS INT) AS rank, id, shared, score FROM r WHERE rank <= 10""",
)
def idf_entity_retrieval(spark, sf_dir):
    asked = S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.expr(_spoken["benchmark"]).alias("text"))
    return R.idf_entities(asked, S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(_spoken["documents"]).alias("text")))


@query(
    "entity_lookup",
    f"""WITH n AS (SELECT DISTINCT p_partkey AS id, unnest(list_filter({_tok.format('p_name')}, lambda t: length(t) > 2)) AS token FROM part), a AS (SELECT DISTINCT s_suppkey AS qid, unnest(list_filter({_tok.format("s_name || ' ' || (SELECT min(p_name) FROM part WHERE p_partkey = s_suppkey)")}, lambda t: length(t) > 2)) AS token FROM supplier),
    s AS (SELECT qid, id, count(*) AS score FROM a JOIN n USING (token) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
    SELECT qid, CAST(rank AS INT) AS rank, id, score FROM r WHERE rank <= 5""",
)
def entity_lookup(spark, sf_dir):
    part = S.read(spark, sf_dir, "part")
    asked = S.read(spark, sf_dir, "supplier").join(part.select(F.col("p_partkey").alias("s_suppkey"), "p_name"), "s_suppkey")
    return R.entity_lookup(asked.select(F.col("s_suppkey").cast("long").alias("qid"), F.concat_ws(" ", "s_name", "p_name").alias("text")), part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query(
    "infer_room",
    f"""WITH rooms AS (SELECT DISTINCT lower(replace(p_name, ' ', '_')) AS room FROM part), rt AS (SELECT DISTINCT room, unnest(list_filter(regexp_split_to_array(room, '[_-]'), lambda t: length(t) > 2)) AS token FROM rooms),
    a AS (SELECT DISTINCT p_partkey AS qid, unnest(list_filter({_tok.format('p_name')}, lambda t: length(t) > 3)) AS token FROM part),
    s AS (SELECT qid, room, count(*) AS score FROM a JOIN rt USING (token) GROUP BY 1, 2)
    SELECT qid, first(room ORDER BY score DESC, room) AS room, max(score) AS score FROM s GROUP BY 1""",
)
def infer_room(spark, sf_dir):
    part = S.read(spark, sf_dir, "part")
    return R.infer_room(part.select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("text")), part.select(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("room")).distinct())


@query(
    "match_target",
    f"""WITH l AS (SELECT DISTINCT p_name AS label, {_tok.format('p_name')} AS lt FROM part), a AS (SELECT p_partkey AS qid, CASE WHEN p_partkey % 2 = 0 THEN 'what of ' || upper(p_name) || ' then' ELSE split_part(p_name, ' ', 2) || ' zzz' END AS text FROM part),
    inside AS (SELECT qid, first(label ORDER BY length(label) DESC, label) AS label, 'substring' AS how FROM a JOIN l ON contains(lower(text), lower(label)) GROUP BY 1),
    tok AS (SELECT DISTINCT qid, unnest({_tok.format('text')}) AS token FROM a WHERE qid NOT IN (SELECT qid FROM inside)), lab AS (SELECT DISTINCT label, unnest(lt) AS token FROM l),
    s AS (SELECT qid, label, count(*) AS n FROM tok JOIN lab USING (token) GROUP BY 1, 2)
    SELECT * FROM inside UNION ALL SELECT qid, first(label ORDER BY n DESC, label), 'overlap' FROM s GROUP BY 1""",
)
def match_target(spark, sf_dir):
    part = S.read(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("what of "), F.upper("p_name"), F.lit(" then"))).otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" zzz")))
    return R.match_target(part.select(F.col("p_partkey").alias("qid"), text.alias("text")), part.select(F.col("p_name").alias("label")).distinct())


_hits = f"""{_q}, {_d}, i AS (SELECT id, len(t) AS n, unnest(t) AS token FROM d), a AS (SELECT DISTINCT qid, unnest(t) AS token FROM q),
    s AS (SELECT qid, id, round(count(*) / sqrt(n), 9) AS score FROM i JOIN a USING (token) GROUP BY qid, id, n),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 3),
    ctx AS (SELECT qid, string_agg('[' || rank || '] ' || id || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN d USING (id) GROUP BY 1)"""


def _contexts(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return R.render_context(R.token_overlap(_queries(spark, sf_dir), docs, 3), docs)


@query("context_render", f"WITH {_hits} SELECT qid, md5(context) AS context_md5, length(context) AS chars, length(context) // 4 AS tokens FROM ctx")
def context_render(spark, sf_dir):
    c = _contexts(spark, sf_dir)
    return c.select("qid", F.md5(F.col("context").cast("binary")).alias("context_md5"), F.length("context").cast("long").alias("chars"), F.floor(F.length("context") / 4).cast("long").alias("tokens"))


@query(
    "substring_recall",
    f"""WITH {_hits}, e AS (SELECT qid, text, [text, text[1:30], 'nowhere at all'] AS expected FROM q), m AS (SELECT e.qid, expected, len(list_filter(expected, lambda x: contains(coalesce(context, ''), x))) AS m FROM e LEFT JOIN ctx ON ctx.qid = e.qid)
    SELECT qid, CAST(3 AS INT) AS n_expected, CAST(m AS INT) AS matched, round(m / 3, 6) AS recall, m > 0 AS hit FROM m""",
)
def substring_recall(spark, sf_dir):
    asked = _queries(spark, sf_dir).select("qid", F.array("text", F.substring("text", 1, 30), F.lit("nowhere at all")).alias("expected"))
    return R.contains_recall(asked, _contexts(spark, sf_dir))


@query(
    "semantic_mode",
    f"""WITH {_q}, {_d}, i AS (SELECT DISTINCT id, unnest(list_filter(t, lambda x: length(x) > 3)) AS token FROM d), a AS (SELECT DISTINCT qid, unnest(list_filter(t, lambda x: length(x) > 3)) AS token FROM q),
    s AS (SELECT qid, id, count(*) AS score FROM i JOIN a USING (token) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
    SELECT qid, CAST(rank AS INT) AS rank, id, score FROM r WHERE rank <= 200""",
)
def semantic_mode(spark, sf_dir):
    return R.search_terms(_queries(spark, sf_dir), _docs(spark, sf_dir))


@query(
    "hybrid_mode",
    f"""WITH {S.CONV_SQL}, s AS (SELECT conv_id AS qid, 'turn:' || conv_id || ':' || turn AS id FROM conversations WHERE role = 'user'),
    b AS (SELECT source_id AS u, target_id AS v FROM conv_edges UNION SELECT target_id, source_id FROM conv_edges)
    SELECT qid, id, CAST(min(depth) AS INT) AS depth FROM (SELECT qid, id, 0 AS depth FROM s UNION ALL SELECT qid, v, 1 FROM s JOIN b ON id = u) GROUP BY 1, 2""",
)
def hybrid_mode(spark, sf_dir):
    turns = S.read(spark, sf_dir, "conversations").where("role = 'user'")
    seeds = turns.select(F.col("conv_id").alias("qid"), F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"))
    return R.one_hop(seeds, S.conversations(spark, sf_dir).edges)


#: Questions on every hundredth customer: with its nation, which an edge joins to it; with its region, which none does; and on its segment, which no name holds.
_store_sql = f"""{S.TRADE_SQL},
nodes AS (SELECT *, entity_type AS description FROM trade_nodes),
q AS (
    SELECT c_custkey AS qid, CASE c_custkey % 300 WHEN 0 THEN c_name || ' ' || n_name WHEN 100 THEN c_name || ' ' || r_name ELSE 'about ' || c_mktsegment END AS text
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey % 100 = 0),
w AS (SELECT qid, unnest(string_split(text, ' ')) AS term, generate_subscripts(string_split(text, ' '), 1) AS k FROM q),
h AS (SELECT qid, k, id, entity_type FROM w JOIN nodes ON contains(lower(name), lower(term))),
named AS (SELECT qid, id, entity_type FROM (SELECT DISTINCT qid, id, entity_type FROM h) QUALIFY row_number() OVER (PARTITION BY qid, entity_type ORDER BY id) <= 5)"""


def _store(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    c, n, r = (S.read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    asked = c.where("c_custkey % 100 = 0").join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    kind = F.col("c_custkey") % 300
    text = F.when(kind == 0, F.concat_ws(" ", "c_name", "n_name")).when(kind == 100, F.concat_ws(" ", "c_name", "r_name")).otherwise(F.concat(F.lit("about "), "c_mktsegment"))
    return asked.select(F.col("c_custkey").alias("qid"), text.alias("text")), g.entities.withColumn("description", F.col("entity_type")), g.edges


@query(
    "graph_mode",
    f"""WITH RECURSIVE {_store_sql},
    walk AS (SELECT qid, id, 0 AS d FROM named UNION SELECT qid, target_id, d + 1 FROM walk JOIN trade_edges ON source_id = id WHERE d < 3),
    best AS (SELECT qid, id, min(d) AS d FROM walk GROUP BY ALL)
    SELECT qid, 'graph' AS mode, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, id) AS INT) AS rank, id, CAST(d AS VARCHAR) AS detail FROM best QUALIFY rank <= 5""",
)
def graph_mode(spark, sf_dir):
    return M.graph(*_store(spark, sf_dir))


@query(
    "path_mode",
    f"""WITH {_store_sql},
    five AS (SELECT qid, k, id, entity_type FROM h WHERE k <= 2 QUALIFY row_number() OVER (PARTITION BY qid, k, entity_type ORDER BY id) <= 5),
    ends AS (SELECT qid, k, id, row_number() OVER (PARTITION BY qid, k ORDER BY entity_type, id) AS ord FROM five),
    direct AS (
        SELECT a.qid, a.id, a.ord, a.id || ' --' || edge_type || '--> ' || b.id AS way FROM ends a JOIN ends b ON a.qid = b.qid AND a.k = 1 AND a.ord <= 3 AND b.k = 2 AND b.ord = 1
        JOIN trade_edges ON source_id = a.id AND target_id = b.id QUALIFY row_number() OVER (PARTITION BY a.qid, a.id, edge_type ORDER BY b.id) <= 3),
    p AS (SELECT qid, 'path' AS mode, row_number() OVER (PARTITION BY qid ORDER BY ord, way) AS rank, id, way AS detail FROM direct),
    taken AS (SELECT n.qid, source_id, target_id, edge_type FROM named n JOIN trade_edges ON source_id = n.id QUALIFY row_number() OVER (PARTITION BY n.qid, edge_type ORDER BY source_id, target_id) <= 5),
    near AS (SELECT qid, target_id AS id, min(struct_pack(a := edge_type, b := source_id)) AS o FROM taken WHERE (qid, target_id) NOT IN (SELECT (qid, id) FROM named) GROUP BY ALL),
    all_near AS (SELECT qid, id, 0 AS part, o.a AS a, o.b AS b FROM near UNION ALL SELECT qid, id, 1, NULL, NULL FROM named),
    y AS (SELECT qid, 'hybrid' AS mode, row_number() OVER (PARTITION BY qid ORDER BY part, a, b, id) AS rank, id, a AS detail FROM all_near WHERE qid NOT IN (SELECT qid FROM p)),
    met AS (SELECT DISTINCT qid, n.* FROM w JOIN nodes n ON contains(lower(name), lower(term)) OR contains(lower(description), lower(term)) WHERE qid NOT IN (SELECT qid FROM named)),
    scored AS (SELECT qid, id, (SELECT count(*) FROM w WHERE w.qid = met.qid AND contains(lower('[' || entity_type || '/' || id || '] ' || name || chr(10) || name), lower(term))) AS score FROM met),
    z AS (SELECT qid, 'semantic' AS mode, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, id, CAST(score AS VARCHAR) AS detail FROM scored)
    SELECT qid, mode, CAST(rank AS INT) AS rank, id, detail FROM (FROM p UNION ALL FROM y UNION ALL FROM z) WHERE rank <= 5""",
)
def path_mode(spark, sf_dir):
    """A store asked in path mode: paths, or what hybrid and then semantic mode find (RET8)."""
    return M.path(*_store(spark, sf_dir))


@query(
    "khop_context",
    f"""WITH RECURSIVE {S.CONV_SQL}, steps AS (SELECT source_id AS u, target_id AS v FROM conv_edges UNION SELECT target_id, source_id FROM conv_edges),
    w AS (SELECT id AS root, id, 0 AS d FROM conv_nodes WHERE entity_type = 'turn:system' UNION SELECT root, v, d + 1 FROM w JOIN steps ON id = u WHERE d < 1),
    n AS (SELECT DISTINCT root, id FROM w)
    SELECT a.root AS root, string_agg(source_id || ' --' || edge_type || '--> ' || target_id, chr(10) ORDER BY source_id, edge_type, target_id) AS body FROM n a JOIN conv_edges e ON e.source_id = a.id JOIN n b ON b.root = a.root AND b.id = e.target_id GROUP BY 1""",
)
def khop_context(spark, sf_dir):
    """The triples within one hop of each system turn, as text (RET7)."""
    g = S.conversations(spark, sf_dir)
    near = khop(g.edges, g.entities.where("entity_type = 'turn:system'"), 1).select("root", "id")
    inside = g.edges.join(near.withColumnRenamed("id", "source_id"), "source_id").join(near.withColumnRenamed("id", "target_id"), ["root", "target_id"])
    line = F.concat("source_id", F.lit(" --"), "edge_type", F.lit("--> "), "target_id")
    return R.render_groups(inside, ["root"], ["source_id", "edge_type", "target_id"], line)


@query("render_sessions", "SELECT conv_id, md5(string_agg('**' || role || '**: ' || text, chr(10) ORDER BY turn)) AS body_md5 FROM conversations GROUP BY 1")
def render_sessions(spark, sf_dir):
    turns = S.read(spark, sf_dir, "conversations")
    body = R.render_groups(turns, ["conv_id"], ["turn"], F.concat(F.lit("**"), "role", F.lit("**: "), "text"))
    return body.select("conv_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("full_context", "SELECT conv_id % 10 AS vault, md5(string_agg('--- ' || conv_id || '/' || turn || ' ---' || chr(10) || text, chr(10) ORDER BY conv_id, turn)) AS body_md5 FROM conversations GROUP BY 1")
def full_context(spark, sf_dir):
    turns = S.read(spark, sf_dir, "conversations").withColumn("vault", F.col("conv_id") % 10)
    head = F.concat(F.lit("--- "), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(" ---\n"), "text")
    return R.render_groups(turns, ["vault"], ["conv_id", "turn"], head).select("vault", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(
    "niah",
    """WITH n AS (SELECT item_id AS ord, CAST(item_id AS DOUBLE) / (SELECT count(*) FROM benchmark) AS depth, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS found FROM benchmark b)
    SELECT count(*) AS needles, count(*) FILTER (found) AS hits, round(count(*) FILTER (found) / count(*), 6) AS rate, round(avg(depth) FILTER (found), 6) AS mean_depth, coalesce(min(ord) FILTER (NOT found) - min(ord), count(*)) AS prefix FROM n""",
)
def niah(spark, sf_dir):
    """Which items lie verbatim in a document; candidates share the item's longest inner word."""
    items, docs = _queries(spark, sf_dir), _docs(spark, sf_dir)
    held = R.contained(items, docs).withColumn("found", F.lit(True))
    n = items.agg(F.count("*").alias("n"))
    rows = items.join(held, "qid", "left").crossJoin(n).select(F.col("qid").alias("ord"), (F.col("qid").cast("double") / F.col("n")).alias("depth"), F.coalesce("found", F.lit(False)).alias("found"))
    return R.needles(rows)


@query("covered_only", "SELECT item_id AS qid FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def covered_only(spark, sf_dir):
    """Questions whose expected passage occurs somewhere (FLT9)."""
    return R.contained(_queries(spark, sf_dir), _docs(spark, sf_dir))


@query(
    "chunk_paragraphs",
    """WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents),
    l AS (SELECT doc_id, parts, list_transform(parts, lambda x: [x]) AS nested FROM p)
    SELECT doc_id, CAST(CASE WHEN len(parts) = 0 THEN 0 ELSE len(list_reduce(nested, lambda acc, x: CASE WHEN length(x[1]) < 120 THEN acc[:-2] || [acc[-1] || chr(10) || chr(10) || x[1]] ELSE acc || x END)) END AS INT) AS chunks FROM l""",
)
def chunk_paragraphs(spark, sf_dir):
    """Every document, its lines set apart as paragraphs."""
    spaced = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    return S.read(spark, sf_dir, "documents").select("doc_id", F.size(R.chunk_paragraphs(spaced)).alias("chunks"))


@query(
    "chunk_fixed",
    """WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents),
    w AS (
        SELECT doc_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS till FROM d WHERE t <> ''
        UNION ALL
        SELECT doc_id, till, CASE WHEN till + 380 < length(t) AND blank > 0 THEN till + blank ELSE least(till + 380, length(t)) END
        FROM (SELECT w.doc_id, w.till, t, length(regexp_extract(substr(t, w.till + 1, 380), '(?s)^(.*) ', 1)) AS blank FROM w JOIN d USING (doc_id) WHERE w.till < length(t)))
    SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS i, pos AS start, md5(chunk) AS chunk_md5
    FROM (SELECT w.doc_id, pos, regexp_replace(substr(t, pos + 1, till - pos), '^\\s+|\\s+$', '', 'g') AS chunk FROM w JOIN d USING (doc_id) WHERE till > pos) WHERE chunk <> ''""",
)
def chunk_fixed(spark, sf_dir):
    return R.chunk_fixed(_docs(spark, sf_dir)).select("id", "i", "start", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("window_grounding", f"""WITH x AS (SELECT doc_id, text, {_tok.format('text')} AS t, {_tok.format("(SELECT text FROM benchmark WHERE item_id = doc_id % 40)")} AS e FROM documents),
    p AS (SELECT doc_id, ' ' || array_to_string(t, ' ') || ' ' AS pad, e FROM x)
    SELECT doc_id, CASE WHEN len(e) >= 6 THEN len(list_filter(range(1, len(e) - 4), lambda i: contains(pad, ' ' || array_to_string(e[i:i + 5], ' ') || ' '))) > 0 ELSE length(array_to_string(e, ' ')) >= 20 AND contains(pad, ' ' || array_to_string(e, ' ') || ' ') END AS grounded FROM p""")
def window_grounding(spark, sf_dir):
    items = S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("evidence"))
    docs = S.read(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 40).join(items, "k")
    return docs.select("doc_id", R.grounded(F.col("evidence"), F.col("text")).alias("grounded"))


_hosts = (
    "' http://box-' || doc_id % 9 || '.lan:80' || doc_id % 10 || '/a?b disk.local:22 00:1a:2B:3c:4D:5e 10.0.' || doc_id % 256 || '.7/24 192.168.0.' || doc_id % 256 || ' a.b' || doc_id || '@mail.example.org x%y+z@q.io"
    " password: x' || doc_id || ' Bearer=t' || doc_id || ' client_secret : \"q\" access-key=K API_KEY=1 tokens=5 vault-' || doc_id % 3 || ' AAAAbbbbCCCCddddEEEEffffGGGGhhhh' || doc_id || '== usr/local/share/some/deep/folder/file-' || doc_id || ' 0123456789abcdef0123456789abcde' || doc_id % 10"
)
_redacted = f"""coalesce(text, '') || {_hosts}"""
for _pattern, _by in (
    ("(?i)\\b(password|passwd|token|secret|bearer|api[-_]?key|access[-_]?key|client[-_]?secret)\\b(\\s*[=:]\\s*)\\S+", "\\1\\2[SECRET]"),
    ("\\b[0-9A-Fa-f][0-9A-Fa-f](:[0-9A-Fa-f][0-9A-Fa-f]){5}\\b", "[MAC]"),
    ("\\b\\d{1,3}(\\.\\d{1,3}){3}(/\\d{1,2})?\\b", "[IP]"),
    ("(?i)\\bvault-1\\b", "[PRIVATE]"),
    ("(?i)\\bhttps?://[a-z0-9.-]*\\.(lan|local)(:\\d+)?(/\\S*)?\\b", "[ENDPOINT]"),
    ("(?i)\\b[a-z0-9-]+\\.(lan|local)(:\\d+)?\\b", "[HOST]"),
    ("\\b[\\w.%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b", "[EMAIL]"),
    ("\\b([\\w+/-]{32,}={0,2})\\b", "\ue0f1\\1\ue0f2"),
    ("\ue0f1[^/\ue0f2]*\ue0f2", "[BLOB]"),
    ("[\ue0f1\ue0f2]", ""),
):
    _redacted = f"regexp_replace({_redacted}, '{_pattern}', '{_by}', 'g')"


@query("redact", f"SELECT doc_id, md5({_redacted}) AS redacted_md5 FROM documents")
def redact(spark, sf_dir):
    """Redacted texts' digests; every text ends in one of each thing to hide."""
    text = F.concat(F.coalesce("text", F.lit("")), F.expr(_hosts))
    return S.read(spark, sf_dir, "documents").select("doc_id", F.md5(R.redact(text, private_hosts=("vault-1",)).cast("binary")).alias("redacted_md5"))


_marks = ["recall=", "expected: [", "min_hops", "tokens=", "elapsed_ms", "--questions runs/corpora"]
_marked = "coalesce(text, '') || ' ' || " + " || ".join(f"CASE WHEN doc_id % {k + 2} = 0 THEN '{m}' ELSE '' END" for k, m in enumerate(_marks))


@query("pollution_filter", f"SELECT doc_id FROM (SELECT doc_id, {_marked} AS t FROM documents) WHERE {' + '.join(f'contains(t, {chr(39)}{m}{chr(39)})::INT' for m in _marks)} >= 2")
def pollution_filter(spark, sf_dir):
    """Two or more markers of a run's log (FLT7); every document gets some of them at its end."""
    return S.read(spark, sf_dir, "documents").select("doc_id", F.expr(_marked).alias("t")).where(R.is_pollution(F.col("t"), "runs/corpora")).select("doc_id")


@query("relevance_names", "SELECT page_id, regexp_extract(coalesce(url, ''), '[^/]*$') = (page_id % 50)::VARCHAR AS by_name, (coalesce(url, '') GLOB 'http*org/*' OR regexp_extract(coalesce(url, ''), '[^/]*$') GLOB '*1?' OR coalesce(url, '') GLOB '*1?') AND (contains(coalesce(html, ''), 'the') OR contains(coalesce(html, ''), 'zu')) AS by_glob, regexp_extract(coalesce(url, ''), '[^/]*$') GLOB '*1' OR coalesce(url, '') GLOB '*1' AS by_glob_only FROM pages")
def relevance_names(spark, sf_dir):
    """Relevance by file name, and by a glob on the path or its last part (FLT6)."""
    p = S.read(spark, sf_dir, "pages")
    none, either = F.array().cast("array<string>"), F.array(F.lit("the"), F.lit("zu"))
    by_glob = F.col("url")
    two = R.relevant_by_glob(by_glob, F.col("html"), "http*org/*", either) | R.relevant_by_glob(by_glob, F.col("html"), "*1?", either)
    return p.select("page_id", R.relevant_by_name(F.col("url"), (F.col("page_id") % 50).cast("string")).alias("by_name"), two.alias("by_glob"), R.relevant_by_glob(by_glob, F.col("html"), "*1", none).alias("by_glob_only"))


@query("relevance_predicate", "SELECT page_id, url GLOB 'http*://*.example.org/*' AND (contains(html, 'the') OR contains(html, 'zu')) AS relevant, contains(lower(html), 'license') AND regexp_extract(url, '[^/]*$') GLOB '*1*' AS relevant_ci FROM pages")
def relevance_predicate(spark, sf_dir):
    p = S.read(spark, sf_dir, "pages")
    either = F.array(F.lit("the"), F.lit("zu"))
    return p.select("page_id", R.relevant(F.col("url"), F.col("html"), "http*://*.example.org/*", either).alias("relevant"), R.relevant(F.col("url"), F.col("html"), "*1*", F.array(F.lit("LICENSE")), fold=True).alias("relevant_ci"))


@query(
    "claim_match",
    """WITH p AS (SELECT * FROM (VALUES (1, 'the .* of'), (2, 'und'), (3, 'que')) t(ord, pattern)), c AS (SELECT item_id AS id, text FROM benchmark WHERE NOT regexp_matches(text, 'ment', 'i'))
    SELECT id, first(pattern ORDER BY ord) AS pattern FROM c JOIN p ON regexp_matches(text, pattern, 'is') GROUP BY 1""",
)
def claim_match(spark, sf_dir):
    """Untestable claims are left out; of the patterns that match the first counts (FLT14)."""
    patterns = spark.createDataFrame([(1, "the .* of"), (2, "und"), (3, "que")], "ord int, pattern string")
    claims = S.read(spark, sf_dir, "benchmark").where(~F.col("text").rlike("(?i)ment")).select(F.col("item_id").alias("id"), "text")
    hits = claims.join(F.broadcast(patterns), F.expr("text rlike concat('(?is)', pattern)"))
    return hits.groupBy("id").agg(F.min_by("pattern", "ord").alias("pattern"))


@query("grep_floor", "SELECT item_id AS qid, count(*) AS pages FROM benchmark JOIN pages ON contains(url, lower(split_part(text, ' ', 1))) GROUP BY 1")
def grep_floor(spark, sf_dir):
    """Pages whose address holds the question's first word (an extension)."""
    first = _queries(spark, sf_dir).select("qid", F.lower(F.get(F.split("text", " "), F.lit(0))).alias("w"))
    return R.address_hits(first, S.read(spark, sf_dir, "pages"))


@query("relevance_predicate_ci", "SELECT page_id FROM pages WHERE contains(lower(html), 'license') AND regexp_extract(url, '[^/]*$') GLOB '*1*'")
def relevance_predicate_ci(spark, sf_dir):
    p = S.read(spark, sf_dir, "pages")
    return p.where(R.relevant(F.col("url"), F.col("html"), "*1*", F.array(F.lit("LICENSE")), fold=True)).select("page_id")

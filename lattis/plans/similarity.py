"""Queries over names that are alike and needles in a haystack."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattis.operators import needles as N
from lattis.operators import retrieval as R
from lattis.operators.similarity import SetJoin
from lattis.plans.registry import query
from lattis.sources import graphs as S

_names = """names AS (
    SELECT 'part:' || p_partkey AS id, 'Part of catalogue: ' || p_name || ' ' || p_brand || ' ' || p_type || ' size' || p_size AS name FROM part
    UNION ALL SELECT 'customer:' || c_custkey, c_name || ' ' || c_mktsegment || ' nation' || c_nationkey FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, s_name || ' nation' || s_nationkey FROM supplier),
sets AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+'))) AS t FROM names),
classes AS MATERIALIZED (SELECT min(id) AS class_id, t, len(t) AS n FROM sets WHERE len(t) > 0 GROUP BY t)"""


def _name_sets(spark, sf_dir):
    part, customer, supplier = (S.read(spark, sf_dir, t) for t in ("part", "customer", "supplier"))
    named = lambda df, kind, key, *parts: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.concat(*parts).alias("name"))
    blank = F.lit(" ")
    names = (
        named(part, "part", "p_partkey", F.lit("Part of catalogue: "), "p_name", blank, "p_brand", blank, "p_type", F.lit(" size"), F.col("p_size").cast("string"))
        .unionByName(named(customer, "customer", "c_custkey", "c_name", blank, "c_mktsegment", F.lit(" nation"), F.col("c_nationkey").cast("string")))
        .unionByName(named(supplier, "supplier", "s_suppkey", "s_name", F.lit(" nation"), F.col("s_nationkey").cast("string")))
    )
    return names.select("id", R.tokens(F.col("name")).alias("tokens"))


@query("similar_names", f"WITH {_names} SELECT id, class_id FROM sets JOIN classes USING (t)")
def similar_names(spark, sf_dir):
    """The class of equal token sets of every part, customer and supplier."""
    return SetJoin(_name_sets(spark, sf_dir)).members()


@query(
    "similar_name_pairs",
    f"""WITH {_names}, p AS (SELECT a.class_id AS a, b.class_id AS b, len(list_intersect(a.t, b.t)) AS s, a.n + b.n AS m FROM classes a JOIN classes b ON a.class_id < b.class_id AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n)
    SELECT a, b, round(s / (m - s), 6) AS similarity FROM p WHERE 10 * s >= 8 * (m - s)""",
)
def similar_name_pairs(spark, sf_dir):
    """Classes whose token sets have a Jaccard similarity of 0.8 or more."""
    return SetJoin(_name_sets(spark, sf_dir)).pairs().select("a", "b", F.round("similarity", 6).alias("similarity"))


def _needles_sql(sequential: bool) -> str:
    share = "CAST('0x' || substr(md5('42:' || item_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
    step = "(1.0::DOUBLE / (count(*) OVER () + 1))"
    depth = f"greatest(least(row_number() OVER (ORDER BY item_id) * {step} + ({share} - 0.5) * 0.3 * {step}, 0.95), 0.05)" if sequential else share
    tok = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
    return f"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text, length(coalesce(text, '')) AS len FROM documents),
    place AS (SELECT id, CAST(sum(len) OVER (ORDER BY id) - len AS BIGINT) AS first, CAST(sum(len) OVER (ORDER BY id) AS BIGINT) AS last FROM d WHERE len > 0),
    n AS (SELECT item_id AS ord, 'The code of vault' || md5(text) || ' is ' || item_id * 7 || '.' AS needle, 'What is the code of vault' || md5(text) AS question, {depth} AS depth FROM benchmark),
    put AS (SELECT n.*, id, CAST(floor(depth * (SELECT sum(len) FROM d)) AS BIGINT) - first AS off FROM n JOIN place ON floor(depth * (SELECT sum(len) FROM d)) >= first AND floor(depth * (SELECT sum(len) FROM d)) < last),
    piece AS (SELECT id, ord, off, needle, coalesce(lag(off) OVER (PARTITION BY id ORDER BY off, ord), 0) AS before FROM put),
    hay AS (
        SELECT d.id, CASE WHEN x.id IS NULL THEN text ELSE x.head || substr(text, x.off + 1) END AS text FROM d
        LEFT JOIN (SELECT p.id, string_agg(substr(text, before + 1, off - before) || ' ' || needle || ' ', '' ORDER BY off, ord) AS head, max(off) AS off FROM piece p JOIN d USING (id) GROUP BY p.id) x ON x.id = d.id),
    i AS (SELECT DISTINCT id, unnest({tok.format("text")}) AS token FROM hay),
    a AS (SELECT ord, token, count(*) AS qf FROM (SELECT ord, unnest({tok.format("question")}) AS token FROM n) GROUP BY ALL),
    w AS (SELECT token, ln(((SELECT count(*) FROM hay) + 1) / (count(*) + 0.5)) AS w FROM i GROUP BY token),
    s AS (SELECT ord, id, round(sum(qf * w), 6) AS score FROM i JOIN a USING (token) JOIN w USING (token) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5),
    f AS (SELECT r.ord, min(rank) AS rank FROM r JOIN hay USING (id) JOIN n ON n.ord = r.ord WHERE contains(hay.text, needle) GROUP BY r.ord)
    SELECT ord, round(depth, 9) AS depth, id, CAST(f.rank AS INT) AS rank, coalesce(f.rank = 1, false) AS in_answer, f.rank IS NOT NULL AS in_context, f.rank IS NOT NULL AS found FROM n LEFT JOIN put USING (ord, needle, question, depth) LEFT JOIN f USING (ord)"""


def _haystack(spark, sf_dir, sequential: bool):
    items = S.read(spark, sf_dir, "benchmark")
    name = F.concat(F.lit("vault"), F.md5(F.col("text").cast("binary")))
    needles = items.select(
        F.col("item_id").alias("ord"),
        F.concat(F.lit("The code of "), name, F.lit(" is "), (F.col("item_id") * 7).cast("string"), F.lit(".")).alias("needle"),
        F.concat(F.lit("What is the code of "), name).alias("question"),
    )
    docs = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    hay, told = N.insert(docs, needles, 42, sequential)
    ranked = R.idf_tokens(needles.select(F.col("ord").alias("qid"), F.col("question").alias("text")), hay, 5)
    return told, N.found_by(ranked, hay, told)


@query("needle_insertion", _needles_sql(False))
def needle_insertion(spark, sf_dir):
    """A needle for each benchmark item at a seeded depth of all documents, and what retrieval by rare words finds."""
    told, found = _haystack(spark, sf_dir, False)
    return found.join(told.select("ord", "id"), "ord").select("ord", F.round("depth", 9).alias("depth"), "id", F.col("rank").cast("int").alias("rank"), "in_answer", "in_context", "found")


@query(
    "needle_sequence",
    f"""WITH x AS ({_needles_sql(True)})
    SELECT count(*) AS needles, count(*) FILTER (found) AS hits, round(count(*) FILTER (found) / count(*), 6) AS rate, round(avg(depth) FILTER (found), 6) AS mean_depth, coalesce(min(ord) FILTER (NOT found) - min(ord), count(*)) AS prefix FROM x""",
)
def needle_sequence(spark, sf_dir):
    """Needles in order at growing depths, and how many are found one after the other."""
    _, found = _haystack(spark, sf_dir, True)
    return R.needles(found)

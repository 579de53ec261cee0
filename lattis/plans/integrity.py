"""Queries over ingestion integrity, relations and defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattis.operators import integrity as I
from lattis.operators import relations as R
from lattis.operators.ordering import global_index
from lattis.operators.topology import components_of
from lattis.plans.registry import query
from lattis.sources import graphs as S

_ratio = "round({a} / {b}, 6)"


@query("normalize_predicate", r"SELECT event_id, replace(replace(lower(trim(' ' || upper(event_type) || '-Seen By ')), '-', '_'), ' ', '_') AS predicate FROM events")
def normalize_predicate(spark, sf_dir):
    e = S.read(spark, sf_dir, "events")
    return e.select("event_id", I.normalize_predicate(F.concat(F.lit(" "), F.upper("event_type"), F.lit("-Seen By "))).alias("predicate"))


_parts = "parts AS (SELECT 'part:' || p_partkey AS id, p_name AS name, p_type AS entity_type FROM part)"
_keyed = _parts + r""", keyed AS (SELECT id, entity_type || '::' || lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS key FROM parts)"""


def _part_nodes(spark, sf_dir):
    return S.read(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"))


@query(
    "canonical_collisions",
    f"""WITH {_keyed}, k AS (SELECT key, count(*) AS n FROM keyed GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS keyed, count(*) AS unique_keys, count(*) FILTER (n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS collisions FROM k""",
)
def canonical_collisions(spark, sf_dir):
    return I.collisions(_part_nodes(spark, sf_dir))


@query("collision_groups", f"WITH {_keyed} SELECT key, count(*) AS ids, min(id) AS first_id FROM keyed GROUP BY 1 HAVING count(*) > 1")
def collision_groups(spark, sf_dir):
    return I.collision_groups(_part_nodes(spark, sf_dir))


_supply = "d AS (SELECT 'part:' || l_partkey AS id, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY 1), kd AS (SELECT keyed.id, key, coalesce(degree, 0) AS degree FROM keyed LEFT JOIN d ON d.id = keyed.id)"


@query("dedup_keeper", f"WITH {_keyed}, {_supply} SELECT key, first(id ORDER BY degree DESC, id) AS keeper, count(*) AS ids FROM kd GROUP BY 1 HAVING count(*) > 1")
def dedup_keeper(spark, sf_dir):
    return I.keepers(_part_nodes(spark, sf_dir), S.supply(spark, sf_dir).edges)


@query("dedup_keeper_largest", f"WITH {_keyed}, {_supply} SELECT key, first(id ORDER BY degree DESC, id DESC) AS keeper, count(*) AS ids FROM kd GROUP BY 1 HAVING count(*) > 1")
def dedup_keeper_largest(spark, sf_dir):
    return I.keepers(_part_nodes(spark, sf_dir), S.supply(spark, sf_dir).edges, largest_id=True)


@query("required_field_coverage", "SELECT count(*) AS nodes, count(*) FILTER (user_id % 7 = 0 OR event_type IS NULL OR event_type = 'view') AS gaps, round((count(*) - count(*) FILTER (user_id % 7 = 0 OR event_type IS NULL OR event_type = 'view')) / count(*), 6) AS coverage FROM events")
def required_field_coverage(spark, sf_dir):
    """Names are null for every seventh user; the type ``view`` is emptied."""
    e = S.read(spark, sf_dir, "events")
    return I.required_fields(e.select(F.when(F.col("user_id") % 7 != 0, F.col("props")).alias("name"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("entity_type")))


@query("edge_type_distribution", f"WITH {S.TRADE_SQL} SELECT edge_type, count(*) AS n FROM trade_edges GROUP BY 1")
def edge_type_distribution(spark, sf_dir):
    return I.edge_type_distribution(S.trade(spark, sf_dir).edges)


_mono = """c AS (SELECT edge_type, count(*) AS n FROM {t} GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS k FROM c)
    SELECT count(*) AS types, CAST(max(t) AS BIGINT) AS total, round(sum(-(n / t) * log2(n / t)), 6) AS entropy, round(sum(-(n / t) * log2(n / t)) / log2(max(k)), 6) AS normalized,
           first(edge_type ORDER BY n DESC, edge_type) AS dominant, round(max(n) / max(t), 6) AS dominant_share FROM c, t"""


@query("edge_type_monoculture", f"WITH {S.TRADE_SQL}, {_mono.format(t='trade_edges')}")
def edge_type_monoculture(spark, sf_dir):
    return I.monoculture(S.trade(spark, sf_dir).edges)


@query("taxonomy_entropy", "WITH e AS (SELECT event_type AS edge_type FROM events), " + _mono.format(t="e"))
def taxonomy_entropy(spark, sf_dir):
    return I.monoculture(S.read(spark, sf_dir, "events").select(F.col("event_type").alias("edge_type")))


@query("bands", "SELECT event_id, CASE WHEN value <= 10 THEN 'healthy' WHEN value <= 30 THEN 'warning' ELSE 'concerning' END AS low_is_good, CASE WHEN value >= 30 THEN 'healthy' WHEN value >= 10 THEN 'warning' ELSE 'concerning' END AS high_is_good FROM events WHERE value IS NOT NULL")
def bands(spark, sf_dir):
    e = S.read(spark, sf_dir, "events").where("value is not null")
    return e.select("event_id", I.band(F.col("value"), 10, 30).alias("low_is_good"), I.band(F.col("value"), 30, 10, False).alias("high_is_good"))


@query(
    "remediations",
    """WITH m AS (SELECT 'canonical_collisions' AS metric, count(*) - count(DISTINCT p_type || p_name) AS v FROM part UNION ALL SELECT 'isolates', count(*) FILTER (doc_id < 0) FROM documents UNION ALL SELECT 'phantom_edges', 2 UNION ALL SELECT 'other', 9)
    SELECT metric, CASE WHEN v <= 3 THEN 'warning' ELSE 'concerning' END AS band,
           CASE metric WHEN 'canonical_collisions' THEN 'merge entities that share a canonical key' WHEN 'isolates' THEN 'link isolated entities or drop them' WHEN 'phantom_edges' THEN 're-extract edges whose ends their source doesn''t name' ELSE 'review' END AS advice
    FROM m WHERE v > 1""",
)
def remediations(spark, sf_dir):
    part, docs = S.read(spark, sf_dir, "part"), S.read(spark, sf_dir, "documents")
    one = lambda df, name, v: df.agg(v.alias("v")).select(F.lit(name).alias("metric"), F.col("v").cast("long").alias("v"))
    rows = one(part, "canonical_collisions", F.count("*") - F.count_distinct(F.concat("p_type", "p_name"))).unionByName(one(docs, "isolates", F.count_if(F.col("doc_id") < 0)))
    rows = rows.unionByName(spark.createDataFrame([("phantom_edges", 2), ("other", 9)], "metric string, v long"))
    return I.remediations(rows.withColumn("band", I.band(F.col("v"), 1, 3)))


_cells = "x AS (SELECT doc_id, lang || length(text) % 11 AS p, source AS t FROM documents), c AS (SELECT p, t, count(*) AS n FROM x GROUP BY 1, 2), pr AS (SELECT *, sum(n) OVER (PARTITION BY p) AS sp, sum(n) OVER (PARTITION BY t) AS st FROM c), q AS (SELECT sum(n) AS items, sum(n * n / sp) / sum(n) AS p, sum(n * n / st) / sum(n) AS r FROM pr)"


@query("bcubed", f"WITH {_cells} SELECT CAST(items AS BIGINT) AS items, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM q")
def bcubed(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents")
    return I.bcubed(d.select(F.col("doc_id").alias("item"), F.concat("lang", (F.length("text") % 11).cast("string")).alias("predicted"), F.col("source").alias("truth")))


@query(
    "alias_bcubed",
    f"""WITH {_keyed}, g AS (SELECT 'part:' || p_partkey AS id, p_brand AS t, count(*) OVER (PARTITION BY p_brand) AS s FROM part WHERE p_size <= 10),
    x AS (SELECT key AS p, t FROM keyed JOIN g USING (id) WHERE s >= 2), c AS (SELECT p, t, count(*) AS n FROM x GROUP BY 1, 2),
    pr AS (SELECT *, sum(n) OVER (PARTITION BY p) AS sp, sum(n) OVER (PARTITION BY t) AS st FROM c), q AS (SELECT sum(n) AS items, sum(n * n / sp) / sum(n) AS p, sum(n * n / st) / sum(n) AS r FROM pr)
    SELECT CAST(items AS BIGINT) AS items, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM q""",
)
def alias_bcubed(spark, sf_dir):
    gold = S.read(spark, sf_dir, "part").where("p_size <= 10").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("truth"))
    return I.alias_resolution(_part_nodes(spark, sf_dir), gold)


# ---------------------------------------------------------------- relations


def _orders(spark, sf_dir):
    g = S.order_chain(spark, sf_dir)
    notes = S.read(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("target_id"), F.lit("placed_by").alias("edge_type"))
    return g.edges.unionByName(notes).withColumn("seq", F.regexp_extract("source_id", r"(\d+)", 1).cast("long"))


@query(
    "superseded_edges",
    f"""WITH {S.ORDER_SQL}, s AS (SELECT target_id AS id, max(source_id) AS newer FROM order_edges GROUP BY 1)
    SELECT 'order:' || o_orderkey AS source_id, 'customer:' || o_custkey AS target_id, newer AS superseded_by FROM orders LEFT JOIN s ON s.id = 'order:' || o_orderkey""",
)
def superseded_edges(spark, sf_dir):
    return R.stamp_superseded(_orders(spark, sf_dir)).where("edge_type = 'placed_by'").select("source_id", "target_id", "superseded_by")


@query(
    "supersession_chains",
    """WITH o AS (SELECT * FROM orders) SELECT last('order:' || o_orderkey ORDER BY o_orderdate, o_orderkey) AS head, CAST(count(*) AS INT) AS length, string_agg('order:' || o_orderkey, '>' ORDER BY o_orderdate, o_orderkey) AS chain FROM o GROUP BY o_custkey HAVING count(*) >= 2""",
)
def supersession_chains(spark, sf_dir):
    return R.supersession_chains(S.order_chain(spark, sf_dir).edges)


@query("cat6_supersession", f"WITH {S.ORDER_SQL} SELECT count(*) AS seeded, count(*) AS resolved, count(DISTINCT target_id) AS superseded, CAST(1 AS DOUBLE) AS completeness FROM order_edges")
def cat6_supersession(spark, sf_dir):
    return R.supersession_report(_orders(spark, sf_dir))


_contra = """pairs AS (SELECT 'doc:' || least(a.doc_id, b.doc_id) AS x, 'doc:' || greatest(a.doc_id, b.doc_id) AS y, a.source AS ev FROM dup_docs a JOIN dup_docs b ON a.digest = b.digest AND b.doc_id = b.first AND a.doc_id > b.doc_id AND a.source <> b.source)"""


def _contradictions(spark, sf_dir):
    """Copies of a text that come from another source than the first of them."""
    docs = S.read(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))
    first = docs.groupBy("digest").agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("f")).select("digest", F.col("f.doc_id").alias("first"), F.col("f.source").alias("first_source"))
    found = docs.join(first, "digest").where("doc_id > first and source <> first_source")
    doc = lambda c: F.concat(F.lit("doc:"), F.col(c).cast("string"))
    return found.select(F.col("doc_id").alias("seq"), doc("doc_id").alias("source_id"), doc("first").alias("target_id"), F.lit("Contradicts").alias("edge_type"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("evidence"))


@query("contradiction_pairs", f"WITH {S.DUP_SQL}, {_contra} SELECT least(x, y) AS a, greatest(x, y) AS b, CASE WHEN CAST(y[5:] AS BIGINT) % 2 = 0 THEN ev ELSE md5((SELECT text FROM documents WHERE 'doc:' || doc_id = y)) END AS claim_a FROM pairs")
def contradiction_pairs(spark, sf_dir):
    return R.contradiction_pairs(_contradictions(spark, sf_dir), S.duplicates(spark, sf_dir).entities)


@query(
    "cat3_contradiction",
    f"""WITH {S.DUP_SQL}, {_contra}, surf AS (SELECT x, y FROM pairs WHERE CAST(y[5:] AS BIGINT) % 3 <> 0 UNION ALL SELECT 'doc:0', 'doc:' || doc_id FROM documents WHERE doc_id IN (1, 2))
    SELECT (SELECT count(*) FROM pairs) AS seeded, count(*) AS surfaced, count(*) FILTER ((x, y) IN (SELECT (x, y) FROM pairs)) AS matched,
           round(count(*) FILTER ((x, y) IN (SELECT (x, y) FROM pairs)) / (SELECT count(*) FROM pairs), 6) AS detection, round(count(*) FILTER ((x, y) IN (SELECT (x, y) FROM pairs)) / count(*), 6) AS precision FROM surf""",
)
def cat3_contradiction(spark, sf_dir):
    seeded = _contradictions(spark, sf_dir).select("seq", F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    noise = S.read(spark, sf_dir, "documents").where("doc_id in (1, 2)").select(F.lit("doc:0").alias("a"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("b"))
    return R.contradiction_report(seeded, seeded.where("seq % 3 <> 0").select("a", "b").unionByName(noise))


_stop = ", ".join(f"'{w}'" for w in R.STOP_WORDS)
_tok = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: t NOT IN (" + _stop + ")))"


@query(
    "phantom_edges",
    f"""WITH t AS (SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id, turn) AS seq FROM conversations),
    body AS (SELECT conv_id, {_tok.format("string_agg(text, ' ' ORDER BY turn)")} AS body FROM conversations WHERE conv_id % 5 <> 0 GROUP BY 1),
    f AS (SELECT t.conv_id * 1000 + t.turn AS seq, body, {_tok.format("t.text[1:40]")} AS fs, {_tok.format("n.text[1:60]")} AS ft FROM t JOIN t n ON n.seq = t.seq + 1 JOIN body ON body.conv_id = t.conv_id),
    s AS (SELECT seq, CASE WHEN len(fs) > 0 THEN len(list_intersect(fs, body)) / len(fs) >= 0.5 END AS s, CASE WHEN len(ft) > 0 THEN len(list_intersect(ft, body)) / len(ft) >= 0.5 END AS t FROM f)
    SELECT seq, s IS NOT NULL AND t IS NOT NULL AS checkable, coalesce(NOT (s AND t), false) AND s IS NOT NULL AND t IS NOT NULL AS phantom,
           CASE WHEN s IS NULL OR t IS NULL THEN NULL WHEN NOT s AND NOT t THEN 'both' WHEN NOT s THEN 'source' WHEN NOT t THEN 'target' END AS missing FROM s""",
)
def phantom_edges(spark, sf_dir):
    """Each turn names the next turn of all; is that in its conversation?"""
    turns = S.read(spark, sf_dir, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    placed = global_index(turns.select("conv_id", "turn", key.alias("source_id")), ["conv_id", "turn"])
    after = placed.select((F.col("i") - 1).alias("i"), F.col("source_id").alias("target_id"))
    nxt = placed.join(after, "i")
    edges = nxt.select(F.col("source_id").cast("long").alias("seq"), "source_id", "target_id", F.col("conv_id").cast("string").alias("source_note"))
    of = lambda n: turns.select(key.alias("id"), F.array(F.substring("text", 1, n)).alias("forms"))
    names = of(40).unionByName(of(60).withColumn("id", F.concat(F.lit("t"), "id")))
    bodies = turns.where("conv_id % 5 <> 0").groupBy(F.col("conv_id").cast("string").alias("source_note")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("body"))
    return R.phantom_edges(edges.withColumn("target_id", F.concat(F.lit("t"), "target_id")), names, bodies)


# ------------------------------------------------------------------ defects


_defect_nodes = f"{S.TRADE_SQL}, orphan AS (SELECT '__orphan_' || i AS id FROM range(3) r(i))"


@query("orphans", f"WITH {_defect_nodes} SELECT id FROM orphan")
def orphans(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    return R.orphans(g.entities.unionByName(R.inject_orphans(spark, 3)), g.edges)


_drawn = "drawn AS (SELECT * FROM trade_nodes ORDER BY md5('42|' || id), id LIMIT 3)"


@query("broken_refs", f"WITH {S.TRADE_SQL}, {_drawn} SELECT '__absent_' || id AS id, 'target' AS side, CAST(1 AS BIGINT) AS n FROM drawn")
def broken_refs(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    return R.broken_refs(g.edges.unionByName(R.inject_broken_refs(g.entities, 3)), g.entities)


@query("inject_duplicates", f"WITH {S.TRADE_SQL}, {_drawn} SELECT '__dup_' || id AS id, upper(name) AS name, entity_type FROM drawn")
def inject_duplicates(spark, sf_dir):
    return R.inject_duplicates(S.trade(spark, sf_dir).entities, 3)


@query("duplicate_ids", f"WITH {S.TRADE_SQL}, {_drawn} SELECT '__dup_' || id AS id FROM drawn")
def duplicate_ids(spark, sf_dir):
    """Clones have no edges, so the originals, which have some, are kept."""
    g = S.trade(spark, sf_dir)
    return R.detect_duplicates(g.entities.unionByName(R.inject_duplicates(g.entities, 3)), g.edges)


@query("defect_recall", "SELECT 3::BIGINT AS expected, 3::BIGINT AS found, 1.0::DOUBLE AS recall, 3::BIGINT AS new, 1.0::DOUBLE AS delta_precision")
def defect_recall(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    clones = R.inject_duplicates(g.entities, 3)
    return R.defect_recall(clones, R.detect_duplicates(g.entities.unionByName(clones), g.edges), R.detect_duplicates(g.entities, g.edges))


@query("monoculture_signal", f"WITH {S.TRADE_SQL}, c AS (SELECT edge_type, count(*) AS n FROM trade_edges GROUP BY 1), a AS (SELECT edge_type, n + CASE WHEN edge_type = (SELECT last(edge_type ORDER BY n, edge_type) FROM c) THEN least(n, 20) ELSE 0 END AS n FROM c) SELECT first(edge_type ORDER BY n DESC, edge_type) AS dominant, round(max(n) / sum(n), 6) AS dominant_share FROM a")
def monoculture_signal(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    return I.monoculture(g.edges.unionByName(R.inject_monoculture(g.edges, 20))).select("dominant", "dominant_share")


@query(
    "snapshot_diff",
    f"""WITH {S.TRADE_SQL}, a AS (SELECT *, row_number() OVER () AS k FROM trade_edges WHERE edge_type <> 'part_of'),
    b AS (SELECT source_id, target_id, CASE WHEN edge_type = 'based_in' THEN 'seated_in' ELSE edge_type END AS edge_type FROM trade_edges WHERE source_id NOT LIKE 'customer:%7')
    SELECT source_id, target_id, CASE WHEN a.edge_type IS NULL THEN 'added' WHEN b.edge_type IS NULL THEN 'removed' ELSE 'retyped' END AS change, a.edge_type AS before, b.edge_type AS after
    FROM a FULL JOIN b USING (source_id, target_id) WHERE a.edge_type IS DISTINCT FROM b.edge_type""",
)
def snapshot_diff(spark, sf_dir):
    from lattis.operators.snapshots import edge_diff

    e = S.trade(spark, sf_dir).edges
    after = e.where("source_id not like 'customer:%7'").withColumn("edge_type", F.when(F.col("edge_type") == "based_in", "seated_in").otherwise(F.col("edge_type")))
    return edge_diff(e.where("edge_type <> 'part_of'"), after)


@query("validate_ontology", f"WITH {S.TRADE_SQL} SELECT 'unregistered_type' AS violation, id, entity_type AS detail FROM trade_nodes WHERE entity_type = 'customer:MACHINERY' UNION ALL SELECT 'missing_endpoint', source_id, target_id FROM trade_edges WHERE target_id LIKE 'region:%' UNION ALL SELECT 'orphan', id, entity_type FROM trade_nodes WHERE id LIKE '__none' ")
def validate_ontology(spark, sf_dir):
    from lattis.operators.snapshots import validate

    g = S.trade(spark, sf_dir)
    nodes = g.entities.where("entity_type <> 'region'")
    types = nodes.where("entity_type <> 'customer:MACHINERY'").select("entity_type").distinct()
    return validate(nodes, g.edges, types)


@query("cross_note_consistency", "SELECT source AS id, count(DISTINCT lang) AS variants FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def cross_note_consistency(spark, sf_dir):
    from lattis.operators.snapshots import inconsistent

    return inconsistent(S.read(spark, sf_dir, "documents"), "source", "lang")


@query("cat5_gap_report", f"WITH {S.DUP_SQL}, c AS (SELECT digest, count(*) AS n FROM dup_docs GROUP BY 1) SELECT count(*) AS components, CAST(max(n) AS BIGINT) AS largest, count(*) FILTER (n = 1) AS isolates, round(max(n) / sum(n), 6) AS largest_ratio, CASE WHEN count(*) FILTER (n = 1) / sum(n) <= 0.2 THEN 'healthy' WHEN count(*) FILTER (n = 1) / sum(n) <= 0.5 THEN 'warning' ELSE 'concerning' END AS isolate_band FROM c")
def cat5_gap_report(spark, sf_dir):
    g = S.duplicates(spark, sf_dir)
    sizes = components_of(g.entities, g.edges).groupBy("component").agg(F.count("*").alias("n"))
    report = sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("isolates"), F.sum("n").alias("nodes"))
    return report.select("components", "largest", "isolates", F.round(F.col("largest") / F.col("nodes"), 6).alias("largest_ratio"), I.band(F.col("isolates") / F.col("nodes"), 0.2, 0.5).alias("isolate_band"))

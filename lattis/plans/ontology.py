"""Queries over ontology coherence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattis.operators import ontology as O
from lattis.plans.registry import query
from lattis.sources import graphs as S


def _rows(spark, column, values):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


@query("type_coverage", f"WITH {S.TRADE_SQL}, d AS (SELECT * FROM (VALUES ('region'), ('customer'), ('planet')) t(d)), f AS (SELECT DISTINCT entity_type FROM trade_nodes), h AS (SELECT d, entity_type FROM d JOIN f ON entity_type = d OR starts_with(entity_type, d || ':')) SELECT (SELECT count(*) FROM d) AS declared, count(DISTINCT d) AS present, round(count(DISTINCT d) / (SELECT count(*) FROM d), 6) AS coverage, (SELECT count(*) FROM f) - count(DISTINCT entity_type) AS undeclared FROM h")
def type_coverage(spark, sf_dir):
    return O.type_coverage(S.trade(spark, sf_dir).entities, _rows(spark, "entity_type", ["region", "customer", "planet"]))


@query("edge_vocab_coverage", f"WITH {S.TRADE_SQL}, d AS (SELECT * FROM (VALUES ('PART_OF'), ('located_in'), ('owns')) t(d)), f AS (SELECT DISTINCT edge_type FROM trade_edges) SELECT (SELECT count(*) FROM d) AS declared, (SELECT count(*) FROM d WHERE lower(d) IN (SELECT lower(edge_type) FROM f)) AS present, round((SELECT count(*) FROM d WHERE lower(d) IN (SELECT lower(edge_type) FROM f)) / 3, 6) AS coverage, (SELECT count(*) FROM f WHERE edge_type NOT IN (SELECT d FROM d)) AS undeclared")
def edge_vocab_coverage(spark, sf_dir):
    return O.edge_vocabulary(S.trade(spark, sf_dir).edges, _rows(spark, "edge_type", ["PART_OF", "located_in", "owns"]))


@query("type_concentration", f"WITH {S.TRADE_SQL} SELECT entity_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM trade_nodes), 6) AS share, count(*) / (SELECT count(*) FROM trade_nodes) > 0.15 AS warning FROM trade_nodes GROUP BY 1")
def type_concentration(spark, sf_dir):
    return O.type_concentration(S.trade(spark, sf_dir).entities, warn=0.15)


@query("ontology_drift", f"WITH {S.TRADE_SQL} SELECT 4::BIGINT AS declared, count(DISTINCT edge_type) AS used, round((4 - count(DISTINCT edge_type)) / 4, 6) AS drift FROM trade_edges WHERE edge_type IN ('part_of', 'located_in', 'owns', 'sells')")
def ontology_drift(spark, sf_dir):
    return O.drift(_rows(spark, "term", ["part_of", "located_in", "owns", "sells"]), O.used_terms(S.trade(spark, sf_dir).edges))


_halls = "h AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'hall_' || event_type WHEN user_id % 3 = 1 AND event_type <> 'view' THEN event_type ELSE 'untyped' END AS hall FROM events)"


@query("hall_usage", f"WITH {_halls} SELECT count(*) AS drawers, count(*) FILTER (hall <> 'untyped') AS populated, count(*) FILTER (replace(hall, 'hall_', '') IN ('click', 'error')) AS in_vocabulary, round(count(*) FILTER (hall <> 'untyped') / count(*), 6) AS populated_share, round(count(*) FILTER (replace(hall, 'hall_', '') IN ('click', 'error')) / count(*) FILTER (hall <> 'untyped'), 6) AS vocabulary_share FROM h")
def hall_usage(spark, sf_dir):
    e = S.read(spark, sf_dir, "events")
    kind = F.when((F.col("user_id") % 3 == 1) & (F.col("event_type") != "view"), F.concat(F.lit("drawer:"), "event_type")).otherwise("drawer")
    nodes = e.select(F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("hall_"), "event_type")).otherwise("").alias("hall"), kind.alias("entity_type"))
    return O.hall_usage(nodes, _rows(spark, "term", ["hall_click", "error"]))


@query("claim_scorecard", "SELECT * FROM (SELECT 'many' AS claim, CASE WHEN count(*) > 5 THEN 'pass' ELSE 'fail' END AS status FROM events UNION ALL SELECT 'dear', CASE WHEN avg(value) >= 1e6 THEN 'pass' ELSE 'fail' END FROM events UNION ALL SELECT 'soul', 'untestable' UNION ALL SELECT 'absent', 'skipped')")
def claim_scorecard(spark, sf_dir):
    e = S.read(spark, sf_dir, "events")
    metrics = e.agg(F.count("*").cast("double").alias("rows"), F.avg("value").alias("mean")).select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("rows", "mean")))).alias("x")).select("x.*")
    claims = spark.createDataFrame([("many", "rows", ">", 5.0, True), ("dear", "mean", ">=", 1e6, True), ("soul", "rows", ">", 0.0, False), ("absent", "none", "<", 1.0, True)], "claim string, metric string, op string, threshold double, testable boolean")
    return O.claim_scorecard(claims, metrics)


@query("introspection", "SELECT page_id AS id, round(((length(url) > 0)::INT + (page_id % 2 = 0)::INT + (html IS NOT NULL AND page_id % 3 = 0)::INT) / 3, 6) AS score FROM pages")
def introspection(spark, sf_dir):
    p = S.read(spark, sf_dir, "pages")
    return O.introspection(p.select(F.col("page_id").alias("id"), F.col("url").alias("schema"), F.when(F.col("page_id") % 2 == 0, "x").otherwise("").alias("stats"), F.when(F.col("page_id") % 3 == 0, "x").alias("provenance")))


@query("external_fit", f"WITH {S.TRADE_SQL}, t AS (SELECT DISTINCT split_part(entity_type, ':', 1) AS term FROM trade_nodes), f AS (SELECT CASE term WHEN 'region' THEN 'under_specified' WHEN 'nation' THEN 'mappable' WHEN 'customer' THEN 'mappable' ELSE 'unaligned' END AS fit FROM t) SELECT fit, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 4) AS share FROM f GROUP BY 1")
def external_fit(spark, sf_dir):
    terms = S.trade(spark, sf_dir).entities.select(F.get(F.split("entity_type", ":"), F.lit(0)).alias("term"))
    mapping = spark.createDataFrame([("region", "schema:Place"), ("region", "geo:Feature"), ("nation", "schema:Country"), ("customer", "schema:Person")], "term string, standard string")
    return O.external_fit(terms, mapping)


@query("shacl_audit", f"WITH {S.TRADE_SQL} SELECT 'has_name' AS \"constraint\", count(*) AS checked, CAST(0 AS BIGINT) AS failed, CAST(NULL AS VARCHAR) AS severity FROM trade_nodes UNION ALL SELECT 'has_type', count(*), 0, NULL FROM trade_nodes UNION ALL SELECT 'no_self_edge', count(*), 0, NULL FROM trade_edges UNION ALL SELECT 'target_exists', count(*), count(*) FILTER (target_id LIKE 'region:%'), 'Violation' FROM trade_edges UNION ALL SELECT 'iso_date', count(*), count(*) FILTER (id LIKE '%7'), 'Info' FROM trade_nodes WHERE id NOT LIKE 'region:%'".replace("'has_name' AS \"constraint\", count(*) AS checked, CAST(0 AS BIGINT) AS failed, CAST(NULL AS VARCHAR) AS severity FROM trade_nodes", "'has_name' AS \"constraint\", count(*) AS checked, CAST(0 AS BIGINT) AS failed, CAST(NULL AS VARCHAR) AS severity FROM trade_nodes WHERE entity_type <> 'region'").replace("'has_type', count(*), 0, NULL FROM trade_nodes", "'has_type', count(*), 0, NULL FROM trade_nodes WHERE entity_type <> 'region'"))
def shacl_audit(spark, sf_dir):
    g = S.trade(spark, sf_dir)
    nodes = g.entities.where("entity_type <> 'region'").withColumn("date", F.when(F.col("id").endswith("7"), "7 May 2023").otherwise("2023-05-07T10:00Z"))
    return O.audit(nodes, g.edges, {"iso_date": 0.5})


_map = "CASE edge_type WHEN 'located_in' THEN 'placed' WHEN 'based_in' THEN 'placed' ELSE edge_type END"


@query("counterfactual", f"""WITH {S.TRADE_SQL}, r AS (SELECT 0 AS k, edge_type FROM trade_edges UNION ALL SELECT 1, {_map} FROM trade_edges), c AS (SELECT k, edge_type, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT k, sum(n) AS t FROM c GROUP BY 1),
    m AS (SELECT k, count(*)::DOUBLE AS types, round(sum(-(n / t) * log2(n / t)), 6) AS entropy, round(max(n) / max(t), 6) AS dominant_share FROM c JOIN t USING (k) GROUP BY 1),
    l AS (SELECT k, 'types' AS reading, types AS v FROM m UNION ALL SELECT k, 'entropy', entropy FROM m UNION ALL SELECT k, 'dominant_share', dominant_share FROM m)
    SELECT a.reading AS reading, a.v AS before, b.v AS after FROM l a JOIN l b ON a.reading = b.reading AND a.k = 0 AND b.k = 1""")
def counterfactual(spark, sf_dir):
    mapping = spark.createDataFrame([("located_in", "placed", 0.9), ("located_in", "other", 0.3), ("based_in", "zplaced", 0.8), ("based_in", "placed", 0.8)], "edge_type string, to string, confidence double")
    return O.counterfactual(S.trade(spark, sf_dir).edges, mapping)


@query("ontology_sensitivity", f"""WITH {S.TRADE_SQL}, r AS (SELECT 0 AS k, edge_type FROM trade_edges UNION ALL SELECT 1, 'edge' FROM trade_edges UNION ALL SELECT 2, edge_type || ':' || CAST(length(source_id) AS VARCHAR) FROM trade_edges), c AS (SELECT k, edge_type, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT k, sum(n) AS t, count(*) AS j FROM c GROUP BY 1),
    m AS (SELECT k, max(j)::DOUBLE AS types, max(t)::DOUBLE AS total, CASE WHEN max(j) <= 1 THEN 0 ELSE round(sum(-(n / t) * log2(n / t)), 6) END AS entropy, round(max(n) / max(t), 6) AS dominant_share FROM c JOIN t USING (k) GROUP BY 1),
    l AS (SELECT 'types' AS reading, types AS v FROM m UNION ALL SELECT 'total', total FROM m UNION ALL SELECT 'entropy', entropy FROM m UNION ALL SELECT 'dominant_share', dominant_share FROM m),
    a AS (SELECT reading, min(v) AS low, max(v) AS high, avg(v) AS mean FROM l GROUP BY 1)
    SELECT reading, low, high, round(high - low, 6) AS spread, round((high - low) / nullif(abs(mean), 0), 6) AS relative, CASE WHEN mean = 0 AND high - low < 1 THEN 'stable' WHEN mean <> 0 AND (high - low) / abs(mean) < 0.1 THEN 'stable' ELSE 'sensitive' END AS verdict FROM a""")
def ontology_sensitivity(spark, sf_dir):
    maps = {"as_is": F.col("edge_type"), "flat": F.lit("edge"), "fine": F.concat("edge_type", F.lit(":"), F.length("source_id").cast("string"))}
    return O.sensitivity(S.trade(spark, sf_dir).edges, maps)


_fine = {"kind": "['person', 'organization', 'publication', 'breed'][1 + doc_id % 4]", "folder": "['behavioral_research', 'veterinary_research', 'community_journalism', 'municipal_policy', 'breed_standards', 'other'][1 + doc_id % 6]"}


@query(
    "fine_mapping",
    f"""WITH d AS (SELECT doc_id, {_fine['kind']} AS kind, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {_fine['folder']} END AS dom, CASE WHEN doc_id % 2 = 0 THEN 'mentions' ELSE 'bred_by' END AS edge, lower(coalesce(text, '')) || CASE WHEN doc_id % 3 = 0 THEN ' cited ' WHEN doc_id % 5 = 0 THEN ' a study ' ELSE '' END AS ev FROM documents)
    SELECT doc_id, CASE kind
        WHEN 'person' THEN CASE WHEN dom IN ('behavioral_research', 'veterinary_research') THEN 'researcher' WHEN dom = 'community_journalism' THEN 'journalist' WHEN dom = 'municipal_policy' THEN 'official' ELSE 'person_other' END
        WHEN 'organization' THEN CASE WHEN dom = 'breed_standards' THEN 'kennel_club' WHEN dom IN ('behavioral_research', 'veterinary_research') THEN 'research_org' WHEN dom = 'municipal_policy' THEN 'regulatory_body' ELSE 'organization_other' END
        WHEN 'publication' THEN CASE WHEN dom = 'breed_standards' THEN 'breed_standard' WHEN dom = 'municipal_policy' THEN 'bylaw' WHEN dom = 'community_journalism' THEN 'article' ELSE 'study' END
        ELSE kind END AS entity_type,
        CASE WHEN edge <> 'mentions' THEN edge WHEN contains(ev, 'cite') OR contains(ev, 'reference') THEN 'mentions_citation' WHEN contains(ev, 'study') OR contains(ev, 'research') OR contains(ev, 'found') THEN 'mentions_finding' ELSE 'mentions_general' END AS edge_type
    FROM d""",
)
def fine_mapping(spark, sf_dir):
    """Documents as entities of four kinds in seven folders, and as edges whose evidence is the text."""
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % len(x) + 1).cast("int"))
    folder = pick("behavioral_research", "veterinary_research", "community_journalism", "municipal_policy", "breed_standards", "other")
    note = F.when(F.col("doc_id") % 7 == 0, "bare.md").otherwise(F.concat(folder, F.lit("/note.md")))
    more = F.when(F.col("doc_id") % 3 == 0, " CITED ").when(F.col("doc_id") % 5 == 0, " a Study ").otherwise("")
    kind, edge = pick("person", "organization", "publication", "breed"), F.when(F.col("doc_id") % 2 == 0, "mentions").otherwise("bred_by")
    d = S.read(spark, sf_dir, "documents")
    return d.select("doc_id", O.fine_entity_type(kind, note).alias("entity_type"), O.fine_edge_type(edge, F.concat(F.coalesce("text", F.lit("")), more)).alias("edge_type"))

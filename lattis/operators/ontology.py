"""Ontology coherence: coverage, drift, halls, claims, external fit, counterfactuals, sensitivity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattis.operators.integrity import edge_type_distribution, monoculture
from lattis.operators.ranks import share


def type_coverage(nodes: DataFrame, declared: DataFrame) -> DataFrame:
    """One row: declared, present, coverage, undeclared types (ONT1).

    A found type is declared if it equals a declared one or continues it
    after a colon. Nothing declared is a coverage of 1.
    """
    found = nodes.where("coalesce(entity_type, '') <> ''").select("entity_type").distinct()
    prefixes = found.select("entity_type", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("entity_type", ":"))), lambda i: F.array_join(F.slice(F.split("entity_type", ":"), 1, i), ":"))).alias("d"))
    hit = prefixes.join(declared.select(F.col("entity_type").alias("d")).distinct(), "d")
    n = declared.agg(F.count_distinct("entity_type").alias("declared")).crossJoin(hit.agg(F.count_distinct("d").alias("present"), F.count_distinct("entity_type").alias("known"))).crossJoin(found.agg(F.count("*").alias("found")))
    return n.select("declared", "present", F.round(F.coalesce(F.try_divide(F.col("present").cast("double"), F.col("declared")), F.lit(1.0)), 6).alias("coverage"), (F.col("found") - F.col("known")).alias("undeclared"))


def edge_vocabulary(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """One row: declared, present exactly or but for case, coverage, undeclared by exact name (ONT2)."""
    found = edges.where("coalesce(edge_type, '') <> ''").select("edge_type").distinct()
    names = declared.select("edge_type").distinct()
    low = lambda df: df.withColumn("low", F.lower("edge_type"))
    present = low(names).join(low(found).select("low").distinct(), "low", "left_semi").agg(F.count("*").alias("present"))
    undeclared = found.join(names, "edge_type", "left_anti").agg(F.count("*").alias("undeclared"))
    n = names.agg(F.count("*").alias("declared")).crossJoin(present).crossJoin(undeclared)
    return n.select("declared", "present", F.round(F.coalesce(F.try_divide(F.col("present").cast("double"), F.col("declared")), F.lit(1.0)), 6).alias("coverage"), "undeclared")


def type_concentration(nodes: DataFrame, warn: float = 0.8) -> DataFrame:
    """``(entity_type, n, share, warning)`` (ONT3)."""
    counts = nodes.groupBy("entity_type").agg(F.count("*").alias("n"))
    s = F.col("n") / F.col("total")
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select("entity_type", "n", F.round(s, 6).alias("share"), (s > warn).alias("warning"))


def drift(declared: DataFrame, used: DataFrame) -> DataFrame:
    """One row: declared terms, those used, share unused (ONT4)."""
    d, u = declared.select("term").distinct(), used.select("term").distinct()
    n = d.agg(F.count("*").alias("declared")).crossJoin(d.join(u, "term", "left_semi").agg(F.count("*").alias("used")))
    return n.select("declared", "used", share(F.col("declared") - F.col("used"), F.col("declared")).alias("drift"))


def hall_usage(nodes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: drawers, populated, in the vocabulary (``hall_`` may be left out), and their shares (ONT5)."""
    hall = F.coalesce(F.when(F.col("hall") != "", F.col("hall")), F.expr("nullif(split_part(entity_type, ':', 2), '')"), F.lit("untyped"))
    drawers = nodes.where("entity_type like 'drawer%'").select(hall.alias("hall"))
    own = vocabulary.select(F.regexp_replace("term", "^hall_", "").alias("short")).distinct().withColumn("known", F.lit(True))
    joined = drawers.withColumn("short", F.regexp_replace("hall", "^hall_", "")).join(own, "short", "left")
    populated = F.col("hall") != "untyped"
    agg = joined.agg(F.count("*").alias("drawers"), F.count_if(populated).alias("populated"), F.count_if(populated & F.col("known").isNotNull()).alias("in_vocabulary"))
    return agg.select("drawers", "populated", "in_vocabulary", share(F.col("populated"), F.col("drawers")).alias("populated_share"), share(F.col("in_vocabulary"), F.col("populated")).alias("vocabulary_share"))


def claim_scorecard(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """``(claim, status)`` of claims ``(claim, metric, op, threshold, testable)`` against ``(metric, value)`` (ONT6).

    ``op`` is one of > >= < <=. Untestable claims say so; those whose metric
    isn't there, or is null, are skipped.
    """
    joined = claims.join(metrics, "metric", "left")
    v, t = F.col("value"), F.col("threshold")
    ok = F.when(F.col("op") == ">", v > t).when(F.col("op") == ">=", v >= t).when(F.col("op") == "<", v < t).when(F.col("op") == "<=", v <= t)
    return joined.select("claim", F.when(~F.col("testable"), "untestable").when(ok.isNull(), "skipped").when(ok, "pass").otherwise("fail").alias("status"))


def introspection(reports: DataFrame) -> DataFrame:
    """``(id, score)``: the share of three dimensions that a report fills (ONT7)."""
    filled = sum((F.coalesce(F.length(c) > 0, F.lit(False)).cast("int") for c in ("schema", "stats")), F.coalesce(F.length("provenance") > 0, F.lit(False)).cast("int"))
    return reports.select("id", F.round(filled / 3, 6).alias("score"))


def external_fit(terms: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(fit, n, share)``: terms with one standard term, with several, with none (ONT8)."""
    per = terms.select("term").distinct().join(mapping.select("term", "standard").distinct(), "term", "left").groupBy("term").agg(F.count("standard").alias("k"))
    fit = F.when(F.col("k") == 0, "unaligned").when(F.col("k") == 1, "mappable").otherwise("under_specified")
    counts = per.groupBy(fit.alias("fit")).agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select("fit", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


#: A date or time by its form.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def audit(nodes: DataFrame, edges: DataFrame, confidence: Mapping[str, float], gate: float = 0.85) -> DataFrame:
    """``(constraint, checked, failed, severity)`` of the shape constraints that have data (ONT8).

    Constraints: names aren't empty, types aren't empty, dates have ISO form,
    ends exist, no edge joins a node to itself. Below the confidence gate a
    failure is Info, else a Violation.
    """
    ids = nodes.select("id").distinct()
    rows = [
        ("has_name", nodes.agg(F.count("*").alias("checked"), F.count_if(F.coalesce("name", F.lit("")) == "").alias("failed"))),
        ("has_type", nodes.agg(F.count("*").alias("checked"), F.count_if(F.coalesce("entity_type", F.lit("")) == "").alias("failed"))),
        ("no_self_edge", edges.agg(F.count("*").alias("checked"), F.count_if(F.col("source_id") == F.col("target_id")).alias("failed"))),
        ("target_exists", edges.join(ids.select(F.col("id").alias("target_id"), F.lit(1).alias("known")), "target_id", "left").agg(F.count("*").alias("checked"), F.count_if(F.col("known").isNull()).alias("failed"))),
    ]
    if "date" in nodes.columns:
        rows.append(("iso_date", nodes.where("date is not null").agg(F.count("*").alias("checked"), F.count_if(~F.col("date").rlike(ISO_DATE)).alias("failed"))))
    out = None
    for name, df in rows:
        level = "Violation" if confidence.get(name, 1.0) >= gate else "Info"
        part = df.where("checked > 0").select(F.lit(name).alias("constraint"), "checked", "failed", F.when(F.col("failed") > 0, level).alias("severity"))
        out = part if out is None else out.unionByName(part)
    return out


def retype(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges under mapped types: the mapping of most confidence, ties to the first term (ONT9)."""
    best = mapping.groupBy("edge_type").agg(F.min_by("to", F.struct(-F.col("confidence"), "to")).alias("to"))
    return edges.join(best, "edge_type", "left").withColumn("edge_type", F.coalesce("to", "edge_type")).select(edges.columns)


def counterfactual(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(reading, before, after)`` of the vocabulary's readings under a mapping (ONT9)."""
    b, a = (monoculture(e).select("types", "entropy", "dominant_share") for e in (edges, retype(edges, mapping)))
    long = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("reading"), F.col(c).cast("double").alias(name)) for c in df.columns))).alias("x")).select("x.*")
    return long(b, "before").join(long(a, "after"), "reading")


def sensitivity(edges: DataFrame, mappings: Mapping[str, Column], stable: float = 0.1) -> DataFrame:
    """``(reading, low, high, spread, relative, verdict)`` over named type mappings (ONT10).

    A reading is stable if its spread is under ``stable`` of its mean's size,
    or under 1 if the mean is 0.
    """
    out = None
    for name, to in mappings.items():
        m = monoculture(edges.withColumn("edge_type", to))
        part = m.select(F.lit(name).alias("mapping"), F.explode(F.array(*(F.struct(F.lit(c).alias("reading"), F.col(c).cast("double").alias("value")) for c in ("types", "total", "entropy", "dominant_share")))).alias("x")).select("mapping", "x.*")
        out = part if out is None else out.unionByName(part)
    agg = out.groupBy("reading").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))
    spread = F.col("high") - F.col("low")
    relative = F.when(F.col("mean") != 0, spread / F.abs("mean"))
    ok = F.when(F.col("mean") == 0, spread < 1).otherwise(relative < stable)
    return agg.select("reading", "low", "high", F.round(spread, 6).alias("spread"), F.round(relative, 6).alias("relative"), F.when(ok, "stable").otherwise("sensitive").alias("verdict"))


def used_terms(edges: DataFrame) -> DataFrame:
    return edge_type_distribution(edges).select(F.col("edge_type").alias("term"))


#: Finer types by what an entity is and the folder of its note; '' is any other folder.
FINE_TYPES = {
    "person": {"behavioral_research": "researcher", "veterinary_research": "researcher", "community_journalism": "journalist", "municipal_policy": "official", "": "person_other"},
    "organization": {"breed_standards": "kennel_club", "behavioral_research": "research_org", "veterinary_research": "research_org", "municipal_policy": "regulatory_body", "": "organization_other"},
    "publication": {"breed_standards": "breed_standard", "municipal_policy": "bylaw", "community_journalism": "article", "": "study"},
}
#: What evidence of a mention tells; the first that holds counts.
FINE_MENTIONS = (("mentions_citation", ("cite", "reference")), ("mentions_finding", ("study", "research", "found")))


def fine_entity_type(entity_type: Column, source_note: Column) -> Column:
    """The finer type of an entity by the top folder of its note (ONT11); other types stay."""
    domain = F.when(F.contains(source_note, F.lit("/")), F.split(source_note, "/")[0]).otherwise("")
    found = entity_type
    for kind, by_domain in FINE_TYPES.items():
        rest = [(d, fine) for d, fine in by_domain.items() if d]
        fine = F.lit(by_domain[""])
        for d, name in rest:
            fine = F.when(domain == d, F.lit(name)).otherwise(fine)
        found = F.when(entity_type == kind, fine).otherwise(found)
    return found


def fine_edge_type(edge_type: Column, evidence: Column) -> Column:
    """``mentions`` by what the evidence says of it (ONT11); other types stay."""
    low = F.lower(F.coalesce(evidence, F.lit("")))
    fine = F.lit("mentions_general")
    for name, words in reversed(FINE_MENTIONS):
        held = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            held = held | F.contains(low, F.lit(w))
        fine = F.when(held, F.lit(name)).otherwise(fine)
    return F.when(edge_type == "mentions", fine).otherwise(edge_type)

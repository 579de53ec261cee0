"""Contradiction, supersession, phantom edges, defects and their detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattis.operators.integrity import CONTRADICTS, SUPERSEDES, collision_groups, keepers, normalize_predicate
from lattis.session import materialize


def is_supersedes(edge_type: Column) -> Column:
    return normalize_predicate(edge_type).isin(*SUPERSEDES)


def is_contradicts(edge_type: Column) -> Column:
    return normalize_predicate(edge_type).isin(*CONTRADICTS)


def superseded_by(edges: DataFrame, order: str = "seq") -> DataFrame:
    """``(id, by)``: what supersedes each superseded entity; the last edge wins (REL1)."""
    return edges.where(is_supersedes(F.col("edge_type"))).groupBy(F.col("target_id").alias("id")).agg(F.max_by("source_id", F.struct(F.col(order), F.col("source_id"))).alias("by"))


def stamp_superseded(edges: DataFrame, order: str = "seq") -> DataFrame:
    """Edges with ``superseded_by`` where their source is superseded (REL1).

    Typed supersession edges aren't stamped themselves. Stamping twice
    changes nothing.
    """
    by = superseded_by(edges, order)
    rest = edges.drop("superseded_by") if "superseded_by" in edges.columns else edges
    joined = rest.join(by.withColumnsRenamed({"id": "source_id"}), "source_id", "left")
    return joined.withColumn("superseded_by", F.when(~is_supersedes(F.col("edge_type")), F.col("by"))).drop("by")


def supersession_chains(edges: DataFrame) -> DataFrame:
    """``(head, length, chain)`` from the oldest to the head that nothing supersedes (REL5).

    Of several things that one supersedes the smallest id counts. Steps are
    doubled: a round joins every place reached so far with the jump that is
    twice as far, so the rounds are logarithmic in the longest chain. A head
    that leads into a circle is an error.
    """
    jump = materialize(edges.where(is_supersedes(F.col("edge_type")) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).groupBy(F.col("source_id").alias("x")).agg(F.min("target_id").alias("to")))
    most, far = jump.count(), 1
    reached = materialize(jump.join(jump.select(F.col("to").alias("x")).distinct(), "x", "left_anti").select(F.col("x").alias("head"), "x", F.lit(0).cast("long").alias("at")))
    while True:
        further = materialize(reached.join(jump, "x").select("head", F.col("to").alias("x"), (F.col("at") + far).alias("at")))
        if further.isEmpty():
            break
        if far > most:
            raise ValueError("a supersession leads into a circle")
        reached = materialize(reached.unionByName(further))
        jump = materialize(jump.join(jump.select(F.col("x").alias("to"), F.col("to").alias("next")), "to").select("x", F.col("next").alias("to")))
        far *= 2
    members = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("at"), "x"))), lambda m: m["x"])
    return reached.groupBy("head").agg(F.count("*").cast("int").alias("length"), F.array_join(members, ">").alias("chain"))


def supersession_report(edges: DataFrame, strict: bool = False, order: str = "seq") -> DataFrame:
    """One row: seeded, resolved, superseded entities, completeness (REL4).

    An edge with both ends is resolved; ``strict`` asks that the target's
    replacement be recorded, too.
    """
    typed = edges.where(is_supersedes(F.col("edge_type")))
    ok = (F.coalesce("source_id", F.lit("")) != "") & (F.coalesce("target_id", F.lit("")) != "")
    if strict:
        ok = ok & F.col("superseded_by").isNotNull()
    resolved = F.count_if(ok)
    return typed.agg(F.count("*").alias("seeded"), resolved.alias("resolved"), F.count_distinct("target_id").alias("superseded"), F.round(F.coalesce(F.try_divide(resolved.cast("double"), F.count("*")), F.lit(0.0)), 6).alias("completeness"))


def contradiction_pairs(edges: DataFrame, names: DataFrame, order: str = "seq") -> DataFrame:
    """``(a, b, claim_a)``: unordered pairs of typed edges; the first edge's evidence, else name, is the claim (REL2)."""
    typed = edges.where(is_contradicts(F.col("edge_type"))).withColumns({"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")})
    first = typed.groupBy("a", "b").agg(F.min_by(F.struct("source_id", "evidence"), F.struct(F.col(order), F.col("source_id"))).alias("x")).select("a", "b", "x.*")
    named = first.join(names.select(F.col("id").alias("source_id"), "name"), "source_id", "left")
    return named.select("a", "b", F.coalesce(F.when(F.col("evidence") != "", F.col("evidence")), F.col("name"), F.col("source_id")).alias("claim_a"))


def contradiction_report(seeded: DataFrame, surfaced: DataFrame) -> DataFrame:
    """One row: seeded and surfaced pairs, matches, detection and precision (REL3); surfaced pairs aren't deduped."""
    key = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    seeds = seeded.select(*key).distinct()
    hit = surfaced.select(*key).distinct().join(seeds, ["a", "b"], "left_semi").agg(F.count("*").alias("matched"))
    n = seeds.agg(F.count("*").alias("seeded")).crossJoin(surfaced.agg(F.count("*").alias("surfaced"))).crossJoin(hit)
    ratio = lambda y: F.round(F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col(y)), F.lit(0.0)), 6)
    return n.select("seeded", "surfaced", "matched", ratio("seeded").alias("detection"), ratio("surfaced").alias("precision"))


#: Words that name nothing.
STOP_WORDS = (
    *("the", "a", "an", "of", "and", "or", "for", "to", "in", "on", "at"),
    *("by", "with", "from", "as", "is", "are", "was", "were", "be", "been"),
    *("dog", "dogs", "pet", "canine"),
)


def content_tokens(text: Column) -> Column:
    """Distinct ``[a-z0-9]+`` tokens, stop words left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def phantom_edges(edges: DataFrame, names: DataFrame, bodies: DataFrame, least: float = 0.5) -> DataFrame:
    """``(seq, checkable, phantom, missing)`` of each edge whose note has a body (PHN1).

    An entity is present if one of its forms (``names``: id, forms) has at
    least ``least`` of its tokens in the body. An end without a usable form
    makes the edge uncheckable. ``missing`` is source, target or both.
    """
    forms = names.select("id", F.filter(F.transform("forms", content_tokens), lambda f: F.size(f) > 0).alias("forms"))
    body = bodies.select("source_note", content_tokens(F.col("body")).alias("body"))
    joined = edges.join(body, "source_note")
    for end in ("source", "target"):
        joined = joined.join(forms.select(F.col("id").alias(f"{end}_id"), F.col("forms").alias(f"{end}_forms")), f"{end}_id", "left")
        share = lambda f: F.size(F.array_intersect(f, F.col("body"))) / F.size(f)
        joined = joined.withColumn(end, F.when(F.coalesce(F.size(f"{end}_forms"), F.lit(0)) > 0, F.exists(f"{end}_forms", lambda f: share(f) >= least)))
    checkable = F.col("source").isNotNull() & F.col("target").isNotNull()
    missing = F.when(~F.col("source") & ~F.col("target"), "both").when(~F.col("source"), "source").when(~F.col("target"), "target")
    return joined.select("seq", checkable.alias("checkable"), (checkable & missing.isNotNull()).alias("phantom"), F.when(checkable, missing).alias("missing"))


# ------------------------------------------------------------------ defects


def _draw(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    return nodes.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id"))), "id").limit(n)


def inject_duplicates(nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Clones of ``n`` named entities, upper-cased, under ids of their own (DOC1)."""
    chosen = _draw(nodes.where("name <> ''"), n, seed)
    return chosen.select(F.concat(F.lit("__dup_"), "id").alias("id"), F.upper("name").alias("name"), "entity_type")


def inject_orphans(spark, n: int) -> DataFrame:
    """Entities that no edge names (DOC2)."""
    return spark.range(n).select(F.concat(F.lit("__orphan_"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("orphan "), F.col("id").cast("string")).alias("name"), F.lit("orphan").alias("entity_type"))


def inject_broken_refs(nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Edges to targets that don't exist (DOC3)."""
    return _draw(nodes, n, seed).select(F.col("id").alias("source_id"), F.concat(F.lit("__absent_"), "id").alias("target_id"), F.lit("refers_to").alias("edge_type"))


def inject_phantoms(nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Edges between real entities, on a note with an empty body (DOC4)."""
    w = Window.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id"))), "id")
    drawn = _draw(nodes, n + 1, seed).withColumn("next", F.lead("id").over(w)).where("next is not null")
    return drawn.select(F.col("id").alias("source_id"), F.col("next").alias("target_id"), F.lit("phantom_link").alias("edge_type"), F.lit("__empty_note").alias("source_note"))


def inject_monoculture(edges: DataFrame, n: int) -> DataFrame:
    """``n`` more edges of the type that dominates (ties: the last name) (DOC5)."""
    counts = edges.groupBy("edge_type").agg(F.count("*").alias("c"))
    top = counts.agg(F.max_by("edge_type", F.struct("c", "edge_type")).alias("edge_type"))
    rows = edges.join(F.broadcast(top), "edge_type").select("source_id", "target_id", "edge_type")
    return rows.orderBy(F.md5(F.concat_ws("|", "source_id", "target_id")), "source_id", "target_id").limit(n)


def detect_duplicates(nodes: DataFrame, edges: DataFrame, largest_id: bool = True) -> DataFrame:
    """``(id)`` of colliding entities that aren't their group's keeper (DOC6)."""
    from lattis.operators.integrity import canonical_key

    kept = keepers(nodes, edges, largest_id).select("key", "keeper")
    keyed = nodes.select("id", canonical_key(F.col("name"), F.col("entity_type")).alias("key"))
    return keyed.join(kept, "key").where("id <> keeper").select("id")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id)`` of entities that no edge names (DOC6, JN3)."""
    named = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    return nodes.select("id").distinct().join(named, "id", "left_anti")


def broken_refs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, side, n)`` of edge ends that are no entity (DOC6, JN4)."""
    ends = edges.select(F.col("source_id").alias("id"), F.lit("source").alias("side")).union(edges.select("target_id", F.lit("target")))
    return ends.join(nodes.select("id").distinct(), "id", "left_anti").groupBy("id", "side").agg(F.count("*").alias("n"))


def defect_recall(expected: DataFrame, flagged: DataFrame, flagged_before: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """One row: expected, found, recall, newly flagged, precision of the new flags (DOC7).

    Nothing expected is a recall of 1; nothing newly flagged a precision of 1.
    """
    keys = list(keys)
    want, got = expected.select(*keys).distinct(), flagged.select(*keys).distinct()
    new = got.join(flagged_before.select(*keys).distinct(), keys, "left_anti")
    n = want.agg(F.count("*").alias("expected")).crossJoin(want.join(got, keys, "left_semi").agg(F.count("*").alias("found"))).crossJoin(new.agg(F.count("*").alias("new"))).crossJoin(new.join(want, keys, "left_semi").agg(F.count("*").alias("new_expected")))
    ratio = lambda x, y: F.round(F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y)), F.lit(1.0)), 6)
    return n.select("expected", "found", ratio("found", "expected").alias("recall"), "new", ratio("new_expected", "new").alias("delta_precision"))


def collision_summary(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest colliding groups, for display."""
    return collision_groups(nodes).orderBy(F.desc("ids"), "key").limit(k)

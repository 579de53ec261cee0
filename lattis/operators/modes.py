"""The four ways in which a graph store answers a question, for many questions at once (RET8).

A store is nodes ``(id, entity_type, name, description, text)`` and directed
edges ``(source_id, target_id, edge_type)``; the last two node columns may be
missing. Questions are ``(qid, text)``. Where a store takes rows in the order
it keeps them, ids decide here.

Results have the columns ``qid, mode, rank, id, detail``: ``mode`` is the one
that answered, after those before it had found nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattis.operators.paths import shortest_paths
from lattis.operators.retrieval import top
from lattis.operators.substrings import containing
from lattis.session import materialize


def search_words(text: Column, most: int, fallback: int = 0) -> Column:
    """The first ``most`` words of over two characters; if there are none, the first ``fallback`` words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    long = F.filter(words, lambda w: F.length(w) > 2)
    return F.when(F.size(long) > 0, F.slice(long, 1, most)).otherwise(F.slice(words, 1, fallback) if fallback else F.array().cast("array<string>"))


def _full(nodes: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    have = lambda c: F.col(c) if c in nodes.columns else null.alias(c)
    return nodes.select("id", "entity_type", "name", have("description"), have("text")).where("name is not null")


def _asked(questions: DataFrame, most: int, fallback: int = 0) -> DataFrame:
    return questions.select("qid", search_words(F.col("text"), most, fallback).alias("terms"))


def _by_name(asked: DataFrame, nodes: DataFrame, per_type: int) -> DataFrame:
    """``(qid, id, entity_type)``: of each type the ``per_type`` smallest ids whose name holds a term."""
    words = asked.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    hits = containing(words.select("term"), nodes.select("id", F.col("name").alias("body")))
    found = words.join(hits, "term").select("qid", "id").distinct().join(nodes.select("id", "entity_type"), "id")
    return top(found, ["qid", "entity_type"], [F.col("id")], per_type).select("qid", "id", "entity_type")


def semantic(questions: DataFrame, nodes: DataFrame, n: int = 5) -> DataFrame:
    """Nodes whose name or description holds a term, by the number of terms in their context; ``detail`` is that number.

    The context is ``[type/id] name`` and the first 300 characters of the
    text, or the name again where there is none.
    """
    nodes, every = _full(nodes), materialize(_asked(questions, 5, 3), "asked")
    asked = every.groupBy("terms").agg(F.min("qid").alias("qid"))  # questions of equal terms are asked once
    words = asked.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    bodies = nodes.select("id", F.col("name").alias("body")).unionAll(nodes.select("id", "description"))
    met = words.join(containing(words.select("term"), bodies), "term").select("qid", "id").distinct()
    context = F.lower(F.concat(F.lit("["), F.coalesce("entity_type", F.lit("")), F.lit("/"), F.col("id").cast("string"), F.lit("] "), "name", F.lit("\n"), F.substring(F.coalesce("text", "name"), 1, 300)))
    scored = met.join(nodes, "id").withColumn("_c", context).join(asked, "qid").withColumn("score", F.size(F.filter("terms", lambda t: F.contains(F.col("_c"), F.lower(t)))))
    found = _ranked(scored, "semantic", [F.desc("score"), F.col("id")], n, F.col("score").cast("string"))
    back = every.join(asked.withColumnRenamed("qid", "_one"), "terms").select("qid", "_one")
    return found.withColumnRenamed("qid", "_one").join(back, "_one").select("qid", "mode", "rank", "id", "detail")


def _ranked(rows: DataFrame, mode: str, order: list[Column], n: int, detail: Column) -> DataFrame:
    return top(rows, ["qid"], order, n).select("qid", F.lit(mode).alias("mode"), F.col("rank").cast("int").alias("rank"), "id", detail.alias("detail"))


def hybrid(questions: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """Neighbours that edges lead to from the nodes named, then those nodes; without any, as :func:`semantic`.

    Of each type ``n`` named nodes count, and of each edge type ``n`` edges.
    ``detail`` is the edge type by which a neighbour was first reached, and
    null for the named nodes themselves.
    """
    full = _full(nodes)
    seeds = materialize(_by_name(_asked(questions, 5, 3), full, n), "seeds")
    out = edges.join(seeds.select("qid", F.col("id").alias("source_id")), "source_id").select("qid", "source_id", "target_id", "edge_type")
    taken = top(out, ["qid", "edge_type"], [F.col("source_id"), F.col("target_id")], n)
    order = F.struct("edge_type", "source_id", "target_id")
    fresh = taken.withColumnRenamed("target_id", "id").join(seeds.select("qid", "id"), ["qid", "id"], "left_anti").join(full.select("id"), "id", "left_semi")
    first = fresh.withColumnRenamed("id", "target_id").groupBy("qid", F.col("target_id").alias("id")).agg(F.min(order).alias("o"))
    near = first.select("qid", "id", F.lit(0).alias("part"), F.col("o.edge_type").alias("a"), F.col("o.source_id").alias("b"))
    named = seeds.select("qid", "id", F.lit(1).alias("part"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    answered = _ranked(near.unionByName(named), "hybrid", [F.col("part"), F.col("a"), F.col("b"), F.col("id")], n, F.col("a"))
    rest = questions.join(seeds.select("qid").distinct(), "qid", "left_anti")
    return answered.unionByName(semantic(rest, nodes, n))


def graph(questions: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 5, depth: int = 3) -> DataFrame:
    """Nodes within ``depth`` directed steps of those named, nearest first; ``detail`` is the number of steps.

    Only the first three words count, and there is nothing to fall back on.
    A question that has ``n`` nodes isn't followed further, as what comes
    later is farther away.
    """
    full = _full(nodes)
    steps = edges.where("source_id <> target_id").select(F.col("source_id").alias("id"), F.col("target_id").alias("v")).distinct()
    seen = materialize(_by_name(_asked(questions, 3), full, n).select("qid", "id", F.lit(0).alias("d")), "seen")
    rim = seen
    for d in range(1, depth + 1):
        full_up = seen.groupBy("qid").agg(F.count("*").alias("k")).where(F.col("k") >= n)
        reached = rim.join(full_up, "qid", "left_anti").join(steps, "id").select("qid", F.col("v").alias("id")).distinct()
        rim = materialize(reached.join(seen, ["qid", "id"], "left_anti").select("qid", "id", F.lit(d).alias("d")), "rim")
        if rim.isEmpty():
            break
        seen = materialize(seen.unionByName(rim), "seen")
    known = seen.join(full.select("id"), "id", "left_semi")
    return _ranked(known, "graph", [F.col("d"), F.col("id")], n, F.col("d").cast("string"))


def path(questions: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 5, longest: int = 1) -> DataFrame:
    """Paths from three nodes that hold the first word to one that holds the second; without any, as :func:`hybrid`.

    A question of fewer than two words of over two characters is answered as
    by :func:`semantic`. With ``longest`` 1 a path is an edge in its own
    direction; more hops are shortest paths without direction. ``id`` is the
    node a path starts from, ``detail`` the path.
    """
    full = _full(nodes)
    asked = materialize(_asked(questions, 1 << 30), "asked")
    two = asked.where("size(terms) >= 2")
    ends = []
    for k, keep in ((0, 3), (1, 1)):
        found = _by_name(two.select("qid", F.array(F.get("terms", F.lit(k))).alias("terms")), full, 5)
        ends.append(top(found, ["qid"], [F.col("entity_type"), F.col("id")], keep, "at").select("qid", "id", "at"))
    pairs = materialize(ends[0].select("qid", F.col("id").alias("a"), "at").join(ends[1].select("qid", F.col("id").alias("b")), "qid"), "pairs")
    if longest == 1:
        direct = pairs.join(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "edge_type"), ["a", "b"])
        told = top(direct, ["qid", "a", "edge_type"], [F.col("b")], 3, "_k").select("qid", F.col("a").alias("id"), "at", F.col("_k").alias("k"), F.concat("a", F.lit(" --"), "edge_type", F.lit("--> "), "b").alias("way"))
    else:
        told = pairs.join(shortest_paths(edges, pairs, longest).where("hops > 0"), ["a", "b"]).select("qid", F.col("a").alias("id"), "at", F.lit(1).alias("k"), F.array_join("path", " -- ").alias("way"))
    told = materialize(told, "paths")
    answered = _ranked(told, "path", [F.col("at"), F.col("way"), F.col("k")], n, F.col("way"))
    few = questions.join(asked.where("size(terms) < 2"), "qid", "left_semi")
    rest = questions.join(told.select("qid").distinct(), "qid", "left_anti").join(few.select("qid"), "qid", "left_anti")
    return answered.unionByName(hybrid(rest, nodes, edges, n)).unionByName(semantic(few, nodes, n))

"""Graph topology: degrees, health, components, neighbourhoods, brokerage.

Graphs are ``(id, name, entity_type)`` and ``(source_id, target_id,
edge_type)``. A round of an iteration ends in a written table; nothing but
convergence counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattis.operators.components import connected_components
from lattis.operators.paths import Search
from lattis.session import cut_lineage, materialize


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes (TOP1, JN1)."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    return edges.join(ids, F.col("source_id") == F.col("_id"), "left_semi").join(ids, F.col("target_id") == F.col("_id"), "left_semi")


def latest_nodes(nodes: DataFrame, order: str = "seq") -> DataFrame:
    """One row an id: of repeated ids the last write wins (TOP1)."""
    rest = [c for c in nodes.columns if c not in ("id", order)]
    return nodes.groupBy("id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select("id", "x.*")


def simple(edges: DataFrame) -> DataFrame:
    """The undirected simple projection: distinct ``a < b``, no loops."""
    return edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))


def multigraph_degree(edges: DataFrame) -> DataFrame:
    """``(id, degree)`` after direction is erased (TOP6).

    Parallel edges of the two directions share slots, so a pair counts as
    often as its more frequent direction; a loop counts twice.
    """
    counts = edges.groupBy("source_id", "target_id").count()
    pairs = counts.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.max("count").alias("m"))
    ends = pairs.select(F.col("a").alias("id"), "m").union(pairs.select("b", "m"))
    return ends.groupBy("id").agg(F.sum("m").alias("degree"))


def raw_degree(edges: DataFrame) -> DataFrame:
    """``(id, degree)`` over the raw list: in plus out, a loop twice, dangling ids too (TOP7)."""
    return edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).groupBy("id").agg(F.count("*").alias("degree"))


def entropy(counts: DataFrame, n: str = "n") -> DataFrame:
    """``(types, total, entropy, normalized)`` of counts: Shannon bits, 0 for at most one type."""
    total = counts.agg(F.sum(n).alias("total"), F.count("*").alias("types"))
    bits = counts.crossJoin(total).agg(F.first("types").alias("types"), F.first("total").alias("total"), F.sum(-(F.col(n) / F.col("total")) * F.log2(F.col(n) / F.col("total"))).alias("h"))
    h = F.when(F.coalesce("types", F.lit(0)) <= 1, F.lit(0.0)).otherwise(F.greatest("h", F.lit(0.0)))
    return bits.select(F.coalesce("types", F.lit(0)).alias("types"), F.coalesce("total", F.lit(0)).alias("total"), h.alias("entropy"), F.when(F.col("types") > 1, h / F.log2("types")).otherwise(0.0).alias("normalized"))


def components_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every node; an isolated node is its own (TOP3)."""
    found = connected_components(edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")))
    return nodes.select("id").distinct().join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def size_bucket(size: Column) -> Column:
    return F.when(size <= 1, "1").when(size <= 5, "2-5").when(size <= 20, "6-20").otherwise(">20")


def structural_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, components, degrees and the edge types' entropy (TOP2)."""
    valid = valid_edges(edges, nodes)
    sizes = components_of(nodes, valid).groupBy("component").count()
    shape = sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("count"), F.lit(0)).alias("largest_component"), F.coalesce(F.sum("count"), F.lit(0)).alias("nodes"))
    degree = nodes.select("id").distinct().join(multigraph_degree(valid), "id", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    degrees = degree.agg(F.coalesce(F.avg("degree"), F.lit(0.0)).alias("avg_degree"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))
    kinds = entropy(valid.groupBy("edge_type").agg(F.count("*").alias("n"))).select(F.col("total").alias("edges"), F.col("types").alias("edge_types"), F.col("entropy").alias("edge_entropy"))
    types = nodes.agg(F.count_distinct("entity_type").alias("entity_types"))
    ratio = F.when(F.col("nodes") > 0, F.col("largest_component") / F.col("nodes")).otherwise(0.0)
    return shape.crossJoin(degrees).crossJoin(kinds).crossJoin(types).withColumn("largest_ratio", F.round(ratio, 6)).withColumn("avg_degree", F.round("avg_degree", 6)).withColumn("edge_entropy", F.round("edge_entropy", 6))


def isolates_by_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(entity_type, n)`` of nodes that no edge joins to another node (TOP5); a loop joins nothing."""
    ends = edges.where("source_id <> target_id")
    touched = ends.select(F.col("source_id").alias("id")).union(ends.select("target_id")).distinct()
    return nodes.join(touched, "id", "left_anti").groupBy("entity_type").agg(F.count("*").alias("n"))


def filtered_subgraph(edges: DataFrame, types: Sequence[str], include: bool = True) -> DataFrame:
    """Edges of the given types, or of all others; nodes stay as they are (FLT3)."""
    chosen = F.col("edge_type").isin(*types)
    return edges.where(chosen if include else ~F.coalesce(chosen, F.lit(False)))


def edge_type_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(edge_type, components)`` of each type's subgraph on all nodes (TOP17).

    One run over (type, node) keys: nodes that a type doesn't touch are
    components of their own and are counted, not visited.
    """
    key = lambda c: F.to_json(F.struct(F.col("edge_type"), F.col(c).alias("id")))
    keyed = edges.select(key("source_id").alias("src"), key("target_id").alias("dst"))
    found = connected_components(keyed).select(F.get_json_object("node", "$.edge_type").alias("edge_type"), "component")
    per = found.groupBy("edge_type").agg(F.count("*").alias("touched"), F.count_distinct("component").alias("own"))
    return per.crossJoin(nodes.agg(F.count_distinct("id").alias("n"))).select("edge_type", (F.col("n") - F.col("touched") + F.col("own")).alias("components"))


def khop(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """``(root, id, depth)`` of all within ``hops`` of each root, in both directions (TOP18)."""
    steps = both_ways(simple(edges))
    seen = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct()
    edge = seen
    for k in range(1, hops + 1):
        reached = edge.join(steps, F.col("id") == F.col("u")).select("root", F.col("v").alias("id")).distinct()
        edge = materialize(reached.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(edge)
    return seen


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges within a set of nodes (TOP19)."""
    return valid_edges(edges, ids)


def shortest_paths(edges: DataFrame, pairs: DataFrame, longest: int | None = None) -> DataFrame:
    """``(a, b, hops)`` for each asked pair; null hops if apart or further than ``longest`` (TOP20).

    :mod:`lattis.operators.paths` tells the two apart, and gives the nodes between.
    """
    return Search(edges, pairs, longest).hops().select("a", "b", "hops")


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``(communities, modularity)`` of a given ``(id, community)``; edges weigh by their number (TOP8, TOP11)."""
    c = lambda k: partition.select(F.col("id").alias(k), F.col("community").alias(f"c_{k}"))
    ends = edges.join(c("source_id"), "source_id").join(c("target_id"), "target_id")
    inside = ends.where("c_source_id = c_target_id").groupBy(F.col("c_source_id").alias("community")).agg(F.count("*").alias("inside"))
    degree = ends.select(F.col("c_source_id").alias("community")).union(ends.select("c_target_id")).groupBy("community").agg(F.count("*").alias("d"))
    m = ends.agg(F.count("*").alias("m"))
    term = F.coalesce("inside", F.lit(0)) / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2)
    q = degree.join(inside, "community", "left").crossJoin(m).agg(F.count("*").alias("communities"), F.coalesce(F.sum(term), F.lit(0.0)).alias("q"))
    return q.select("communities", F.round("q", 6).alias("modularity"))


def intercommunity_density(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Share of simple edges that join two communities (TOP9)."""
    c = lambda k: partition.select(F.col("id").alias(k), F.col("community").alias(f"c_{k}"))
    ends = simple(edges).join(c("a"), "a").join(c("b"), "b")
    across = F.count_if(F.col("c_a") != F.col("c_b"))
    return ends.agg(F.count("*").alias("edges"), across.alias("across"), F.round(F.coalesce(F.try_divide(across.cast("double"), F.count("*")), F.lit(0.0)), 6).alias("density"))


def type_homogeneity(nodes: DataFrame, partition: DataFrame) -> DataFrame:
    """Largest type's share, summed over communities (TOP10)."""
    per = nodes.join(partition, "id").groupBy("community", "entity_type").count()
    top = per.groupBy("community").agg(F.max("count").alias("top"), F.sum("count").alias("size"))
    return top.agg(F.count("*").alias("communities"), F.round(F.coalesce(F.try_divide(F.sum("top").cast("double"), F.sum("size")), F.lit(0.0)), 6).alias("homogeneity"))


def gini(values: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Gini coefficient of non-negative values, by group (TOP13); 0 if there are none or all are 0.

    Equal values are counted first, so the window runs over distinct values.
    """
    counts = values.groupBy(*by, F.col(x).alias("x")).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by).orderBy("x")
    ranked = counts.withColumn("last", F.sum("k").over(w)).withColumn("ranks", F.col("k") * (2 * F.col("last") - F.col("k") + 1) / 2)
    agg = ranked.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.col("x") * F.col("k")).alias("total"), F.sum(F.col("x") * F.col("ranks")).alias("weighted"))
    g = F.when(F.coalesce("total", F.lit(0.0)) > 0, 2 * F.col("weighted") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0)
    return agg.select(*by, F.round(g, 6).alias("gini"))


def brokers(edges: DataFrame, partition: DataFrame | None = None) -> DataFrame:
    """``(id, degree, constraint, effective_size)`` by Burt on the simple projection (TOP12).

    With a partition, only nodes whose neighbours span two communities or
    more are computed: the semi-join comes before the wedge join. Wedges are
    made around their lower-degree end, so a hub's neighbourhood is never
    squared.
    """
    steps = cut_lineage(both_ways(simple(edges)))
    degree = steps.groupBy("u").agg(F.count("*").alias("d"))
    ego = steps
    if partition is not None:
        spans = steps.join(partition.select(F.col("id").alias("v"), "community"), "v").groupBy("u").agg(F.count_distinct("community").alias("k")).where("k >= 2")
        ego = steps.join(spans, "u", "left_semi")
    ranked = steps.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    up = ranked.where("d < dv or (d = dv and u < v)").select("u", "v")
    wedges = up.select("u", F.col("v").alias("x")).join(up.select("u", F.col("v").alias("y")), "u").where("x < y")
    closed = wedges.join(steps.select(F.col("u").alias("x"), F.col("v").alias("y")), ["x", "y"])
    corner = lambda i, j, q: closed.select(F.col(i).alias("i"), F.col(j).alias("j"), F.col(q).alias("q"))
    triangles = None
    for i, j, q in (("u", "x", "y"), ("u", "y", "x"), ("x", "u", "y"), ("x", "y", "u"), ("y", "u", "x"), ("y", "x", "u")):
        triangles = corner(i, j, q) if triangles is None else triangles.union(corner(i, j, q))
    indirect = triangles.join(degree.select(F.col("u").alias("q"), F.col("d").alias("dq")), "q").groupBy("i", "j").agg(F.sum(1 / F.col("dq")).alias("s"), F.count("*").alias("t"))
    pair = ego.select(F.col("u").alias("i"), F.col("v").alias("j")).join(indirect, ["i", "j"], "left").join(degree.select(F.col("u").alias("i"), F.col("d")), "i")
    share = F.pow((1 + F.coalesce("s", F.lit(0.0))) / F.col("d"), 2)
    return pair.groupBy(F.col("i").alias("id")).agg(F.max("d").alias("degree"), F.sum(share).alias("constraint"), (F.max("d") - F.sum(F.coalesce("t", F.lit(0))) / F.max("d")).alias("effective_size"))


def cyclomatic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dimension of the cycle space of the simple projection: E - V + C (TOP16)."""
    pairs = simple(edges)
    comps = components_of(nodes, edges).agg(F.count_distinct("component").alias("c"), F.count("*").alias("v"))
    return pairs.agg(F.count("*").alias("e")).crossJoin(comps).select("e", "v", "c", (F.col("e") - F.col("v") + F.col("c")).alias("cycles"))


def dag_shape(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Widest fan-in and fan-out, multi-parent share and orphans of child-to-parent edges (TOP21)."""
    parents = edges.groupBy(F.col("source_id").alias("id")).agg(F.count_distinct("target_id").alias("parents"))
    children = edges.groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("source_id").alias("children"))
    per = nodes.select("id").distinct().join(parents, "id", "left").join(children, "id", "left").select(F.coalesce("parents", F.lit(0)).alias("p"), F.coalesce("children", F.lit(0)).alias("c"))
    return per.agg(
        F.coalesce(F.max("p"), F.lit(0)).alias("max_parents"),
        F.coalesce(F.max("c"), F.lit(0)).alias("max_children"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("p") > 1).cast("double"), F.count("*")), F.lit(0.0)), 6).alias("multi_parent_share"),
        F.count_if((F.col("p") == 0) & (F.col("c") == 0)).alias("orphans"),
    )


def taxonomy_pairs(edges: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """``(rank, child_type, parent_type, n, pairs)``: the ``k`` commonest pairs of types that child-to-parent edges join, of ``pairs`` in all (TOP21).

    A type is null where an end is no node; equal counts go by name.
    """
    kind = nodes.groupBy("id").agg(F.min("entity_type").alias("kind"))
    at = lambda c, name: kind.select(F.col("id").alias(c), F.col("kind").alias(name))
    counts = edges.join(at("source_id", "child_type"), "source_id", "left").join(at("target_id", "parent_type"), "target_id", "left").groupBy("child_type", "parent_type").agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "child_type", "parent_type").limit(k)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "child_type", "parent_type")))  # k rows
    return ranked.crossJoin(counts.agg(F.count("*").alias("pairs"))).select("rank", "child_type", "parent_type", "n", "pairs")


def degree_ccdf(edges: DataFrame) -> DataFrame:
    """``(degree, n, ccdf)``: the share of nodes of at least each degree (TOP23)."""
    counts = raw_degree(edges).groupBy("degree").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("degree"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.withColumn("above", F.sum("n").over(w)).crossJoin(total).select("degree", "n", F.round(F.col("above") / F.col("total"), 6).alias("ccdf"))


def prerequisite_tree(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """``(root, depth, id, path)`` down child-to-parent edges, a node once a path (TOP22)."""
    found = roots.select(F.col("id").alias("root"), F.lit(0).alias("depth"), "id", F.array("id").alias("path"))
    level = found
    for k in range(1, depth + 1):
        level = level.join(edges.select("source_id", "target_id").distinct(), F.col("id") == F.col("source_id")).where(~F.array_contains("path", F.col("target_id")))
        level = level.select("root", F.lit(k).alias("depth"), F.col("target_id").alias("id"), F.concat("path", F.array("target_id")).alias("path"))
        found = found.unionByName(level)
    return found.withColumn("path", F.array_join("path", ">"))

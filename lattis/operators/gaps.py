"""Structural gaps: component summaries, candidate gaps, seeded recall, bridges, homology, cycles, communities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lattis.operators import forests
from lattis.operators.topology import both_ways, components_of, simple, size_bucket
from lattis.session import cut_lineage, materialize


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(bucket, components, nodes)`` (TOP4)."""
    sizes = components_of(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.groupBy(size_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("components"), F.sum("n").alias("nodes"))


def candidate_gaps(placed: DataFrame, k: int = 10, least: int = 3, prevalence: float = 0.5) -> DataFrame:
    """The ``k`` best pairs of components that share entity types (GAP1).

    ``placed`` is ``(id, entity_type, component)``. Components of ``least``
    nodes and more count. Types in over ``prevalence`` of them say nothing
    and are dropped; a shared type scores 1/(1 + log2 of its components);
    a pair scores the sum times the root of its smaller size. With at most
    two such components every type scores 1 and none is dropped.

    Not all pairs are formed (:func:`_contenders`); none that is among the
    best is lost.
    """
    sizes = placed.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    total = sizes.agg(F.count("*").alias("sized"))
    held = placed.join(sizes, "component").select("component", "size", "entity_type").distinct()
    spread = held.groupBy("entity_type").agg(F.count("*").alias("n"))
    told = spread.crossJoin(total).where((F.col("sized") <= 2) | (F.col("n") <= prevalence * F.col("sized")))
    rarity = F.when(F.col("sized") <= 2, F.lit(1.0)).otherwise(1 / (1 + F.log2("n")))
    rows = materialize(held.join(told.select("entity_type", rarity.alias("rarity")), "entity_type"), "types")
    scored = _pair_scores(_contenders(rows, k)).select("a", "b", "size_a", "size_b", "shared", F.round("score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), "a", "b").limit(k)


def _pair_scores(rows: DataFrame) -> DataFrame:
    """``(a, b, size_a, size_b, shared, score)`` of all pairs in ``(component, size, entity_type, rarity)`` that share a type."""
    a, b = (rows.select("entity_type", "rarity", F.col("component").alias(f"{x}"), F.col("size").alias(f"size_{x}")) for x in "ab")
    pairs = a.join(b.drop("rarity"), "entity_type").where("a < b").groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("shared"), F.sum("rarity").alias("rarity"))
    return pairs.withColumn("score", F.col("rarity") * F.sqrt(F.least("size_a", "size_b")))


def _contenders(rows: DataFrame, k: int) -> DataFrame:
    """The rows of components that can be in one of the ``k`` best pairs.

    Of components with the same types and size, pairs with those of smaller
    names come first, so the first ``k`` + 1 are enough. Of each type, the
    ``k`` + 1 largest form pairs whose scores bound the k-th best from
    below; a pair scores at most the root of either size times the sum of
    all rarities there, so a component whose own product is below is out.
    """
    per = rows.groupBy("component", "size").agg(F.sum("rarity").alias("weight"), F.count("*").alias("types"), F.sum(F.xxhash64("entity_type").cast("decimal(38,0)")).alias("kind"))
    alike = Window.partitionBy("size", "types", "kind").orderBy("component")
    first = per.withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k + 1).select("component", "size", "weight")
    some = rows.join(first.select("component"), "component", "left_semi")
    largest = some.withColumn("r", F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("size"), "component"))).where(F.col("r") <= k + 1).drop("r")
    best = _pair_scores(largest).orderBy(F.desc("score")).limit(k).agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("bound"))
    within = first.crossJoin(best).where(F.sqrt("size") * F.col("weight") >= F.col("bound") - 2e-6)  # scores are ranked when rounded
    return some.join(within.select("component"), "component", "left_semi")


def seeded_recall(placed: DataFrame, seeds: DataFrame, reported: DataFrame) -> DataFrame:
    """One row: seeds known, recalled, recall, pairs reported, precision by seeds and by pairs (GAP2).

    ``seeds`` is ``(x, y)`` of ids, ``reported`` ``(a, b)`` of components. A
    seed with an unknown end is ignored; one within a component counts but
    can't be recalled.
    """
    at = lambda k: placed.select(F.col("id").alias(k), F.col("component").alias(f"c{k}"))
    known = seeds.join(at("x"), "x").join(at("y"), "y").select(F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b"))
    hit = known.join(reported.select("a", "b", F.lit(1).alias("hit")).distinct(), ["a", "b"], "left")
    seeded = hit.agg(F.count("*").alias("seeds"), F.count("hit").alias("recalled"))
    found = reported.select("a", "b").distinct().join(known.distinct(), ["a", "b"], "left_semi").agg(F.count("*").alias("pairs_hit"))
    n = reported.agg(F.count("*").alias("pairs"))
    ratio = lambda x, y: F.round(F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y)), F.lit(0.0)), 6)
    return seeded.crossJoin(found).crossJoin(n).select("seeds", "recalled", "pairs", ratio("recalled", "seeds").alias("recall"), ratio("recalled", "pairs").alias("seed_precision"), ratio("pairs_hit", "pairs").alias("pair_precision"))


def _by_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Simple edges with their component: ``(component, a, b)``."""
    placed = components_of(nodes, edges)
    return simple(edges).join(placed.select(F.col("id").alias("a"), "component"), "a").select("component", "a", "b")


def _index(pdf: pd.DataFrame) -> tuple[list[str], list[list[int]], list[tuple[int, int]]]:
    ids = sorted(set(pdf["a"]) | set(pdf["b"]))
    at = {x: i for i, x in enumerate(ids)}
    pairs = sorted((at[a], at[b]) for a, b in zip(pdf["a"], pdf["b"]))
    near: list[list[int]] = [[] for _ in ids]
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    return ids, near, pairs


def bridges(nodes: DataFrame | None, edges: DataFrame, rows_a_task: int = 250_000) -> DataFrame:
    """``(a, b)`` simple edges whose removal parts their component (TOP14); see :func:`lattis.operators.forests.bridges`.

    ``nodes`` play no part: one without an edge has no bridge.
    """
    return forests.bridges(edges, rows_a_task=rows_a_task)


def cycle_basis(nodes: DataFrame, edges: DataFrame, k: int = 10, most_nodes: int = 500) -> DataFrame:
    """The ``k`` shortest fundamental cycles a component, as ``(component, length, cycle)`` (TOP16).

    Cycles close the non-tree edges of a breadth-first tree from the
    smallest node. A component of over ``most_nodes`` nodes with a cycle is
    skipped, and has one row with neither length nor cycle.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, near, pairs = _index(pdf)
        out = []
        if len(ids) <= most_nodes:
            parent, depth, queue = {0: -1}, {0: 0}, [0]
            for x in queue:
                for y in near[x]:
                    if y not in parent:
                        parent[y], depth[y] = x, depth[x] + 1
                        queue.append(y)
            for a, b in pairs:
                if parent.get(a) == b or parent.get(b) == a:
                    continue
                left, right = [a], [b]
                while left[-1] != right[-1]:
                    side = left if depth[left[-1]] >= depth[right[-1]] else right
                    side.append(parent[side[-1]])
                ring = left + right[-2::-1]
                out.append((len(ring), sorted(ids[i] for i in ring)))
        out = sorted(out)[:k]
        return pd.DataFrame({"component": pdf["component"].iloc[0], "length": [n for n, _ in out], "cycle": [c for _, c in out]})

    links = _by_component(nodes, edges)
    sizes = links.select("component", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("component").agg(F.count("*").alias("n"))
    # a skipped component's edges never meet in one task
    found = links.join(sizes.where(F.col("n") <= most_nodes), "component", "left_semi").groupBy("component").applyInPandas(walk, "component string, length int, cycle array<string>")
    large = links.groupBy("component").agg(F.count("*").alias("edges")).join(sizes, "component").where((F.col("n") > most_nodes) & (F.col("edges") >= F.col("n")))
    return found.unionByName(large.select("component", F.lit(None).cast("int").alias("length"), F.lit(None).cast("array<string>").alias("cycle")))


def betti(nodes: DataFrame, edges: DataFrame, most_nodes: int = 2_000, largest_only: bool = True, subsample: bool = False, seed: int = 42) -> DataFrame:
    """``(component, nodes, beta0, beta1, max_persistence, skipped)`` of the hop metric's Rips filtration (TOP15).

    Persistent homology over the field of two elements, to dimension 1:
    ``beta1`` counts the finite bars of positive length. Fewer than three
    nodes give (1, 0). A component of over ``most_nodes`` is skipped: its row
    has zeros and says so. With ``subsample`` the part that ``most_nodes`` of
    its nodes induce, drawn by a hash with ``seed``, stands for it instead;
    ``nodes`` is then their number and ``beta0`` that of the part's pieces.
    """
    placed = components_of(nodes, edges)
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    if largest_only:
        sizes = sizes.orderBy(F.desc("n"), "component").limit(1)
    large = F.col("n") > most_nodes
    own = placed.join(sizes if subsample else sizes.where(~large), "component").select("component", F.col("id").alias("a"), "n")
    links = _by_component(nodes, edges)
    if subsample:
        drawn = Window.partitionBy("component").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("a"))), "a")
        own = materialize(own.withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= most_nodes), "drawn")
        for end in ("a", "b"):
            links = links.join(own.select("component", F.col("a").alias(end)), ["component", end], "left_semi")
    else:
        links = links.join(own.select("component").distinct(), "component", "left_semi")

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["b"].isna().sum())
        beta0, beta1, longest = 1, 0, 0.0
        if n >= 3:
            linked = pdf[pdf["b"].notna()]
            ids, near, _ = _index(linked)
            d = _hops(near)
            beta0 = n - len(ids) + len(np.unique(np.argmax(d <= len(ids), axis=1)))
            beta1, longest = _h1(d)
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "nodes": [n], "beta0": [beta0], "beta1": [beta1], "max_persistence": [longest], "skipped": [False]})

    rows = own.select("component", "a", F.lit(None).cast("string").alias("b")).unionByName(links.select("component", "a", "b"))
    found = rows.groupBy("component").applyInPandas(reduce, "component string, nodes int, beta0 int, beta1 int, max_persistence double, skipped boolean")
    if subsample:
        return found
    none = F.lit(0)
    return found.unionByName(sizes.where(large).select("component", F.col("n").cast("int").alias("nodes"), none.alias("beta0"), none.alias("beta1"), F.lit(0.0).alias("max_persistence"), F.lit(True).alias("skipped")))


def _hops(near: list[list[int]]) -> np.ndarray:
    """Hops between all nodes; the number of nodes plus one where there is no way."""
    n = len(near)
    d = np.empty((n, n), dtype=np.int32)
    for s in range(n):
        far = [n + 1] * n
        far[s] = 0
        queue = [s]
        for x in queue:
            step = far[x] + 1
            for y in near[x]:
                if far[y] > n:
                    far[y] = step
                    queue.append(y)
        d[s] = far
    return d


def _h1(d: np.ndarray) -> tuple[int, float]:
    """Number and longest length of the one-dimensional bars of positive length, of a graph's hop metric.

    At scale r, an edge of the complex is homologous to a shortest path
    between its ends, so cycles are those of the graph; and a cycle bounds
    there if and only if it is a sum of cycles of at most 3 r edges, as such
    a one has three points at most r apart along it, and a triangle at scale
    r goes around at most 3 r edges. So every bar is born at 1, and the rank
    that cycles of at most 3 r edges span tells how many have died by r. A
    cycle of L edges through v is the sum, over its edges (x, y), of the
    closed walks v to x to y to v along shortest paths, none of which is
    longer than L; so these walks, in the order of their lengths, are enough.
    Cycles are bit sets over the edges outside one spanning forest.
    """
    n = len(d)
    ex, ey = np.nonzero(np.triu(d == 1))
    ends = list(zip(ex.tolist(), ey.tolist()))
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    bit: dict[tuple[int, int], int] = {}
    rank = 0
    for x, y in ends:
        a, b = find(x), find(y)
        if a == b:
            bit[x, y] = bit[y, x] = 1 << rank
            rank += 1
        else:
            root[a] = b
            bit[x, y] = bit[y, x] = 0
    basis: dict[int, int] = {}

    def add(cycle: int) -> None:
        while cycle and (top := cycle.bit_length()) in basis:
            cycle ^= basis[top]
        if cycle:
            basis[top] = cycle

    adjacent = d == 1
    for x, y in ends:
        if len(basis) == rank:
            return 0, 0.0
        for z in np.flatnonzero(adjacent[x] & adjacent[y]).tolist():
            if z > y:
                add(bit[x, y] ^ bit[x, z] ^ bit[y, z])
    holes = rank - len(basis)
    if not holes:
        return 0, 0.0

    def parents(v: int) -> np.ndarray:
        up = np.full(n, n, dtype=np.int64)
        for x, y in ((ex, ey), (ey, ex)):
            down = d[v, x] + 1 == d[v, y]
            np.minimum.at(up, y[down], x[down])
        return up

    def walks(v: int) -> np.ndarray:
        """Lengths of the closed walks over each edge; 0 for edges of the tree and out of reach."""
        up = parents(v)
        outside = (d[v, ex] <= n) & (up[ex] != ey) & (up[ey] != ex)
        return np.where(outside, d[v, ex] + d[v, ey] + 1, 0)

    through: dict[int, list[int]] = {}
    for v in range(n):
        for length in np.unique(walks(v)).tolist():
            if length > 3:
                through.setdefault(length, []).append(v)
    for length in sorted(through):
        seen: set[int] = set()
        for v in through[length]:
            up, way = parents(v).tolist(), {v: 0}
            for x in np.argsort(d[v], kind="stable").tolist():
                if 0 < d[v, x] <= n:
                    way[x] = way[up[x]] ^ bit[up[x], x]
            for i in np.flatnonzero(walks(v) == length).tolist():
                x, y = ends[i]
                cycle = way[x] ^ way[y] ^ bit[x, y]
                if cycle not in seen:
                    seen.add(cycle)
                    add(cycle)
            if len(basis) == rank:
                return holes, float(-(-length // 3) - 1)
    raise AssertionError("shortest closed walks span all cycles")


#: The least rise of modularity that counts, and how many rounds without one end a search.
LEAST_RISE, PATIENCE = 1e-6, 5


def label_communities(edges: DataFrame, rounds: int | None = None, levels: int | None = None, resolution: float = 1.0) -> DataFrame:
    """``(id, community)`` by local moving and contraction on the weighted graph (TOP8).

    In each round the nodes of one half (by the md5 of id and round) move to
    the neighbouring community of the largest modularity gain; ties go to
    the smallest name. Communities are then contracted to nodes, and so on.

    A level ends when no node wants to move, or when ``PATIENCE`` rounds in a
    row haven't raised the modularity by ``LEAST_RISE``. Nodes that move at
    once can spoil each other's gain: such a round is taken back and half as
    many nodes move, down to a single one, so the modularity never falls. The search
    ends when a level raises it by less. As modularity is at most 1, both end
    by themselves; ``rounds`` and ``levels`` stop them earlier, and then no
    round is taken back. Edges with a null end don't count; no
    edges give no rows.

    Joins and aggregations only; a hub's links are on the side of a join that
    AQE can split, and its gains combine before the shuffle. A round ends in
    a written table, whose size is that of its files. (A checkpoint keeps its
    plan's estimate, which multiplies in a join of a table with tables made
    from it, so the estimate's digits would double every round.)
    """
    weight = edges.where("source_id is not null and target_id is not null").groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.count("*").alias("w"))
    loops = weight.where("a = b").select(F.col("a").alias("u"), F.col("a").alias("v"), (2 * F.col("w")).alias("w"))
    pair = weight.where("a <> b")
    links = materialize(pair.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").union(pair.select("b", "a", "w")).union(loops))
    two_m = float(links.agg(F.sum("w")).first()[0] or 1)
    placed, before, level = None, None, 0
    while levels is None or level < levels:
        moved, quality = _local_moving(links, two_m, rounds, resolution)
        placed = moved if placed is None else materialize(placed.join(moved.select(F.col("id").alias("community"), F.col("community").alias("to")), "community").select("id", F.col("to").alias("community")))
        if moved.where("id <> community").isEmpty() or (levels is None and before is not None and quality <= before + LEAST_RISE):
            break
        at = lambda c, name: moved.select(F.col("id").alias(c), F.col("community").alias(name))
        links = materialize(links.join(at("u", "cu"), "u").join(at("v", "cv"), "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
        before, level = quality, level + 1
    return placed.select("id", "community")


def _local_moving(links: DataFrame, two_m: float, rounds: int | None, resolution: float) -> tuple[DataFrame, float]:
    """A level's ``(id, k, loop, community)`` and its modularity; with ``rounds``, the last modularity seen.

    A round writes what each node wishes; the moves that are made, all or
    fewer of them, are a projection of that table.
    """
    now = materialize(links.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"), F.coalesce(F.sum(F.when(F.col("u") == F.col("v"), F.col("w"))), F.lit(0)).alias("loop")).withColumn("community", F.col("id")))
    apart = materialize(links.where("u <> v").join(now.select(F.col("id").alias("u"), "k"), "u"))
    best, top, stale, halved, i = now, float("-inf"), 0, 1, 0
    while rounds is None or i < rounds:
        wish, restless, first, quality = _wishes(now, apart, two_m, resolution, i)
        i += 1
        if rounds is not None:
            now, top = _moved(wish, F.col("turn") < "8"), quality
            if not restless:
                break
        elif quality < top - 1e-12:
            halved += 1
        else:
            rose = quality > top + LEAST_RISE
            best, top, wishes, n, lowest = now, quality, wish, restless, first
            stale, halved = (0, max(1, halved - 1)) if rose else (stale + 1, halved)
            if not n or stale >= PATIENCE:
                break
        if rounds is None:
            now = _moved(wishes, F.col("turn") < f"{0x10000 >> halved:04x}" if n >> halved else F.col("turn") == lowest)
    return (best if rounds is None else now), top


def _wishes(now: DataFrame, apart: DataFrame, two_m: float, resolution: float, i: int) -> tuple[DataFrame, int, str | None, float]:
    """What each node of ``now`` wishes, how many wish to move, the first of their turns, and the modularity of ``now``.

    A join of the links to the communities of their far ends, a sum by node
    and community (to which a node's own one is added with no weight), a join
    to the communities' totals, and a choice by node.
    """
    total = now.groupBy("community").agg(F.sum("k").alias("kc"))
    beside = apart.join(now.select(F.col("id").alias("v"), "community"), "v").select(F.col("u").alias("id"), "community", "k", F.lit(0).cast("long").alias("loop"), "w", F.lit(False).alias("own"))
    home = now.select("id", "community", "k", "loop", F.lit(0).cast("long").alias("w"), F.lit(True).alias("own"))
    option = beside.union(home).groupBy("id", "community").agg(F.max("k").alias("k"), F.max("loop").alias("loop"), F.sum("w").alias("kin"), F.max("own").alias("own")).join(total, "community")
    alone = F.col("kc") - F.when(F.col("own"), F.col("k")).otherwise(0)
    # null where the node has no link into the community
    gain = F.when(F.col("kin") > 0, F.col("kin") - resolution * F.col("k") * alone / F.lit(two_m))
    at_home = lambda c: F.max(F.when(F.col("own"), F.col(c)))
    best = option.withColumn("gain", gain).groupBy("id").agg(
        F.min_by("community", F.when(F.col("gain").isNotNull(), F.struct(-F.col("gain"), "community"))).alias("to"),
        F.max("gain").alias("top"),
        *(at_home(c).alias(name) for c, name in (("gain", "stay"), ("kin", "kin"), ("kc", "kc"), ("k", "k"), ("loop", "loop"), ("community", "own"))),
    )
    restless = F.coalesce(F.col("top") > F.coalesce("stay", F.lit(0.0)) + 1e-12, F.lit(False))
    turn = F.md5(F.concat(F.col("id"), F.lit(f":{i}")))
    wish = best.select("id", "k", "loop", "own", "to", restless.alias("restless"), turn.alias("turn"), (F.col("kin") + F.col("loop")).alias("inside"), (F.col("k").cast("double") * F.col("kc")).alias("square"))
    seen = Observation()
    counted = wish.observe(seen, F.count_if("restless").alias("n"), F.min(F.when(F.col("restless"), F.col("turn"))).alias("first"), F.sum("inside").alias("inside"), F.sum("square").alias("square"))
    written = materialize(counted.drop("inside", "square"))
    found = seen.get
    return written, found["n"] or 0, found["first"], (found["inside"] or 0) / two_m - resolution * (found["square"] or 0.0) / two_m**2


def _moved(wish: DataFrame, some: Column) -> DataFrame:
    """The partition after those moves for which ``some`` holds."""
    return wish.select("id", "k", "loop", F.when(F.col("restless") & some, F.col("to")).otherwise(F.col("own")).alias("community"))

"""Minimum spanning forests, bridges, and the life of components over time.

Graphs shrink round by round: every round costs a few joins over what is
left, so all rounds together cost about as much as the first few. What fits
one task, ``rows_a_task`` links, is finished in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattis.session import materialize


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def minimum_forest(links: DataFrame, rows_a_task: int = 250_000) -> DataFrame:
    """``(a, b, w)``: the spanning forest of least weight of undirected links ``(a, b, w)``, with ``a < b``.

    Of equal weights the smaller ``(a, b)`` comes first, so there is one
    such forest; a null weight comes before all others. Of parallel links
    the lightest counts; loops and null ends count for nothing.

    Rounds after Borůvka: every component takes its lightest link out (a
    minimum, combined before the shuffle), what hangs together that way
    becomes one component, and links within a component go. Components
    halve at least each round.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    once = links.where("a <> b").groupBy(low.alias("a"), high.alias("b")).agg(F.min(F.struct(F.col("w").isNotNull().alias("given"), "w")).alias("x"))
    left = materialize(once.select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct("x.given", "x.w", "a", "b").alias("e")), "links")
    chosen: list[DataFrame] = []
    while left.count() > rows_a_task:
        both = left.select("u", "v", "e").unionAll(left.select("v", "u", "e"))
        hooks = materialize(both.groupBy("u").agg(F.min(F.struct("e", "v")).alias("x")).select("u", F.col("x.v").alias("v"), "x.e"), "hooks")
        chosen.append(hooks.select("e").distinct())
        roots = _roots(hooks.select("u", "v"))
        at = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))
        moved = left.join(at("u"), "u").join(at("v"), "v").where("ru <> rv")
        left = materialize(moved.groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min("e").alias("e")), "links")
    chosen.append(left.repartition(1).sortWithinPartitions("e").mapInPandas(_joining, left.schema).select("e"))
    return materialize(_union(chosen).select("e.a", "e.b", "e.w"), "forest")


def _joining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of links that come lightest first, those that join what isn't joined yet."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        keep = []
        for u, v in zip(batch["u"], batch["v"]):
            a, b = root(u), root(v)
            keep.append(a != b)
            up[a] = b
        yield batch[keep]


def _roots(hooks: DataFrame) -> DataFrame:
    """``(node, root)`` where each node hooks on one other, ``(u, v)``, and only pairs hook on each other.

    Of such a pair the smaller is the root; pointers double until all lead to one.
    """
    back = hooks.select(F.col("u").alias("v"), F.col("v").alias("_w"))
    first = hooks.join(back, "v").select(F.col("u").alias("node"), F.when((F.col("_w") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("root"))
    now = materialize(first, "roots")
    while True:
        ahead = now.select(F.col("node").alias("root"), F.col("root").alias("_r"))
        then = materialize(now.join(ahead, "root").select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("_moved")), "roots")
        now = then.select("node", "root")
        if then.where("_moved").isEmpty():
            return now


# ---------------------------------------------------------------- bridges


def cut_values(tree: DataFrame, labels: DataFrame, rows_a_task: int = 250_000) -> DataFrame:
    """``(e, l, m)``: for every edge of a forest the exclusive or of the labels on one side of it.

    ``tree`` is ``(x, y, e)`` with ``e`` a key of the edge; ``labels`` is
    ``(v, l, m)`` with a row a node, and comes to zero over every tree, so
    both sides of an edge have the same value.

    Each round takes off all leaves, whose label is their edge's value and
    goes on to the neighbour; then about a third of the nodes of two edges,
    no two of them neighbours: of the two edges one stays, and the other's
    value is that one's and the node's label.
    """
    tree, labels = materialize(tree.select("x", "y", "e"), "tree"), materialize(labels.select("v", "l", "m"), "labels")
    values, offsets, turn = [], [], 0
    while tree.count() > rows_a_task:
        ends = _ends(tree, turn)
        leaf = (F.col("d") == 1) & ((F.col("do") > 1) | (F.col("v") > F.col("o")))
        raked = materialize(ends.where(leaf).join(labels, "v").select("o", "e", "l", "m"), "leaves")
        values.append(raked.select("e", "l", "m"))
        labels = _add(labels, raked.select(F.col("o").alias("v"), "l", "m"))
        tree = materialize(tree.join(raked.select("e"), "e", "left_anti").select("x", "y", "e"), "tree")
        ends = _ends(tree, turn)
        near = ends.where("d = 2").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("o", "e"))).alias("n"), F.bool_and((F.col("do") != 2) | (F.col("h") < F.col("ho"))).alias("alone"))
        two = near.where("alone").select("v", F.col("n")[0].alias("p"), F.col("n")[1].alias("q"))
        picked = materialize(two.join(labels, "v").select(F.col("p.o").alias("x"), F.col("q.o").alias("y"), F.col("p.e").alias("e"), F.col("q.e").alias("gone"), "l", "m"), "picked")
        offsets.append(picked.select(F.col("gone").alias("e"), F.col("e").alias("to"), "l", "m"))
        labels = _add(labels, picked.select(F.col("y").alias("v"), "l", "m"))
        used = picked.select("e").unionAll(picked.select("gone"))
        tree = materialize(tree.join(used, "e", "left_anti").select("x", "y", "e").unionAll(picked.select("x", "y", "e")), "tree")
        turn += 1
    ends = tree.select(F.col("x").alias("v")).unionAll(tree.select("y")).distinct()
    rows = tree.select("x", "y", "e", F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("m")).unionAll(labels.join(ends, "v").select("v", "v", F.lit(None).cast(tree.schema["e"].dataType), "l", "m"))
    values.append(rows.repartition(1).mapInPandas(_peel, rows.schema).select("e", "l", "m"))
    known = materialize(_union(values), "values")
    if not offsets:
        return known
    way = materialize(_union(offsets), "offsets")
    while True:  # the chains are as long as there were rounds, at most
        on = way.select(F.col("e").alias("to"), F.col("to").alias("_to"), F.col("l").alias("_l"), F.col("m").alias("_m"))
        then = materialize(way.join(on, "to", "left").select("e", F.coalesce("_to", "to").alias("to"), F.col("l").bitwiseXOR(F.coalesce("_l", F.lit(0))).alias("l"), F.col("m").bitwiseXOR(F.coalesce("_m", F.lit(0))).alias("m"), F.col("_to").isNotNull().alias("_moved")), "offsets")
        way = then.drop("_moved")
        if then.where("_moved").isEmpty():
            break
    at = known.select(F.col("e").alias("to"), F.col("l").alias("_l"), F.col("m").alias("_m"))
    return known.unionAll(way.join(at, "to").select("e", F.col("l").bitwiseXOR(F.col("_l")), F.col("m").bitwiseXOR(F.col("_m"))))


def _ends(tree: DataFrame, turn: int) -> DataFrame:
    """``(v, o, e, d, do, h, ho)``: each edge from both ends, with the degrees and a number drawn for this turn."""
    both = tree.select(F.col("x").alias("v"), F.col("y").alias("o"), "e").unionAll(tree.select("y", "x", "e"))
    degree = both.groupBy("v").agg(F.count("*").alias("d")).withColumn("h", F.xxhash64("v", F.lit(turn)))
    return both.join(degree, "v").join(degree.select(F.col("v").alias("o"), F.col("d").alias("do"), F.col("h").alias("ho")), "o")


def _xor(labels: DataFrame) -> DataFrame:
    return labels.groupBy("v").agg(F.bit_xor("l").alias("l"), F.bit_xor("m").alias("m"))


def _add(labels: DataFrame, more: DataFrame) -> DataFrame:
    return materialize(_xor(labels.unionAll(more)), "labels")


def _peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """:func:`cut_values` of the few edges that are left; rows without ``e`` are labels."""
    near: dict = {}
    label: dict = {}
    edges = []
    for batch in batches:
        for x, y, e, l, m in batch.itertuples(index=False, name=None):
            if e is None:
                label[x] = (l, m)
            else:
                near.setdefault(x, {})[len(edges)] = y
                near.setdefault(y, {})[len(edges)] = x
                edges.append(e)
    value: list = [None] * len(edges)
    leaves = [v for v, own in near.items() if len(own) == 1]
    while leaves:
        v = leaves.pop()
        if len(near[v]) != 1:
            continue
        k, o = near[v].popitem()
        l, m = value[k] = label[v]
        label[o] = (label[o][0] ^ l, label[o][1] ^ m)
        del near[o][k]
        if len(near[o]) == 1:
            leaves.append(o)
    columns = list(batch.columns) if label or edges else ["x", "y", "e", "l", "m"]
    yield pd.DataFrame([(None, None, e, *v) for e, v in zip(edges, value)], columns=columns)


def _number(name, seed: int):
    """A number for a node's name; other seeds give other numbers."""
    return F.xxhash64(name, F.lit(seed))


def _numbered(edges: DataFrame) -> DataFrame:
    """``(a, b, x, y, at)``: the names of both ends, their numbers with ``x < y``, and the place of the row.

    Numbers are hashes. Names are counted, so that no two have one number;
    if two have, others are drawn. An edge may come twice.
    """
    low, high = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    once = edges.where("source_id <> target_id").select(low.cast("string").alias("a"), high.cast("string").alias("b"))
    seed = 0
    while True:
        m, n = _number(F.col("a"), seed), _number(F.col("b"), seed)
        named = materialize(once.select("a", "b", F.least(m, n).alias("x"), F.greatest(m, n).alias("y"), F.monotonically_increasing_id().alias("at")), "named")
        names = named.select(F.col("a").alias("v")).unionAll(named.select("b")).distinct()
        if names.groupBy(_number(F.col("v"), seed).alias("h")).count().where("count > 1").isEmpty():
            return named
        seed += 1


_SETTLED = "kind int, bin long, x long, y long, twice boolean, ex long, ey long"
_LEFT, _BRIDGE, _FOLLOWS = 0, 1, 2


def _contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the edges of one bin tell: bridges, edges that follow another, and the few that stand for the rest.

    Rows with ``x = y`` name the nodes that have edges elsewhere too; ``twice``
    edges count double. Edges on a cycle are no bridges; the shared nodes of
    such a part stay tied to each other by double edges. What is left is a
    tree of parts: an edge with no shared node on one of its sides is a
    bridge, and edges in a row with nothing shared between them are bridges
    together or not at all, so all follow one.
    """
    here = int(pdf["bin"].iat[0])
    mark = pdf["x"].to_numpy() == pdf["y"].to_numpy()
    rows = pdf[~mark].drop_duplicates(["x", "y", "ex", "ey"])
    rows = rows.assign(twice=rows["twice"] | rows.duplicated(["x", "y"], keep=False)).drop_duplicates(["x", "y"])
    twice, keys = rows["twice"].tolist(), rows[["ex", "ey"]].to_numpy()
    names, ends = np.unique(rows[["x", "y"]].to_numpy(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    shared = np.isin(names, pdf["x"].to_numpy()[mark]).tolist()
    near: list[list] = [[] for _ in names]
    for k, (u, v) in enumerate(ends.tolist()):
        near[u].append((v, k))
        near[v].append((u, k))
    # parts that hold together without any one edge; of each its parent and the edge to it, parents first
    n = len(names)
    found, low, by, above, order = [-1] * n, [0] * n, [-1] * n, [-1] * n, []
    for start in range(n):
        if found[start] >= 0:
            continue
        stack = [(start, iter(near[start]))]
        found[start] = low[start] = len(order)
        order.append(start)
        while stack:
            v, rest = stack[-1]
            for o, k in rest:
                if found[o] < 0:
                    found[o] = low[o] = len(order)
                    order.append(o)
                    by[o], above[o] = k, v
                    stack.append((o, iter(near[o])))
                    break
                if k != by[v] and found[o] < low[v]:
                    low[v] = found[o]
            else:
                stack.pop()
                if stack and low[v] < low[stack[-1][0]]:
                    low[stack[-1][0]] = low[v]
    part, top, up, tie, member, whole = [-1] * n, [], [], [], [], []
    for v in order:
        p = above[v]
        if p >= 0 and (low[v] <= found[p] or twice[by[v]]):
            part[v] = part[p]
        else:
            part[v] = len(up)
            up.append(-1 if p < 0 else part[p])
            tie.append(by[v])
            member.append([])
            top.append(v)
            whole.append(part[v] if p < 0 else whole[part[p]])
        if shared[v]:
            member[part[v]].append(v)
    below = [len(m) for m in member]
    for c in range(len(up) - 1, -1, -1):
        if up[c] >= 0:
            below[up[c]] += below[c]
    sure, kept, touch = [], [], [[] for _ in up]
    for c, p in enumerate(up):
        if p >= 0:
            if 0 < below[c] < below[whole[c]]:
                kept.append(c)
                touch[c].append(c)
                touch[p].append(c)
            else:
                sure.append(tie[c])
    # edges in a row, each named by its lower part
    head = {c: c for c in kept}

    def first(c):
        while head[c] != c:
            head[c] = head[head[c]]
            c = head[c]
        return c

    through = [not m and len(t) == 2 for m, t in zip(member, touch)]
    for c, t in enumerate(touch):
        if through[c]:
            head[first(t[0])] = first(t[1])
    far: dict = {}
    follows = []
    for c in kept:
        h = first(c)
        if h != c:
            follows.append((tie[c], tie[h]))
        for v in ends[tie[c]].tolist():
            q = part[v]
            if not through[q]:
                far.setdefault(h, []).append(v if shared[v] else (member[q] or [top[q]])[0])
    out = [(_LEFT, names[min(u, v)], names[max(u, v)], False, *keys[tie[h]]) for h, (u, v) in far.items()]
    for m in member:
        out += [(_LEFT, names[min(u, v)], names[max(u, v)], True, names[min(u, v)], names[max(u, v)]) for u, v in zip(m, m[1:])]
    out += [(_FOLLOWS, *keys[h], False, *keys[k]) for k, h in follows]
    out += [(_BRIDGE, 0, 0, False, *keys[k]) for k in sure]
    told = pd.DataFrame(out, columns=["kind", "x", "y", "twice", "ex", "ey"])
    told.insert(1, "bin", here)
    return told


def _round(left: DataFrame, rows: int) -> DataFrame:
    """:func:`_contract` of ``(chunk, x, y, twice, ex, ey)``: neighbouring chunks are put together to about ``rows`` edges."""
    sizes = left.groupBy("chunk").count().withColumn("_sum", F.sum("count").over(Window.orderBy("chunk")))
    bins = materialize(sizes.select("chunk", F.expr(f"(_sum - 1) div {rows}").alias("bin")), "bins")
    dealt = left.join(F.broadcast(bins), "chunk").select("bin", "x", "y", "twice", "ex", "ey")
    held = dealt.select(F.col("x").alias("v"), "bin").unionAll(dealt.select("y", "bin")).distinct()
    both = held.withColumn("_n", F.count("*").over(Window.partitionBy("v"))).where("_n > 1")
    zero = F.lit(0).cast("long")
    marks = both.select("bin", F.col("v").alias("x"), F.col("v").alias("y"), F.lit(False), zero, zero)
    return materialize(dealt.unionAll(marks).groupBy("bin").applyInPandas(_contract, _SETTLED), "settled")


def bridges(edges: DataFrame, strip: int = 8, rows_a_task: int = 250_000) -> DataFrame:
    """``(a, b)``, ``a < b``: the simple edges whose removal parts their component (TOP14).

    Nodes get numbers, so that names are moved only to be counted and at the
    end. Edges that come near each other are taken together, ``rows_a_task``
    in a task, which settles all but what hangs on nodes that other tasks
    hold too (:func:`_contract`). That is repeated, ``strip`` times at most,
    while a quarter of the edges or more goes; what is left after it is left
    to forests (:func:`_uncovered`), unless it fits one task.
    """
    named = _numbered(edges)
    rows, turn = max(1, rows_a_task), 0
    left = named.select(F.expr(f"at div {rows}").alias("chunk"), "x", "y", F.lit(False).alias("twice"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    n, told, found = left.count(), [], []
    while n and (n <= rows or turn < strip):
        told.append(_round(left, rows))
        once = told[-1].where(F.col("kind") == _LEFT).groupBy("x", "y").agg(F.min("bin").alias("chunk"), F.bool_or("twice").alias("t"), F.min("ex").alias("ex"), F.min("ey").alias("ey"), F.max("ex").alias("_x"), F.max("ey").alias("_y"))
        left = materialize(once.select("chunk", "x", "y", (F.col("t") | (F.col("ex") != F.col("_x")) | (F.col("ey") != F.col("_y"))).alias("twice"), "ex", "ey"), "core")
        before, n, turn = n, left.count(), turn + 1
        if n > rows and 4 * n > 3 * before:
            break
    if n:
        found.append(_uncovered(left, rows_a_task))
    for settled in reversed(told):
        follows = settled.where(F.col("kind") == _FOLLOWS).select("ex", "ey", "x", "y")
        if found and not follows.isEmpty():
            found.append(materialize(follows.join(_union(found).select(F.col("ex").alias("x"), F.col("ey").alias("y")), ["x", "y"], "left_semi").select("ex", "ey"), "follows"))
        found.append(settled.where(F.col("kind") == _BRIDGE).select("ex", "ey"))
    if not found:
        return named.select("a", "b")
    all_of_them = _union(found).select(F.col("ex").alias("x"), F.col("ey").alias("y"))
    return named.select("a", "b", "x", "y").join(all_of_them, ["x", "y"], "left_semi").groupBy("x", "y", "a", "b").agg(F.count("*")).select("a", "b")


def _uncovered(left: DataFrame, rows_a_task: int) -> DataFrame:
    """``(ex, ey)`` of the bridges among edges ``(x, y, twice, ex, ey)``, none of them ``twice``.

    Two spanning forests in a row hold every bridge and every way around
    one: all bridges are in the first, and an edge of it is a bridge unless
    an edge of the second leads around it. Edges of the second give both
    their ends a 128-bit label; an edge of the first has the exclusive or of
    the labels on one side of it, which is that of the edges that lead
    around it (:func:`cut_values`), and zero if there are none.

    A value could be zero by chance. So the number found is compared with
    the number of components that their removal adds: it is the same if and
    only if all of them are bridges. If it isn't, other labels are drawn.
    """
    plain = left.select(F.col("x").alias("a"), F.col("y").alias("b"), "twice")
    first = minimum_forest(plain.select("a", "b", F.xxhash64("a", "b").alias("w")), rows_a_task).select("a", "b")
    beside = plain.join(first, ["a", "b"], "left_anti").unionAll(plain.where("twice")).select("a", "b", F.xxhash64("a", "b").alias("w"))
    second = minimum_forest(beside, rows_a_task).select("a", "b")
    n, seed = first.count(), 0
    nodes = first.select(F.col("a").alias("v")).unionAll(first.select("b")).distinct()
    zero = nodes.select("v", F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("m"))
    name = F.concat_ws("\x00", F.col("a").cast("string"), F.col("b").cast("string")).alias("e")
    tree = first.select(F.col("a").alias("x"), F.col("b").alias("y"), name)
    keyed = first.select("a", "b", name)
    while True:
        drawn = second.select("a", "b", F.xxhash64("a", "b", F.lit(2 * seed)).alias("l"), F.xxhash64("a", "b", F.lit(2 * seed + 1)).alias("m"))
        labels = _xor(zero.unionAll(drawn.select("a", "l", "m")).unionAll(drawn.select("b", "l", "m")))
        values = cut_values(tree, labels, rows_a_task)
        apart = materialize(keyed.join(values.where("l = 0 and m = 0"), "e").select("a", "b"), "bridges")
        rest = first.join(apart, ["a", "b"], "left_anti").unionAll(second).withColumn("w", F.xxhash64("a", "b"))
        if apart.count() == n - minimum_forest(rest, rows_a_task).count():
            return materialize(left.join(apart.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_semi").select("ex", "ey"), "bridges")
        seed += 1


# ------------------------------------------------------------- filtration


def component_bars(links: DataFrame, rows_a_task: int = 250_000) -> DataFrame:
    """``(death, bars)``: how many components end at each time as links ``(a, b, w)`` come in the order of ``w``; an extension (§2.15).

    All nodes that a link touches are there from the start, each a component
    of its own. A component ends where a link joins it to another; the
    times of these are those of the minimum spanning forest. Components that
    never end are the row with a null ``death``. Links without a time are
    left out, and their nodes with them.
    """
    timed = materialize(links.where("a is not null and b is not null and w is not null").select("a", "b", "w"), "timed")
    forest = minimum_forest(timed, rows_a_task)
    nodes = timed.select("a").unionAll(timed.select("b")).agg(F.count_distinct("a").alias("n"))
    ends = forest.groupBy(F.col("w").alias("death")).agg(F.count("*").alias("bars"))
    stay = nodes.crossJoin(forest.agg(F.count("*").alias("k"))).where("n > 0").select(F.lit(None).cast(forest.schema["w"].dataType).alias("death"), (F.col("n") - F.col("k")).alias("bars"))
    return ends.unionByName(stay)

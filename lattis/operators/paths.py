"""Shortest paths between asked pairs, from both ends, with the nodes between.

A ball grows around each end until the two meet, so a search goes half as
deep on either side. Every round is a join of a frontier with the edges and
ends in a written table; only counts reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lattis.operators.components import connected_components
from lattis.operators.ordering import global_index
from lattis.session import materialize

#: What can be said of a pair.
FOUND, APART, FURTHER = "found", "apart", "further"


def links(edges: DataFrame) -> DataFrame:
    """``(u, v)`` once for each two nodes that an edge joins, the smaller first, without loops or null ends."""
    return edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v")).distinct()


def _written(df: DataFrame, kind: str) -> tuple[DataFrame, int]:
    """``df`` written and read again, and how many rows it has."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), kind)
    return out, seen.get["n"]


class _Ball:
    """Distances from each root, a level a round."""

    def __init__(self, steps: DataFrame, roots: DataFrame):
        self.steps = steps
        level, self.size = _written(roots.select("root", F.col("root").alias("id")), "roots")
        self.levels = [level]

    @property
    def radius(self) -> int:
        return len(self.levels) - 1

    @property
    def rim(self) -> DataFrame:
        return self.levels[-1]

    def reached(self, roots: DataFrame | None) -> DataFrame:
        """``(root, id)``, with repeats: a step from the rim, around ``roots`` or all. That is a level on, on the rim, or a level back."""
        live = self.rim if roots is None else self.rim.join(roots, "root", "left_semi")
        return live.join(self.steps, F.col("id") == F.col("u")).select("root", F.col("v").alias("id"))

    def grow(self, roots: DataFrame | None) -> None:
        """One step more: what is reached and not known, by one grouping of both."""
        rows = self.reached(roots).withColumn("new", F.lit(True))
        for level in self.levels[-2:]:
            rows = rows.unionAll(level.withColumn("new", F.lit(False)))
        level, self.size = _written(rows.groupBy("root", "id").agg(F.min("new").alias("new")).where("new").select("root", "id"), "rim")
        self.levels.append(level)

    def distances(self, roots: DataFrame) -> DataFrame:
        """``(root, id, d)`` within the radius, around ``roots``."""
        return reduce(DataFrame.unionAll, (x.withColumn("d", F.lit(d)) for d, x in enumerate(self.levels))).join(roots, "root", "left_semi")


class Search:
    """Pairs ``(a, b)`` settled over undirected edges: ``hops``, or why there are none.

    ``longest`` bounds the hops, or is None for no bound. Pairs in different
    components, and pairs with a null or an end that no edge touches (unless
    the ends are equal), are apart: that is known before the search begins,
    so a search without a bound ends. Repeated pairs count once. ``placed``
    is ``(node, component)`` of at least the nodes asked for that an edge
    touches, where the caller knows a cheaper way to it than the edges.

    The search is over numbers that are in the order of the nodes.
    """

    def __init__(self, edges: DataFrame, pairs: DataFrame, longest: int | None = None, placed: DataFrame | None = None):
        named = materialize(links(edges), "links")
        self.names = materialize(global_index(named.select(F.col("u").alias("node")).union(named.select("v")).distinct(), ["node"], "x"), "names")
        number = lambda k: self.names.select(F.col("node").alias(k), F.col("x").alias(f"x_{k}"))
        once = named.join(number("u"), "u").join(number("v"), "v").select(F.col("x_u").alias("u"), F.col("x_v").alias("v"))
        self.steps = materialize(once.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*"), "steps")
        self.asked = materialize(pairs.select("a", "b").distinct(), "asked")
        ends = self.asked.where("a <> b").join(number("a"), "a").join(number("b"), "b")
        if placed is None:
            within = connected_components(self.steps.where("u < v"), "u", "v")
            at = lambda k: within.select(F.col("node").alias(f"x_{k}"), F.col("component").alias(f"c_{k}"))
            ends = ends.join(at("a"), "x_a").join(at("b"), "x_b")
        else:
            at = lambda k: placed.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
            ends = ends.join(at("a"), "a").join(at("b"), "b")
        #: The pairs that have a path, by name and number.
        self.joined, left = _written(ends.where("c_a = c_b").select("a", "b", "x_a", "x_b"), "joined")
        active, dealt = self.joined.select(F.col("x_a").alias("a"), F.col("x_b").alias("b")), left
        self.forth, self.back = _Ball(self.steps, self._ends(active, "a")), _Ball(self.steps, self._ends(active, "b"))
        met = [active.limit(0).select("a", "b", F.col("a").alias("id"), F.lit(0).alias("da"), F.lit(0).alias("db"))]
        while left and (longest is None or self.forth.radius + self.back.radius < longest):
            da, db = self.forth.radius, self.back.radius
            side, other, key, far = (self.forth, self.back, "a", "b") if self.forth.size <= self.back.size else (self.back, self.forth, "b", "a")
            da, db = (da + 1, db) if side is self.forth else (da, db + 1)
            roots = self._ends(active, key) if left < 0.8 * dealt else None  # fewer would hardly spare work
            if da + db == longest:  # nothing goes on from here: what would lie nearer has met before
                own = side.reached(roots)
            else:
                side.grow(roots)
                own = side.rim
            rims = active.join(other.rim.withColumnRenamed("root", far), far).join(own.withColumnRenamed("root", key), [key, "id"])
            now, n = _written(rims.select("a", "b", "id", F.lit(da).alias("da"), F.lit(db).alias("db")).distinct(), "met")
            if n:
                met.append(now)
                active, left = _written(active.join(now, ["a", "b"], "left_anti"), "active")
            if da + db == longest:
                break
        self.met = materialize(reduce(DataFrame.unionAll, met), "met")

    @staticmethod
    def _ends(pairs: DataFrame, key: str) -> DataFrame:
        return pairs.select(F.col(key).alias("root")).distinct()

    def _told(self, known: DataFrame) -> DataFrame:
        """``known`` (``x_a``, ``x_b``, ``hops`` and more) by name, with every asked pair and its ``status``."""
        named = self.joined.join(known.withColumn("status", F.lit(FOUND)), ["x_a", "x_b"], "left").withColumn("status", F.coalesce("status", F.lit(FURTHER)))
        same = lambda k: F.col(k).eqNullSafe(F.col(f"_{k}"))
        named = named.drop("x_a", "x_b").withColumnsRenamed({"a": "_a", "b": "_b"})
        told = self.asked.join(named, same("a") & same("b"), "left").drop("_a", "_b")
        own = F.col("a") == F.col("b")
        return told.withColumns({"hops": F.when(own, 0).otherwise(F.col("hops")), "status": F.when(own, FOUND).otherwise(F.coalesce("status", F.lit(APART)))})

    def hops(self) -> DataFrame:
        """``(a, b, hops, status)`` of every asked pair."""
        known = self.met.groupBy(F.col("a").alias("x_a"), F.col("b").alias("x_b")).agg(F.max(F.col("da") + F.col("db")).alias("hops"))
        return self._told(known).select("a", "b", "hops", "status")

    def paths(self) -> DataFrame:
        """``(a, b, hops, status, path)``: the least of a pair's shortest paths, compared node by node, as an array.

        Backwards from where the balls met, the nodes that lie on a shortest
        path are marked; then each path is walked from ``a``, to the
        smallest node that goes on. No row holds more than its own path.
        Only balls around pairs that met are looked at, and the steps
        within them.
        """
        forth = materialize(self.forth.distances(self._ends(self.met, "a")), "forth")
        back = materialize(self.back.distances(self._ends(self.met, "b")), "back")
        here = forth.select("id").union(back.select("id")).union(self.met.select("id")).distinct().join(self.names.select(F.col("x").alias("id"), "node"), "id")
        here = materialize(here, "here")
        steps = self.steps.join(here.select(F.col("id").alias("u")), "u", "left_semi").join(here.select(F.col("id").alias("v"), "node"), "v")
        steps = materialize(steps.select("u", "v", "node"), "steps")
        mark = materialize(self.met.select("a", "b", "id", F.col("da").alias("t"), (F.col("da") + F.col("db")).alias("hops")), "marks")
        marks = [mark]
        for _ in range(self._farthest("da")):
            nearer = mark.where("t > 0").join(steps, F.col("id") == F.col("u")).select("a", "b", F.col("v").alias("id"), (F.col("t") - 1).alias("t"), "hops").distinct()
            on = nearer.join(forth.select(F.col("root").alias("a"), "id", F.col("d").alias("t")), ["a", "id", "t"], "left_semi")
            mark = materialize(on.select("a", "b", "id", "t", "hops"), "marks")
            marks.append(mark)
        ways = materialize(reduce(DataFrame.unionAll, marks).distinct(), "ways")
        # beyond where they met, the distance to b tells what goes on
        starts = self.met.groupBy("a", "b").agg(F.max(F.col("da") + F.col("db")).alias("hops"), F.max("da").alias("da")).join(here.withColumnRenamed("id", "a"), "a")
        walk = materialize(starts.select("a", "b", "hops", "da", F.col("a").alias("id"), F.array("node").alias("path")), "walk")
        done = []
        for t in range(1, self._farthest(F.col("da") + F.col("db")) + 1):
            ahead = walk.where(F.col("hops") >= t).join(steps, F.col("id") == F.col("u")).withColumn("id", F.col("v")).drop("u", "v")
            first = ahead.where(F.col("da") >= t).join(ways.where(F.col("t") == t).select("a", "b", "id"), ["a", "b", "id"], "left_semi")
            left = F.col("hops") - t
            last = ahead.where(F.col("da") < t).withColumn("d", left).join(back.withColumnRenamed("root", "b"), ["b", "id", "d"], "left_semi").drop("d")
            step = first.unionByName(last).groupBy("a", "b").agg(F.min(F.struct("id", "node", "hops", "da", "path")).alias("x"))
            walk = materialize(step.select("a", "b", "x.hops", "x.da", "x.id", F.concat("x.path", F.array("x.node")).alias("path")), "walk")
            done.append(walk.where(F.col("hops") == t))
        found = reduce(DataFrame.unionByName, done) if done else walk.limit(0)
        told = self._told(found.select(F.col("a").alias("x_a"), F.col("b").alias("x_b"), "hops", "path"))
        return told.select("a", "b", "hops", "status", F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.col("path")).alias("path"))

    def _farthest(self, what: Column | str) -> int:
        """The most of ``what`` over the pairs that met, or 0."""
        return self.met.agg(F.max(what).alias("n")).first()["n"] or 0


def shortest_paths(edges: DataFrame, pairs: DataFrame, longest: int | None = None, placed: DataFrame | None = None) -> DataFrame:
    """``(a, b, hops, status, path)`` of each asked pair (TOP20).

    ``status`` is ``found``, ``apart`` (no path of any length) or
    ``further`` (a path, but of more than ``longest`` hops). ``path`` is the
    least of the shortest ones, from ``a`` to ``b``, both included. Edges are
    taken without direction; loops, repeats and null ends add nothing. A
    node is at 0 hops from itself, an edge or none. ``placed`` may give the
    components (:class:`Search`).
    """
    return Search(edges, pairs, longest, placed).paths()


def between_waypoints(edges: DataFrame, waypoints: DataFrame, longest: int | None = None) -> DataFrame:
    """``(qid, segments, disconnected, further, interior)`` of each question's waypoints ``(qid, pos, id)`` (TOP20).

    A segment joins consecutive waypoints (by ``pos``, then ``id``) that an
    edge touches both; others are left out. ``interior`` holds, sorted and
    once each, the nodes between the ends of the segments' paths that are no
    waypoint of the question. Segments without a path are counted as
    ``disconnected``, those over ``longest`` hops as ``further``. A question
    of one waypoint has no segment; a null ``id`` is no waypoint.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("qid").orderBy("pos", "id")
    points = waypoints.where("id is not null").select("qid", "pos", "id")
    touched = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    flagged = points.join(touched.withColumn("_on", F.lit(True)), "id", "left")
    segments = materialize(flagged.select("qid", F.col("id").alias("a"), F.lead("id").over(w).alias("b"), "_on", F.lead("_on").over(w).alias("_next")).where("_on and _next").select("qid", "a", "b"), "segments")
    told = segments.join(shortest_paths(edges, segments, longest), ["a", "b"])
    counts = told.groupBy("qid").agg(F.count("*").alias("segments"), F.count_if(F.col("status") == APART).alias("disconnected"), F.count_if(F.col("status") == FURTHER).alias("further"))
    inside = told.select("qid", F.explode(F.slice("path", 2, F.greatest(F.col("hops") - 1, F.lit(0)))).alias("id")).distinct().join(points.select("qid", "id"), ["qid", "id"], "left_anti")
    held = inside.groupBy("qid").agg(F.array_sort(F.collect_list("id")).alias("interior"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return points.select("qid").distinct().join(counts, "qid", "left").join(held, "qid", "left").select(
        "qid", zero("segments"), zero("disconnected"), zero("further"), F.coalesce("interior", F.array().cast("array<string>")).alias("interior")
    )

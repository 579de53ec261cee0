"""Embedding near-duplicates by small-world graphs, one a shard.

Vectors of one label are dealt into shards of bounded size. Each shard gets a
hierarchical navigable small-world graph; every vector of the label queries
every shard of it. Before a group of queries counts, some of them, and probes
made to lie just within reach of some, are audited against brute force over
the shard, and the beam is widened until the audit's recall is reached. Where
no beam reaches it, where some node of the graph can't be reached from every
other, or where the graph falls into far groups, the shard is searched by
brute force in blocks. Candidates are verified by cosine in double precision.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm.simhash_bk import merge
from lattis.operators.components import connected_components
from lattis.session import deal, materialize

FOUND = "key long, n long, root long"


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors, built by searching itself.

    A node's top level is geometric in a hash of its place, and tall nodes
    come first, so the nodes of a level are the first ones. Nodes are
    inserted in batches that grow with the graph: each batch searches the
    graph so far for its candidates (and meets itself), and links, on every
    level, to those nearer to it than to a link chosen before, so that links
    lead out in all directions. Links go both ways; a node with too many
    keeps those that the same rule chooses.
    """

    def __init__(self, unit: np.ndarray, degree: int = 12, beam: int = 32, batch: int = 512, seed: int = 7):
        n = len(unit)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(degree)).astype(int), 8)
        self.place = np.argsort(-level, kind="stable")
        self.unit = np.ascontiguousarray(unit[self.place], dtype=np.float32)
        tops = range(int(level.max(initial=0)) + 1)
        self.sizes = [int((level >= k).sum()) for k in tops]
        self.links = [np.full((size, 2 * (degree if k else 2 * degree)), -1, dtype=np.int32) for k, size in zip(tops, self.sizes)]
        a = 0
        while a < n:
            b = min(n, a + max(32, min(a, batch)))
            self._insert(a, b, beam)
            a = b
        self._link_orphans()
        self.whole = _strongly_connected(self.links[0]) and not self._islands()

    def _insert(self, a: int, b: int, beam: int) -> None:
        own = self.unit[a:b]
        within = own @ own.T
        np.fill_diagonal(within, -2)
        at = np.zeros(b - a, dtype=np.int64)
        best = own @ self.unit[0]
        for k in reversed(range(len(self.links))):
            h = max(0, min(b, self.sizes[k]) - a)
            if a:
                at[h:], best[h:] = self._walk(k, own[h:], at[h:], best[h:])
            if not h:
                continue
            ids, value = np.empty((h, 0), np.int64), np.empty((h, 0), np.float32)
            if a:
                ids, value, *_ = self._beam(k, own[:h], at[:h], best[:h], beam)
                at[:h], best[:h] = ids[:, 0], value[:, 0]
            width = self.links[k].shape[1] // 2
            near = np.argsort(-within[:h, :h], axis=1, kind="stable")[:, : 2 * width]
            ids = np.concatenate([ids, near + a], axis=1)
            value = np.concatenate([value, np.take_along_axis(within[:h, :h], near, axis=1)], axis=1)
            ids[value <= -2] = -1
            chosen = self._choose(ids, value, width)
            self.links[k][a : a + h, :width] = chosen
            self._link_back(k, np.repeat(np.arange(a, a + h), width), chosen.ravel())

    def _choose(self, ids: np.ndarray, value: np.ndarray, width: int, step: int = 128) -> np.ndarray:
        """The links that each row of candidates gives: ``width`` at most, -1 where there are fewer."""
        out = np.full((len(ids), width), -1, dtype=np.int32)
        if not ids.shape[1]:
            return out
        for a in range(0, len(ids), step):
            near, far = ids[a : a + step], np.where(ids[a : a + step] < 0, -2, value[a : a + step])
            order = np.lexsort((near, -far), axis=1)[:, : 3 * width]
            near, far = np.take_along_axis(near, order, axis=1), np.take_along_axis(far, order, axis=1)
            vectors = self.unit[near]
            between = vectors @ vectors.transpose(0, 2, 1)
            taken = np.zeros(near.shape, dtype=bool)
            count = np.zeros(len(near), dtype=int)
            for j in range(near.shape[1]):
                # a candidate nearer to a chosen link than to the node is reached through that link
                shadow = (taken & (between[:, j, :] > far[:, j : j + 1])).any(axis=1)
                take = (near[:, j] >= 0) & (count < width) & (~shadow | (j < width // 3))
                taken[:, j] = take
                count += take
            for j in range(near.shape[1]):  # fill what is left with the nearest of the others
                take = (near[:, j] >= 0) & (count < width) & ~taken[:, j]
                taken[:, j] |= take
                count += take
            q, j = np.nonzero(taken)
            out[a + q, (np.cumsum(taken, axis=1) - 1)[q, j]] = near[q, j]
        return out

    def _link_back(self, k: int, src: np.ndarray, dst: np.ndarray) -> None:
        """Links from each ``dst`` to its ``src``."""
        links = self.links[k]
        src, dst = src[dst >= 0], dst[dst >= 0].astype(np.int64)
        new = ~(links[dst] == src[:, None]).any(axis=1)
        src, dst = src[new], dst[new]
        if not len(src):
            return
        value = np.einsum("qd,qd->q", self.unit[src], self.unit[dst])
        order = np.lexsort((src, -value, dst))
        src, dst, value = src[order], dst[order], value[order]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst)
        has = (links >= 0).sum(axis=1)
        many = np.bincount(dst, minlength=len(links))
        room = (has + many <= links.shape[1])[dst]
        free = np.argsort(links[dst[room]] >= 0, axis=1, kind="stable")  # empty slots first
        links[dst[room], free[np.arange(room.sum()), place[room]]] = src[room]
        full = np.flatnonzero(has + many > links.shape[1])
        if not len(full):
            return
        width = links.shape[1]
        on = ~room & (place < width)
        ids = np.full((len(full), 2 * width), -1, dtype=np.int64)
        ids[:, :width] = links[full]
        ids[np.searchsorted(full, dst[on]), width + place[on]] = src[on]
        for a in range(0, len(full), 512):
            some = ids[a : a + 512]
            far = np.einsum("qd,qkd->qk", self.unit[full[a : a + 512]], self.unit[some])
            links[full[a : a + 512]] = self._choose(some, far, width)

    def _link_orphans(self) -> None:
        """A link to each base node that none leads to, from the nearest of its own links, in further slots."""
        links = self.links[0]
        led_to = np.zeros(len(links), dtype=bool)
        led_to[links[links >= 0]] = True
        orphans = np.flatnonzero(~led_to & (links >= 0).any(axis=1))
        if not len(orphans):
            return
        near = links[orphans]
        value = np.einsum("qd,qkd->qk", self.unit[orphans], self.unit[near])
        value[near < 0] = -2
        src = near[np.arange(len(orphans)), value.argmax(axis=1)]
        order = np.argsort(src, kind="stable")
        src, orphans = src[order], orphans[order]
        place = np.arange(len(src)) - np.searchsorted(src, src)
        more = np.full((len(links), int(place.max()) + 1), -1, dtype=np.int32)
        more[src, place] = orphans
        self.links[0] = np.concatenate([links, more], axis=1)

    def _islands(self, nearest: int = 8, least: int = 73) -> bool:
        """Whether the nearest links leave two or more groups of ``least`` nodes apart.

        Far groups hang together by a few long links only. A search may miss
        those, and an audit of some queries needn't see it.
        """
        links = self.links[0]
        value = np.stack([np.einsum("nd,nd->n", self.unit, self.unit[links[:, j]]) for j in range(links.shape[1])], axis=1)
        value[links < 0] = -2
        top = np.argsort(-value, axis=1, kind="stable")[:, :nearest]
        near = np.take_along_axis(links, top, axis=1).astype(np.int64)
        src, dst = np.nonzero(near >= 0)[0], near[near >= 0]
        return int((np.bincount(merge(np.arange(len(links)), src, dst), minlength=1) >= least).sum()) > 1

    def _walk(self, k: int, queries: np.ndarray, at: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy steps on level ``k`` from ``at`` until no neighbour is nearer."""
        links, at, best = self.links[k], at.copy(), best.copy()
        moving = np.arange(len(queries))
        while len(moving):
            near = links[at[moving]]
            value = np.einsum("qd,qkd->qk", queries[moving], self.unit[near])
            value[near < 0] = -2
            j = value.argmax(axis=1)
            value = value[np.arange(len(moving)), j]
            on = value > best[moving]
            best[moving[on]] = value[on]
            at[moving[on]] = near[np.arange(len(moving)), j][on]
            moving = moving[on]
        return at, best

    def _beam(self, k: int, queries: np.ndarray, at: np.ndarray, best: np.ndarray, beam: int, reach: float = 2.0):
        """Beam search on level ``k``: the beam (nearest first), what was seen, hits within ``reach`` and those pushed out."""
        links, q_n, n = self.links[k], len(queries), len(self.unit)
        rows = np.arange(q_n)
        seen = np.zeros((q_n, n), dtype=bool)
        seen[rows, at] = True
        beam = min(beam, n)
        ids = np.full((q_n, beam), -1, dtype=np.int64)
        value = np.full((q_n, beam), -2, dtype=np.float32)
        open_ = np.zeros((q_n, beam), dtype=bool)
        ids[:, 0], value[:, 0], open_[:, 0] = at, best, True
        hits = [(rows[best >= reach], at[best >= reach])]
        lost = []
        active = rows
        while len(active):
            rank = np.where(open_[active], value[active], -3)
            j = rank.argmax(axis=1)
            go = rank[np.arange(len(active)), j] > -3
            active, j = active[go], j[go]
            if not len(active):
                break
            node = ids[active, j]
            open_[active, j] = False
            near = links[node]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            seen[np.repeat(active, near.shape[1])[fresh.ravel()], near[fresh]] = True
            got = np.einsum("qd,qkd->qk", queries[active], self.unit[near])
            got[~fresh] = -2
            q, c = np.nonzero(got >= reach)
            hits.append((active[q], near[q, c].astype(np.int64)))
            every = np.concatenate([value[active], got], axis=1)
            every_id = np.concatenate([ids[active], near], axis=1)
            every_open = np.concatenate([open_[active], fresh], axis=1)
            top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            out = np.ones_like(every, dtype=bool)
            np.put_along_axis(out, top, False, axis=1)
            gone = out & every_open & (every >= reach)  # within reach, and pushed out of the beam
            if gone.any():
                q, c = np.nonzero(gone)
                lost.append((active[q], every_id[q, c].astype(np.int64)))
            value[active] = np.take_along_axis(every, top, axis=1)
            ids[active] = np.take_along_axis(every_id, top, axis=1)
            open_[active] = np.take_along_axis(every_open, top, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(value, order, axis=1), seen, hits, lost

    def search(self, queries: np.ndarray, beam: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """``(query, node)`` of all nodes found with cosine ``reach`` or more.

        Greedy descent from the top, then a beam search on the base level.
        Nodes within reach are expanded too, however many there are, so a
        cluster larger than the beam is still walked whole.
        """
        queries = np.ascontiguousarray(queries, dtype=np.float32)
        q_n, n = len(queries), len(self.unit)
        if not q_n or not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, best = np.zeros(q_n, dtype=np.int64), queries @ self.unit[0]
        for k in reversed(range(1, len(self.links))):
            at, best = self._walk(k, queries, at, best)
        _, _, seen, hits, lost = self._beam(0, queries, at, best, beam, reach)
        links = self.links[0]
        while lost:
            q, node = (np.concatenate(x) for x in zip(*lost))
            lost = []
            for a in range(0, len(q), 1 << 15):
                near = links[node[a : a + (1 << 15)]]
                own = np.repeat(q[a : a + (1 << 15)], near.shape[1])
                near = near.ravel()
                fresh = np.flatnonzero((near >= 0) & ~seen[own, near])
                pair = np.unique(own[fresh] * n + near[fresh])
                own, near = pair // n, pair % n
                seen[own, near] = True
                for c in range(0, len(own), 1 << 15):
                    o, d = own[c : c + (1 << 15)], near[c : c + (1 << 15)]
                    ok = np.einsum("qd,qd->q", queries[o], self.unit[d]) >= reach
                    if ok.any():
                        hits.append((o[ok], d[ok]))
                        lost.append((o[ok], d[ok]))
        q, node = (np.concatenate(x) for x in zip(*hits))
        return q, self.place[node]


def _strongly_connected(links: np.ndarray) -> bool:
    """Whether links lead from every node to every other: out from the first to all, and back from all."""
    src = np.repeat(np.arange(len(links)), links.shape[1])
    dst = links.ravel().astype(np.int64)
    src, dst = src[dst >= 0], dst[dst >= 0]
    for a, b in ((src, dst), (dst, src)):
        order = np.argsort(a, kind="stable")
        b, first = b[order], np.searchsorted(a[order], np.arange(len(links) + 1))
        seen = np.zeros(len(links), dtype=bool)
        new = np.arange(min(1, len(links)))
        while len(new):
            seen[new] = True
            many = first[new + 1] - first[new]
            at = np.repeat(first[new] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            new = np.unique(b[at])
            new = new[~seen[new]]
        if not seen.all():
            return False
    return True


# --------------------------------------------------------------- operators


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def read_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, v)`` with ``v`` the vector's bytes in double precision.

    ``v`` is null, and the vector links with nothing, if the vector or its
    label is null, or if it is empty, zero, or holds a null or a component
    that isn't finite.
    """
    v = F.col(vector_col).cast("array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False)  # a null component is NaN here
            ends = ends - ends[0]
            with np.errstate(over="ignore"):
                square = flat * flat
            # a length is positive and finite only if every component is finite and some square isn't zero
            length = np.add.reduceat(np.r_[square, 0.0], ends[:-1]) * (np.diff(ends) > 0) if len(batch) else np.empty(0)
            good = np.isfinite(length) & (length > 0) & lists.is_valid().to_numpy(zero_copy_only=False)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [pa.array(good).buffers()[1], pa.py_buffer(8 * ends), pa.py_buffer(flat.astype("<f8"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data.cast(pa.binary())], names=["vec_id", "label", "v"])

    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v")).mapInArrow(run, "vec_id long, label string, v binary")
    return read.select("vec_id", "label", F.when(F.col("label").isNotNull(), F.col("v")).alias("v"))


def near_duplicate_vectors(
    vectors: DataFrame, least: float = 0.98, shard_size: int = 8_192, chunk: int = 32_768, beam: int = 24, recall: float = 0.99, audit: int = 48, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Equal vectors of a label are searched once and counted as often as they
    occur. Vectors of different lengths don't compare. Rows that share a
    vec_id are vectors of their own. A row with a null vec_id is linked and
    counted like any other; it names no component (``component_id`` is null
    only where all that is reachable has a null id) and its ``kept`` is null.
    No rows give no rows.
    """
    rows = materialize(
        read_vectors(vectors, id_col, vector_col, label_col).withColumn("group", F.concat_ws("|", F.octet_length("v").cast("string"), "label")).withColumn("digest", F.when(F.col("v").isNotNull(), F.sha2("v", 256))),
        "vectors",
    )
    valid = rows.where("v is not null")
    # a class of equal vectors is known by a number of its own; ids may be null or shared by different vectors
    classes = valid.groupBy("group", "digest").agg(F.min("vec_id").alias("rep"), F.first("v").alias("v"), F.count("*").alias("mult"))
    distinct = materialize(classes.withColumn("key", F.monotonically_increasing_id()), "distinct")
    sizes = distinct.groupBy("group").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / shard_size).cast("int")).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    placed = distinct.join(sizes, "group")
    shard = F.pmod(F.xxhash64("digest"), F.col("shards")).cast("int")
    members = placed.select("group", shard.alias("shard"), "key", "mult", "v", "chunks")
    graphs = materialize(deal(members, "group", "shard").sortWithinPartitions("group", "shard", "key").mapInArrow(_build, "group string, shard int, chunks int, graph binary"), "graphs")
    asked = placed.select(
        "group",
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("digest", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"),
        F.lit(1).alias("what"),
        "key",
        "v",
    )
    given = graphs.select("group", "shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("what"), F.lit(None).cast("long").alias("key"), F.col("graph").alias("v"))
    met = deal(given.unionByName(asked), "group", "shard", "chunk").sortWithinPartitions("group", "shard", "chunk", "what", "key")
    found = materialize(met.mapInArrow(_ask(least, beam, recall, audit), FOUND), "found")
    counts = found.where("n is not null").groupBy("key").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("root is not null").select(F.col("key").alias("src"), F.col("root").alias("dst"))).toDF("key", "root")
    linked = distinct.join(counts, "key", "left").join(roots, "key", "left").select("group", "digest", "rep", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    component = linked.groupBy("root").agg(F.min("rep").alias("component"))
    by_vector = linked.join(component, "root").select("group", "digest", "n_links", "component")
    joined = rows.select("vec_id", "group", "digest").join(by_vector, ["group", "digest"], "left")
    smallest = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), smallest.alias("component_id"), (F.col("vec_id") == smallest).alias("kept"))


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first ``width`` columns, each whole."""
    key, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(width))))
        cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for a, b in zip(cuts, [*cuts[1:], len(keys)]):
            if held and keys[a] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), dtype="<f8") for x in column])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (group, shard), rows in _groups(batches, 2):
        whole = _matrix(rows["v"])
        graph = SmallWorld(_unit(whole))
        blob = pickle.dumps((graph, whole, rows["key"].to_numpy(), rows["mult"].to_numpy()))
        yield pa.RecordBatch.from_pydict({"group": [group], "shard": pa.array([shard], pa.int32()), "chunks": pa.array([rows["chunks"][0].as_py()], pa.int32()), "graph": [blob]})


def _ask(least: float, beam: int, recall: float, audit: int, step: int = 512):
    reach = least - 1e-4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3):
            graph, whole, reps, mult = pickle.loads(rows["v"][0].as_py())
            rows = rows.slice(1)
            asked = rows["key"].to_numpy()
            if not len(asked):
                continue
            queries = _matrix(rows["v"])
            unit, own = _unit(queries), _unit(whole)
            width = _audited(graph, unit, asked, own, reps, least, beam, recall, audit)
            # places: members of the shard first, then those queries that aren't members
            order = np.argsort(reps, kind="stable")
            near = np.minimum(np.searchsorted(reps[order], asked), len(reps) - 1)
            member = reps[order][near] == asked
            place = np.where(member, order[near], len(reps) + np.arange(len(asked)))
            label = np.arange(len(reps) + len(asked))
            n = np.zeros(len(asked), dtype=np.int64)
            for a in range(0, len(asked), step):
                q, node = graph.search(unit[a : a + step], width, reach) if width else np.nonzero(unit[a : a + step] @ own.T >= reach)
                q += a
                for c in range(0, len(q), 1 << 16):
                    i, j = q[c : c + (1 << 16)], node[c : c + (1 << 16)]
                    x, y = queries[i], whole[j]
                    cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                    ok = (cosine >= least) & (asked[i] != reps[j])
                    i, j = i[ok], j[ok]
                    n += np.bincount(i, mult[j], len(n)).astype(np.int64)
                    label = merge(label, place[i], j)
            of = np.r_[reps, asked]
            linked = np.flatnonzero(label != np.arange(len(label)))
            counted = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[asked[counted], of[linked]]),
                    pa.array(np.r_[n[counted], np.zeros(len(linked), np.int64)], mask=np.r_[np.zeros(len(counted), bool), np.ones(len(linked), bool)]),
                    pa.array(np.r_[np.zeros(len(counted), np.int64), of[label[linked]]], mask=np.r_[np.ones(len(counted), bool), np.zeros(len(linked), bool)]),
                ],
                names=["key", "n", "root"],
            )

    return run


def _audited(graph: SmallWorld, unit: np.ndarray, asked: np.ndarray, own: np.ndarray, reps: np.ndarray, least: float, beam: int, recall: float, audit: int) -> int:
    """The narrowest of the doubled beams that reaches ``recall`` of what brute force finds, or 0 for brute force.

    Two things are audited, each by itself: the links of a sample of the
    queries, where there are any (a vector's link to itself doesn't count),
    and probes. A probe is made from a vector of the sample, in a random
    direction away from it, at a cosine of just ``least``: as far off as a
    link can be. So there is something to judge by however rare links are.
    0 means that no beam narrower than the shard passes, or that the graph
    isn't whole.
    """
    if not graph.whole:
        return 0
    sample = np.arange(0, len(unit), max(1, len(unit) // audit))[:audit]
    links = (unit[sample] @ own.T >= least) & (asked[sample, None] != reps)
    probes = _probes(unit[sample], least)
    near = probes @ own.T >= least
    while beam < len(own):
        passed = True
        for queries, truth in ((unit[sample], links), (probes, near)):
            wanted = int(truth.sum())
            if wanted:
                q, node = graph.search(queries, beam, least - 1e-4)
                passed &= int(truth[q, node].sum()) >= recall * wanted
        if passed:
            return beam
        beam *= 2
    return 0


def _probes(unit: np.ndarray, least: float) -> np.ndarray:
    """For each row a unit vector whose cosine with it is just above ``least``."""
    away = np.random.default_rng(len(unit)).normal(size=unit.shape)
    away -= (away * unit).sum(axis=1, keepdims=True) * unit
    length = np.sqrt((away * away).sum(axis=1, keepdims=True))
    away = np.divide(away, length, out=np.zeros_like(away), where=length > 1e-12)  # of one component there is no other direction
    cosine = min(1.0, least + 1e-9)
    return _unit(cosine * unit + math.sqrt(max(0.0, 1 - cosine * cosine)) * away)

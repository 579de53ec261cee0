"""SimHash near-duplicates: BK-trees over shards that share fingerprint bits.

Two fingerprints within ``radius`` bits agree on at least two of
``radius + 2`` bit blocks. Every pair of blocks gives each fingerprint one
key; the fingerprints with one key are a shard. A shard's BK-tree (children
keyed by their integer Hamming distance to the parent) is searched by the
shard's members along the edges that the radius allows. Members of a shard
larger than ``shard_size`` are dealt into chunks, and every two chunks of
it meet in a tree of their own, so no task holds more than two chunks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattis.llm.memory import trimmed
from lattis.operators.components import connected_components
from lattis.session import deal, materialize

# ----------------------------------------------------------- fingerprints


def simhash(text: str | None, words_each: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a whole text, unsigned.

    A-Z are lower-cased, words are runs without ASCII white space, shingles
    are ``words_each`` words (repeats count; of fewer words, the whole
    sequence). A bit is set if over half the shingles' XXH64 have it. No
    words, or a null text, give zero.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = partial(xxh64_intdigest, seed=seed)
    if len(words) <= words_each:
        return h(b" ".join(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(words_each))))
    n, ones = 0, np.zeros(64, dtype=np.int64)
    while chunk := list(map(h, itertools.islice(shingles, 1 << 15))):
        n += len(chunk)
        bits = np.unpackbits(np.array(chunk, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            found = np.fromiter((simhash(t.as_py(), words_each, seed) for t in batch.column(1)), dtype=np.uint64, count=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# --------------------------------------------------------------- BK-trees


class BKForest:
    """BK-trees of several shards, built level by level in numpy.

    ``values`` are sorted by ``shard``; each shard's first value is its root.
    All members of a node that lie at one distance from it form the subtree
    of the child with that edge.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        n = len(values)
        self.values = values
        self.edge = np.zeros(n, dtype=np.int16)
        self.parent = np.full(n, -1, dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.empty(0, np.int64)
        self.root = np.repeat(starts, np.diff(np.r_[starts, n]))
        member = np.setdiff1d(np.arange(n), starts, assume_unique=True)
        top = self.root[member]
        while len(member):
            distance = np.bitwise_count(values[member] ^ values[top]).astype(np.int64)
            order = np.lexsort((member, distance, top))
            member, top, distance = member[order], top[order], distance[order]
            first = np.r_[True, (top[1:] != top[:-1]) | (distance[1:] != distance[:-1])]
            head = np.maximum.accumulate(np.where(first, np.arange(len(member)), 0))
            child = member[head]
            self.parent[member[first]] = top[first]
            self.edge[member[first]] = distance[first]
            member, top = member[~first], child[~first]
        order = np.argsort(self.parent, kind="stable")
        order = order[self.parent[order] >= 0]
        self.children = order
        counts = np.bincount(self.parent[order], minlength=n) if n else np.zeros(0, np.int64)
        self.n_children = counts
        self.first_child = np.r_[0, np.cumsum(counts)[:-1]] if n else counts

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(query, node)`` index pairs at most ``radius`` apart, tree level by tree level.

        A child is entered only if its edge is within ``radius`` of the
        query's distance to the parent (the triangle inequality).
        """
        query, node = queries, self.root[queries]
        while len(query):
            distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int16)
            near = distance <= radius
            if near.any():
                yield query[near], node[near]
            many = self.n_children[node]
            at = np.repeat(self.first_child[node] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            child = self.children[at]
            query = np.repeat(query, many)
            on = np.abs(self.edge[child] - np.repeat(distance, many)) <= radius
            query, node = query[on], child[on]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the index of its root) after joining every ``a`` with its ``b``."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def shard_links(values: np.ndarray, shard: np.ndarray, radius: int, visits: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, within each shard, all values that the radius connects.

    One link from each value to the first of its component: as many links as
    values at most, however dense the shard is. ``visits`` bounds the
    queries' shard sizes taken at a time.
    """
    forest = BKForest(values, shard)
    label = np.arange(len(values))
    size = np.bincount(forest.root, minlength=len(values))[forest.root] if len(values) else label
    share = np.cumsum(size) // visits if len(values) else label
    for k in np.unique(share):
        for a, b in forest.within(np.flatnonzero(share == k), radius):
            label = merge(label, a, b)
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


# ------------------------------------------------------------- operators


def block_keys(fp: Column, radius: int) -> Column:
    """One long for each two of the ``radius + 2`` bit blocks: which two, and their bits."""
    blocks = radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    bits = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    wide = max(b - a for a, b in zip(cuts, cuts[1:]))
    pairs = list(itertools.combinations(range(blocks), 2))
    return F.array(*(F.lit(k).cast("long") * F.lit(1 << (2 * wide)) + bits[i] * F.lit(1 << wide) + bits[j] for k, (i, j) in enumerate(pairs)))


def link_fingerprints(distinct: DataFrame, radius: int = 3, shard_size: int = 16_384, batch_rows: int = 200_000) -> DataFrame:
    """Links ``(src, dst)`` between distinct ``fp`` that join all within ``radius``.

    Every pair within the radius is connected by these links; pairs
    themselves are not listed. ``distinct`` is read twice.
    """
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("key"))
    big = keyed.groupBy("key").count().where(F.col("count") > shard_size).select("key", F.ceil(F.col("count") / shard_size).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1)).cast("long")).cast("int")
    dealt = (
        keyed.join(big, "key", "left")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def search(block: np.ndarray) -> pa.RecordBatch:
            shard = np.cumsum(np.r_[0, (block[1:, :3] != block[:-1, :3]).any(axis=1)])
            many = np.bincount(shard)[shard] > 1
            src, dst = shard_links(block[many, 3].view(np.uint64), shard[many], radius)
            return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)]))
            rows += len(batch)
            if rows >= batch_rows:
                block = np.concatenate(held)
                last = np.flatnonzero((block[:, :3] != block[-1, :3]).any(axis=1))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield search(np.ascontiguousarray(block[:cut]))
                held, rows = [block[cut:]], len(block) - cut
        if rows:
            yield search(np.concatenate(held))

    return deal(dealt, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp").mapInArrow(run, "src long, dst long")


def near_duplicates(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``(doc_id, fp)``.

    ``prints`` must be stable when read again. Rows with one fingerprint are
    linked at distance 0; fingerprints at most ``radius`` apart are linked;
    ``component_id`` is the smallest ``doc_id`` reachable (null only if all
    reachable rows have a null id). No rows give no rows.
    """
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    links = materialize(link_fingerprints(groups.select("fp"), radius).distinct(), "links")
    roots = connected_components(links).toDF("fp", "root")
    placed = groups.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    first = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    component = placed.join(first, "root").select("fp", "component_id")
    return prints.join(component, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    return near_duplicates(prints, radius).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The rows of ``docs`` whose document represents its group; columns as they are.

    The smallest id of a group stays. Repeated rows of that id leave one row.
    Rows with a null id can't be named by a decision and stay.
    """
    found = materialize(near_duplicate_documents(docs, id_col, text_col, radius).where("doc_id is not null"), "groups")
    by_id = found.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
    # written, so that the size of this set is known where it is joined: documents move only if it is large
    marked = materialize(by_id.where("doc_id <> c or n > 1").select(F.col("doc_id").alias(id_col), (F.col("doc_id") == F.col("c")).alias("repeated")), "marked")
    once = docs.join(marked.select(id_col), id_col, "left_anti").select(docs.columns)
    repeated = marked.where("repeated").select(id_col)
    if repeated.isEmpty():
        return once
    return once.unionByName(docs.join(repeated, id_col, "left_semi").dropDuplicates([id_col]).select(docs.columns))

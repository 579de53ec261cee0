"""Centroid clustering of quantised vectors: Lloyd's rounds over distinct vectors with multiplicities.

All arithmetic is on integers and exact, so a result doesn't depend on how
rows are dealt out, and lost tasks come back with the same numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm.hot import join_groups
from lattis.session import materialize

CLUSTERED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
#: Components up to this size give squared distances and differences that fit 64 bits for 64 components.
SMALL = 1 << 26
LONGEST = (1 << 63) - 1
SUMS = "cluster int, dim int, total decimal(38,0), n long"


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, q``: the vectors with exactly ``dims`` finite components, each as floor(scale * x).

    Vectors that are null, shorter or longer, or hold a null, a NaN or an
    infinite component are left out. Integers beyond 64 bits become the
    nearest that fits.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(whole).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))


def seeds(rows: DataFrame, k: int = 8, seed: int = 3) -> np.ndarray:
    """The ``k`` vectors of ``rows`` with the smallest sha256 of ``<seed>:<vec_id>``, in that order.

    Fewer rows give fewer centroids; a row without an id is never one. Rows
    that share an id come in the order of their components.
    """
    first = rows.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "q").limit(k).collect()
    return np.array([r["q"] for r in first], dtype=np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centroid, smaller numbers first, and the squared distance.

    Numbers too large for 64-bit squares are computed as Python integers; a
    distance over 2**63 - 1 is given as that.
    """
    size = max(int(np.abs(x.astype(float)).max(initial=0)) for x in (q, centroids))
    if size <= SMALL // max(1, q.shape[1] // 64):
        best = np.full(len(q), LONGEST, dtype=np.int64)
        cluster = np.zeros(len(q), dtype=np.int32)
        for c, centre in enumerate(centroids):
            gap = q - centre
            d = np.einsum("ij,ij->i", gap, gap)
            closer = d < best
            best[closer], cluster[closer] = d[closer], c
        return cluster, best
    d = ((q.astype(object)[:, None, :] - centroids.astype(object)[None, :, :]) ** 2).sum(axis=2)
    cluster = np.array([min(range(len(centroids)), key=row.__getitem__) for row in d], dtype=np.int32)
    return cluster, np.array([min(LONGEST, row[c]) for row, c in zip(d, cluster)], dtype=np.int64)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    q = batch.column("q")
    return q.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def weighted_sums(q: np.ndarray, weights: np.ndarray, cluster: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """``(cluster, component, sum of weight x value, sum of weights)`` for the clusters that have rows, exactly."""
    total = sum(int(w) for w in weights)
    exact = float(np.abs(q.astype(float)).max(initial=0)) * total < 2.0**62
    out = []
    for c in range(k):
        at = cluster == c
        if at.any():
            own, w = (q[at], weights[at]) if exact else (q[at].astype(object), weights[at].astype(object))
            n = int(w.sum())
            out += [(c, j, int(s), n) for j, s in enumerate(w @ own)]
    return out


def step(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over ``distinct`` (``q, n``): floor(sum / count) of each cluster's vectors.

    A cluster without a vector keeps its centroid. Each task gives one row a
    cluster and component; their sums, as many rows, go to the driver.
    """
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch)
            for c, j, s, n in weighted_sums(q, batch.column("n").to_numpy(), nearest(q, centroids)[0], k):
                own = found.setdefault((c, j), [0, 0])
                own[0] += s
                own[1] += n
        if found:
            kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
            columns = zip(*((c, j, Decimal(s), n) for (c, j), (s, n) in found.items()))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, kinds)], names=["cluster", "dim", "total", "n"])

    moved = centroids.copy()
    for r in distinct.mapInArrow(run, SUMS).groupBy("cluster", "dim").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).collect():
        moved[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return moved


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``distinct`` (``key, q, n``) with ``cluster`` and ``distance``, without ``q``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cluster, distance = nearest(_matrix(batch), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(cluster), pa.array(distance)], names=["key", "n", "cluster", "distance"])

    return distinct.select("key", "q", "n").mapInArrow(run, "key long, n long, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Columns ``CLUSTERED``: a row a kept vector, after ``rounds`` of Lloyd's algorithm.

    Vectors are quantised (:func:`quantised` says which are kept) and the
    first centroids chosen (:func:`seeds`). Each round assigns every vector
    to the nearest centroid by squared distance, the smaller number among
    equals, and moves every centroid that has vectors to floor(sum / count)
    in each component. ``cluster_inertia`` and ``inertia`` sum the distances
    of a cluster and of all (null where a sum is over 64 bits);
    ``centroid_sha256`` is of the cluster's last centroid, its components in
    decimal, joined by commas.

    Identical quantised vectors are one row with a multiplicity, combined
    before the shuffle, so copies cost nothing in a round; the rows are
    joined to their assignment at the end, the commonest vectors by
    broadcast, a thousand at most (:func:`join_groups`). Repeated rows count
    as often as they occur. A null id is a vector like any other. No kept
    vector gives no rows; if none of those kept has an id, there is no
    centroid and no rows either. Extra columns play no part.
    To the driver go ``k`` x ``dims`` sums a round.
    """
    rows = materialize(quantised(vectors, dims, scale, id_col, vector_col), "quantised")
    centroids = seeds(rows, k, seed)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], CLUSTERED)
    counted = rows.groupBy("q").agg(F.count("*").alias("n"))
    distinct = materialize(counted.select(F.monotonically_increasing_id().alias("key"), "q", "n"), "distinct")
    for _ in range(rounds):
        moved = step(distinct, centroids)
        if (moved == centroids).all():
            break  # every later round would give the same
        centroids = moved
    found = materialize(assigned(distinct, centroids), "assigned")
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("total"), F.sum("n").alias("n")).collect()
    total = sum(int(r["total"]) for r in by_cluster)
    fits = lambda x: x if x <= LONGEST else None
    said = [(r["cluster"], fits(int(r["total"])), fits(total), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in by_cluster]
    digests = rows.sparkSession.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    by_vector = distinct.select("key", "q").join(found, "key").select("q", "n", "cluster", "distance").join(F.broadcast(digests), "cluster")
    n_rows = sum(r["n"] for r in by_cluster)
    return join_groups(rows, by_vector, "q", "n", n_rows).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

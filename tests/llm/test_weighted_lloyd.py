import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattis.llm import weighted_lloyd as W

SCHEMA = "vec_id long, label int, embedding array<double>, q string, cluster int"


def plain(rows, k=8, rounds=10, dims=64):
    """The same by loops over Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centres = [q for _, q in order[:k]]

    def assign():
        out = []
        for _, q in kept:
            d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for c in range(len(centres)):
            own = [q for (_, q), (x, _) in zip(kept, at) if x == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    per = {c: sum(d for x, d in at if x == c) for c, _ in at}
    return sorted(((i, c, d, per[c], sum(per.values()), digest[c]) for (i, _), (c, d) in zip(kept, at)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, 1, v, "x", 5) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_equals_loops_over_integers(spark, seed):
    rng = random.Random(seed)
    base = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(40)]
    rows = [(i, rng.choice(base) if i % 3 else base[0]) for i in range(150)]
    rows += [(200, None), (201, base[1][:63]), (202, base[1] + [0.0]), (203, [None] + base[1][1:]), (204, [math.nan] + base[1][1:]), (205, [math.inf] + base[1][1:]), (None, base[2]), (7, base[3]), (7, base[3])]
    assert found(W.cluster_vectors(table(spark, rows).repartition(5))) == plain(rows)


def test_few_vectors_ties_and_none(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(3)]
    assert found(W.cluster_vectors(table(spark, rows))) == plain(rows)
    assert found(W.cluster_vectors(table(spark, []))) == []
    assert found(W.cluster_vectors(table(spark, [(1, None), (None, [0.0] * 64)]))) == []


def test_more_than_64_bits(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** rng.choice([0, 20, 40]) for _ in range(64)]) for i in range(30)]
    got, want = found(W.cluster_vectors(table(spark, rows))), plain(rows)
    assert [(g[0], g[1], g[5]) for g in got] == [(w[0], w[1], w[5]) for w in want]
    assert [g[2] for g in got] == [min(w[2], 2**63 - 1) for w in want]


def test_sums_are_exact_where_64_bits_overflow():
    q = np.array([[2**40, -(2**40)], [3, 5]])
    n = np.array([2**30, 7])
    assert W.weighted_sums(q, n, np.array([0, 0]), 2) == [(0, 0, 2**70 + 21, 2**30 + 7), (0, 1, -(2**70) + 35, 2**30 + 7)]
    assert W.weighted_sums(q, np.array([1, 1]), np.array([1, 0]), 2) == [(0, 0, 3, 1), (0, 1, 5, 1), (1, 0, 2**40, 1), (1, 1, -(2**40), 1)]


def test_one_vector_holds_most_rows(spark):
    base = [[float((i * j) % 7) / 7 for j in range(64)] for i in range(50)]
    rows = [(i, base[0] if i % 3 else base[i % 50]) for i in range(3000)]
    df = W.cluster_vectors(table(spark, rows))
    assert found(df) == plain(rows)
    assert W.quantised(table(spark, rows)).groupBy("q").count().count() == len({tuple(v) for _, v in rows})


def test_float_components_are_taken_as_doubles(spark):
    df = spark.createDataFrame([(1, [0.1] * 64)], "vec_id long, embedding array<float>")
    q = W.quantised(df).first()["q"]
    assert q == [math.floor(1024 * float(np.float32(0.1)))] * 64
    assert W.quantised(df.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))).count() == 0

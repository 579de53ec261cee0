"""Tail fits, latency histograms, and joins by time, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattis.operators import histograms as H
from lattis.operators import intervals as I
from lattis.operators import tails as T


def test_zeta():
    assert float(T.zeta(2, 1)) == pytest.approx(math.pi**2 / 6, abs=1e-10)
    assert float(T.zeta(4, 1)) == pytest.approx(math.pi**4 / 90, abs=1e-10)
    assert float(T.zeta(1.5, 7)) == pytest.approx(sum((7 + k) ** -1.5 for k in range(2_000_000)) + 2 / math.sqrt(2_000_007), abs=1e-6)


def sample(alpha, xmin, n, seed):
    """Whole numbers of a power law, by the inverse of its distribution."""
    x = np.arange(xmin, 2_000_000)
    p = x ** -alpha / float(T.zeta(alpha, xmin))
    return np.random.default_rng(seed).choice(x, n, p=p / p.sum())


@pytest.mark.parametrize("alpha,xmin", [(2.1, 1), (2.5, 1), (3.0, 4)])
def test_exponents_of_seeded_samples(spark, alpha, xmin):
    body = np.random.default_rng(1).integers(1, xmin, 4_000) if xmin > 1 else np.array([], dtype=int)
    degree, n = np.unique(np.r_[body, sample(alpha, xmin, 30_000, 3)], return_counts=True)
    rows = spark.createDataFrame([(int(d), int(k)) for d, k in zip(degree, n)], "degree long, n long")
    r = T.tail_fit(rows).first()
    assert r["alpha"] == pytest.approx(alpha, abs=0.05) and r["ratio"] > 0 and r["p"] < 0.01 and r["n"] == len(body) + 30_000
    assert xmin <= r["cutoff"] <= xmin + 6


def test_an_exponential_tail_and_small_graphs(spark):
    degree, n = np.unique(np.random.default_rng(5).geometric(0.2, 20_000), return_counts=True)
    rows = [("e", int(d), int(k)) for d, k in zip(degree, n)] + [("few", 1, 3), ("few", 2, 2), ("one", 4, 100), ("none", 0, 5), ("none", None, 5)]
    got = {r["g"]: r for r in T.tail_fit(spark.createDataFrame(rows, "g string, degree long, n long"), ["g"], least_tail=500).collect()}
    assert got["e"]["ratio"] < 0 and got["e"]["rate"] == pytest.approx(-math.log(0.8), abs=0.05)
    assert set(got) == {"e", "few", "one"} and (got["few"]["n"], got["few"]["alpha"], got["one"]["cutoff"]) == (5, None, None)
    assert T.tail_fit(spark.createDataFrame([], "degree long, n long")).collect() == []


def test_degree_histogram(spark):
    edges = spark.createDataFrame([("x", "a", "b"), ("x", "b", "a"), ("x", "a", "c"), ("x", "d", "d"), ("y", "a", "b"), ("y", None, "b")], "g string, source_id string, target_id string")
    assert {tuple(r) for r in T.degree_histogram(edges, ["g"]).collect()} == {("x", 2, 1), ("x", 1, 2), ("y", 1, 2)}
    assert {tuple(r) for r in T.degree_histogram(edges).collect()} == {(2, 1), (1, 2)}


def test_percentiles_within_a_thousandth(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.lognormal(2, 2, 30_000), "few": rng.lognormal(0, 3, 7), "one": np.array([12.3456]), "wide": 10 ** rng.uniform(-2, 6, 3_000), "flat": np.full(50, 3.0)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    hist = H.latency_histogram(df, ["g"], "x")
    assert hist.groupBy("g").count().agg(F.max("count")).first()[0] <= 23_000
    for r in H.percentiles(hist, ["g"]).collect():
        xs = groups[r["g"]]
        assert r["n"] == len(xs) and r["min"] == pytest.approx(xs.min(), abs=6e-4) and r["max"] == pytest.approx(xs.max(), abs=6e-4) and r["mean"] == pytest.approx(xs.mean(), rel=1e-3)
        for name, q in (("p50", 50), ("p95", 95), ("p99", 99), ("p999", 99.9)):
            assert r[name] == pytest.approx(np.percentile(xs, q), rel=1e-3, abs=1e-3)
    parts = H.latency_histogram(df.where("rand(3) < 2 and x < 5"), ["g"], "x").unionByName(H.latency_histogram(df.where("x >= 5 and not isnan(x)"), ["g"], "x"))
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(H.merged(parts, ["g"])) == key(hist)


def test_out_of_range_values(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (1e12,)], "x double")
    r = H.percentiles(H.latency_histogram(df, [], "x"), []).first()
    assert (r["n"], r["min"], r["max"]) == (3, 0.001, 3_600_000.0)


@pytest.mark.parametrize("seed", range(2))
def test_valid_at_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    points = [(i, key(), rng.choice([None, *range(-50, 1000)])) for i in range(150)]
    facts = [(i, key(), rng.choice([None, rng.randrange(-60, 1000)]), rng.choice([None, rng.randrange(-60, 1100)])) for i in range(120)]
    facts += [(200, "a", 5, 5), (201, "a", 7, 8), (202, "b", -(10**15), 10**15)] * 2
    got = I.valid_at(spark.createDataFrame(points, "p int, k string, t long"), spark.createDataFrame(facts, "f int, k string, valid_from long, valid_to long"), "k")
    want = sorted((p, f) for p, k, t in points for f, j, s, e in facts if k is not None and k == j and t is not None and (s is None or s <= t) and (e is None or t < e))
    assert sorted((r["p"], r["f"]) for r in got.collect()) == want and len(want) > 100
    assert I.valid_at(spark.createDataFrame(points, "p int, k string, t long"), spark.createDataFrame([], "f int, k string, valid_from long, valid_to long"), "k").collect() == []


@pytest.mark.parametrize("or_equal", [True, False])
def test_last_before_equals_a_plain_search(spark, or_equal):
    rng = random.Random(9)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(200)] + [(7, "hot", 30)] * 2
    right = [(key(), rng.choice([None, *range(60)]), rng.choice([None, 1, 2, 3])) for _ in range(80)]
    got = I.last_before(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int"), "k", take=["v"], or_equal=or_equal).collect()

    def best(k, t):
        fits = [(u, -1 if v is None else v, v) for j, u, v in right if k is not None and j == k and None not in (t, u) and (u <= t if or_equal else u < t)]
        return (max(fits)[0], max(fits)[2]) if fits else (None, None)

    assert sorted(map(str, ((r["i"], r["k"], r["t"], r["right_t"], r["v"]) for r in got))) == sorted(map(str, ((i, k, t, *best(k, t)) for i, k, t in left)))

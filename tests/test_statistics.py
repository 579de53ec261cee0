"""Pinned and brute-force values of the statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattis.operators import ranks as R
from lattis.operators import stats as T


def test_pinned_bootstrap(spark):
    a, b = [0.8, 0.6, 0.7, 0.9, 0.5, 0.4, 0.8, 0.7, 0.6, 0.5], [0.5, 0.4, 0.6, 0.7, 0.3, 0.2, 0.6, 0.5, 0.4, 0.3]
    rows = spark.createDataFrame([("x", i, x - y) for i, (x, y) in enumerate(zip(a, b))], "family string, ord int, diff double")
    r = T.paired_bootstrap(rows, ["family"], resamples=1000).first()
    assert r["mean"] == pytest.approx(0.2) and r["p"] == 0
    assert (round(r["low"], 2), round(r["high"], 2)) == (0.17, 0.23)


def test_bootstrap_chunks_change_nothing():
    d = np.arange(7.0)
    assert (T.bootstrap_means(d, 50, 1, chunk=7) == T.bootstrap_means(d, 50, 1, chunk=50)).all()


def test_poisson_bootstrap_is_near_the_plain_one(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(rng.normal(0.1, 1, 2000))], "family string, id long, diff double")
    r = T.poisson_bootstrap(rows, ["family"], "id", resamples=300).first()
    assert r["high"] - r["low"] == pytest.approx(2 * 1.96 / 2000**0.5, rel=0.2)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.2, 0.8]
    found = {r["id"]: (r["p_adjusted"], r["rejected"]) for r in T.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "id int, p double")).collect()}
    order = sorted(range(5), key=lambda i: p[i])
    low, expected = 1.0, {}
    for rank in range(5, 0, -1):
        low = min(low, p[order[rank - 1]] * 5 / rank)
        expected[order[rank - 1]] = low
    assert all(found[i][0] == pytest.approx(x) and found[i][1] == (x <= 0.05) for i, x in expected.items())
    with pytest.raises(Exception, match="p must be"):
        T.benjamini_hochberg(spark.createDataFrame([(1, 1.5)], "id int, p double")).collect()
    with pytest.raises(ValueError):
        T.benjamini_hochberg(spark.createDataFrame([(1, 0.5)], "id int, p double"), alpha=0)


@pytest.mark.parametrize(("k", "n"), [(0, 0), (0, 5), (3, 10), (5, 10), (90, 200), (2, 700)])
def test_exact_binomial(spark, k, n):
    got = spark.createDataFrame([(k, n)], "k long, n long").select(T.binomial_two_sided(F.col("k"), F.col("n")).alias("p")).first()["p"]
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) if n else 1
    assert got == pytest.approx(1.0 if n == 0 else min(1.0, float(2 * tail / 2**n)), rel=1e-9)


def test_isotonic(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 12, 80), rng.integers(0, 2, 80)
    found = {r["x"]: r["fitted"] for r in T.isotonic(spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "score double, y int")).collect()}
    u = sorted(set(x.tolist()))
    for k in u:  # the largest lower mean of the smallest upper mean
        slow = max(min(y[(x >= i) & (x <= j)].mean() for j in u if j >= k) for i in u if i <= k)
        assert found[float(k)] == pytest.approx(slow, abs=1e-8)


def test_spearman(spark):
    one = lambda rows: T.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()["rho"]
    assert one([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0)]) == 1.0
    assert one([(1.0, 3.0), (2.0, 3.0), (3.0, 3.0)]) is None and one([(1.0, 1.0), (2.0, 2.0)]) is None
    assert one([(1.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 3.0)]) == pytest.approx(0.888889)


def test_verdicts_are_strict_at_five_points(spark):
    def verdict(a, b, c):
        rows = [(k, 1, float(v)) for k, v in (("A", a), ("B", b), ("C", c))]
        return R.verdict(R.condition_deltas(spark.createDataFrame(rows, "condition string, min_hops int, recall double"))).first()["verdict"]

    assert verdict(0.5, 0.55, 0.55) == "no difference"
    assert verdict(0.5, 0.5501, 0.6) == "content helps, structure doesn't"
    assert verdict(0.5, 0.6, 0.5) == "structure helps"
    assert verdict(0.6, 0.5, 0.5) == "structure hurts"


def test_gini(spark):
    from lattis.operators.topology import gini

    values = [0.0, 1.0, 1.0, 5.0, 9.0]
    got = gini(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()["gini"]
    slow = sum(abs(a - b) for a in values for b in values) / (2 * len(values) * sum(values))
    assert got == pytest.approx(slow, abs=1e-6)
    assert gini(spark.createDataFrame([(0.0,), (0.0,)], "v double"), "v").first()["gini"] == 0.0


def test_labels(spark):
    rows = spark.createDataFrame([("x", 1.0, "CORRECT", False), ("x", 0.0, "ABSTAIN", False), ("x", 0.0, "nonsense", True), ("x", 0.0, None, True)], "category string, recall double, label string, is_abstention boolean")
    r = T.dual_metric(rows).where("category is null").first()
    assert (r["n"], r["judged"], r["accuracy"], r["errors"]) == (4, 2, 1.0, 1)
    assert T.label_accuracy(rows).first()["right"] == 1

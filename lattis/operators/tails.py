"""Whether degrees fall off like a power: a fit of the tail by likelihood (TOP23)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.session import deal

FIT = "n long, cutoff long, n_tail long, alpha double, distance double, rate double, ratio double, p double"


def degree_histogram(edges: DataFrame, by: Sequence[str] = (), rows_a_task: int = 1 << 20) -> DataFrame:
    """``(by..., degree, n)`` of the simple graph without direction; nodes without an edge don't count.

    Edges are dealt to tasks of about ``rows_a_task`` before repeats go, so
    that what a task holds doesn't grow with the graph.
    """
    ends = edges.where("source_id <> target_id")
    both = ends.select(*by, F.col("source_id").alias("u"), F.col("target_id").alias("v")).unionAll(ends.select(*by, "target_id", "source_id"))
    once = deal(both, *by, "u", "v", least=1 + 2 * ends.count() // rows_a_task).distinct()
    return once.groupBy(*by, "u").agg(F.count("*").alias("degree")).groupBy(*by, "degree").agg(F.count("*").alias("n"))


def zeta(s: np.ndarray, q: np.ndarray, terms: int = 12) -> np.ndarray:
    """Hurwitz's zeta function, the sum of (q + k) ** -s over k from 0: some terms, then Euler and Maclaurin's tail."""
    s, q = np.broadcast_arrays(np.asarray(s, dtype=float), np.asarray(q, dtype=float))
    k = np.arange(terms).reshape(-1, *([1] * s.ndim))
    head = ((q + k) ** -s).sum(axis=0)
    x = q + terms
    tail = x ** (1 - s) / (s - 1) + 0.5 * x**-s + s * x ** (-s - 1) / 12 - s * (s + 1) * (s + 2) * x ** (-s - 3) / 720 + s * (s + 1) * (s + 2) * (s + 3) * (s + 4) * x ** (-s - 5) / 30240
    return head + tail


def fit_tail(degree: np.ndarray, n: np.ndarray, least_tail: int = 10) -> tuple:
    """The values of ``FIT`` for distinct degrees of 1 and more, in ascending order, and their counts.

    For each degree as cut-off the exponent of greatest likelihood is found
    among all at once; the cut-off is that whose model is nearest to the
    data (Kolmogorov and Smirnov's distance), the smaller of equals, among
    those that leave ``least_tail`` nodes and two degrees. Over the same
    tail an exponential is fitted; ``ratio`` is the normalised ratio of the
    log-likelihoods, above 0 where the power law fits better, and ``p`` the
    chance of one as far from 0 if neither did. Without a cut-off all is
    null but ``n``.
    """
    total = int(n.sum())
    none = (total, *[None] * 7)
    degree, n = np.asarray(degree, dtype=float), np.asarray(n, dtype=float)
    behind = np.cumsum(n[::-1])[::-1]
    logs = np.cumsum((n * np.log(np.maximum(degree, 1e-300)))[::-1])[::-1]
    usable = np.flatnonzero((behind >= least_tail) & (np.arange(len(degree)) < len(degree) - 1))
    if not len(usable):
        return none
    x, count, log = degree[usable], behind[usable], logs[usable]
    low, high = np.full(len(x), 1.0001), np.full(len(x), 25.0)
    golden = (math.sqrt(5) - 1) / 2
    fit = lambda a: -count * np.log(zeta(a, x)) - a * log
    for _ in range(60):  # one maximum: the likelihood of an exponential family is concave
        a, b = high - golden * (high - low), low + golden * (high - low)
        better = fit(a) > fit(b)
        high, low = np.where(better, b, high), np.where(better, low, a)
    alpha = (low + high) / 2
    best = (math.inf, 0)
    for i, (at, a, c) in enumerate(zip(usable, alpha, count)):
        seen = np.cumsum(n[at:]) / c
        model = 1 - zeta(a, degree[at:] + 1) / zeta(a, degree[at])
        best = min(best, (float(np.abs(seen - model).max()), i))
    i = best[1]
    at, a, xmin = usable[i], alpha[i], x[i]
    d, w = degree[at:], n[at:]
    m = w.sum()
    rate = math.log1p(1 / ((w * d).sum() / m - xmin))
    gap = (-a * np.log(d) - math.log(float(zeta(a, xmin)))) - (math.log(-math.expm1(-rate)) - rate * (d - xmin))
    mean = (w * gap).sum() / m
    sigma = math.sqrt((w * (gap - mean) ** 2).sum() / m)
    ratio = mean * math.sqrt(m) / sigma if sigma > 0 else 0.0
    return total, int(xmin), int(m), float(a), best[0], rate, ratio, math.erfc(abs(ratio) / math.sqrt(2))


def tail_fit(histogram: DataFrame, by: Sequence[str] = (), least_tail: int = 10) -> DataFrame:
    """``(by..., FIT)``: a row a graph, from ``(by..., degree, n)`` (TOP23); see :func:`fit_tail`.

    Only the histogram of a graph meets in one task, which has at most twice
    as many rows as the root of its number of edges. Degrees under 1, and
    rows without a degree or count, are left out; a graph of none has no row.
    """
    keys = list(by) or ["_all"]
    rows = histogram.where("degree >= 1 and n > 0")
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), FIT])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.groupby("degree", as_index=False)["n"].sum().sort_values("degree")
        found = fit_tail(one["degree"].to_numpy(), one["n"].to_numpy(), least_tail)
        frame = pd.DataFrame([(*key, *found)], columns=[*keys, *(c.split()[0] for c in FIT.split(", "))])
        return frame.astype({"cutoff": "Int64", "n_tail": "Int64"})

    fitted = rows.select(*keys, "degree", "n").groupBy(*keys).applyInPandas(run, schema)
    return fitted if by else fitted.drop("_all")

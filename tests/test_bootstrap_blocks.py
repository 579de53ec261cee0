"""Groups of any number of pairs give the resamples of one task."""

import numpy as np
import pytest

from lattis.operators import stats as T


def test_groups_of_many_pairs_are_dealt(spark):
    rng = np.random.default_rng(5)
    rows = [(g, i, float(v)) for g, n in (("a", 1_000), ("b", 350)) for i, v in enumerate(rng.normal(0.02, 1, n))]
    found = {r["g"]: r for r in T.paired_bootstrap(spark.createDataFrame(rows, "g string, ord int, diff double"), ["g"], resamples=300, most=300).collect()}
    for g in "ab":
        d = np.array([x for k, _, x in rows if k == g])
        means = T.bootstrap_means(d, 300, 42)
        want = [len(d), d.mean(), *np.percentile(means, [2.5, 97.5]), min(1, 2 * ((means <= 0) if d.mean() > 0 else (means >= 0)).mean())]
        assert [found[g][c] for c in ("n", "mean", "low", "high", "p")] == pytest.approx(want)


def test_draws_may_be_cut_within_a_resample():
    d = np.random.default_rng(1).normal(size=50)
    whole = T.bootstrap_sums(d, 50, 0, 20, 7)
    parts = sum(T.bootstrap_sums(d[a : a + 20], 50, a, 20, 7, draws=17) for a in (0, 20, 40))
    assert parts == pytest.approx(whole) and whole / 50 == pytest.approx(T.bootstrap_means(d, 20, 7))

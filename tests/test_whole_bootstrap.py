"""The query's intervals are those of all 10,000 resamples."""

import numpy as np
import pytest

from lattis.operators import stats as T
from lattis.plans import evaluation as E


def test_paired_bootstrap_resamples_ten_thousand_times(spark, sf_dir):
    pairs = T.paired(E._arm(spark, sf_dir, "B"), E._arm(spark, sf_dir, "A")).toPandas().sort_values("qid")
    found = {r["hops"]: r for r in E.paired_bootstrap(spark, sf_dir).collect()}
    assert sorted(found) == [0, 1, 2]
    for hops, r in found.items():
        d = pairs[pairs["qid"] % 3 == hops]["diff"].to_numpy(dtype=float)
        means = T.bootstrap_means(d, 10_000, 42)
        p = min(1, 2 * ((means <= 0) if d.mean() > 0 else (means >= 0)).mean())
        assert [r[c] for c in ("n", "mean", "low", "high", "p")] == pytest.approx([len(d), d.mean(), *np.percentile(means, [2.5, 97.5]), p])

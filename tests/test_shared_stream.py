"""Tasks that start anywhere in the legacy stream draw what one would."""

import numpy as np
import pytest

from lattis.operators import stats as T
from lattis.operators.twister import stream_from


@pytest.mark.parametrize("place", (0, 623, 624, 30_001, 1_000_003))
def test_the_stream_goes_on_from_any_place(place):
    plain = np.random.RandomState(42)
    plain.randint(0, 1 << 32, size=place, dtype=np.uint32)
    assert (stream_from(42, place).randint(0, 1_000, size=700) == plain.randint(0, 1_000, size=700)).all()


def test_shared_streams_give_the_resamples_of_one(spark):
    rng = np.random.default_rng(5)
    rows = [(g, i, float(v)) for g, n in (("a", 1_000), ("b", 350), (None, 350), ("c", 2), ("d", 1)) for i, v in enumerate(rng.normal(0.02, 1, n))]
    frame = spark.createDataFrame(rows, "g string, ord int, diff double")
    found = {}
    for r in T._resampled(frame, ["g"], 300, 42, 600, words=20_000).collect():
        n, total, sums = found.get(r["g"], (0, 0.0, 0.0))
        found[r["g"]] = (r["n"], total + r["total"], sums + np.array(r["sums"]))
    assert len(T._shares(1_000, 300, 20_000)) > 10 and len(T._shares(2, 300, 20_000)) == 1
    for g, (n, total, sums) in found.items():
        d = np.array([x for k, _, x in rows if k == g])
        assert n == len(d) and total == pytest.approx(d.sum()) and sums / n == pytest.approx(T.bootstrap_means(d, 300, 42))
    assert len(found) == 5

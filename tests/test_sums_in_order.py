"""Sums of doubles whose last bit decides."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lattis.plans import catalog  # noqa: F401
from lattis.plans.registry import ORACLE_SQL, QUERIES

#: In cents, each comes to a multiple of 50; in doubles, some to less, and not the same in every order.
VALUES = [[0.1] * 500, [49.0] + [0.1] * 10, [0.1] * 10 + [49.0], [0.7] * 500, [33.33, 33.34, 33.33], [16.67, 16.66, 16.67], [1.1] * 500, [5.0]]


@pytest.mark.parametrize("files", (1, 3))
def test_bh_fdr_adds_up_in_the_order_of_the_file(spark, tmp_path, files):
    longest = max(map(len, VALUES))
    rows = [(user, v[i]) for i in range(longest) for user, v in enumerate(VALUES) if i < len(v)]
    (tmp_path / "events.parquet").mkdir()
    step = -(-len(rows) // files)
    for n in range(files):
        some = rows[n * step : (n + 1) * step]
        pq.write_table(pa.table({"user_id": [u for u, _ in some], "value": [v for _, v in some]}), tmp_path / f"events.parquet/part-{n}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL["bh_fdr"]).fetchall()
    assert {tuple(r) for r in QUERIES["bh_fdr"](spark, str(tmp_path)).collect()} == set(want)
    assert any(p != 1 for i, p, *_ in want if i < len(VALUES) - 1)

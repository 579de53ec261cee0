"""The search goes over numbers; the query's components come from customers and days."""

import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from lattis.operators import paths as P
from lattis.plans import catalog  # noqa: F401
from lattis.plans.registry import ORACLE_SQL, QUERIES
from tests.test_paths import near, plain


def test_orders_with_repeated_keys_and_nulls_equal_the_sql(spark, tmp_path):
    rng = random.Random(3)
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n, hours=n % 5)
    rows = [(k, rng.randrange(900), day(rng.randrange(700))) for k in range(0, 3_000) if k % 3 == 0 or k % 100 < 2]
    rows += [(100, 5_000, day(9_000)), (101, 5_001, day(9_001)), (100, 5_002, day(9_002)), (5_000, 5_001, day(9_003)), (5_000, 5_002, day(9_004)), (201, None, None), (300, None, day(1)), (7_000, 8_000, day(9_100))]
    pq.write_table(pa.table({"o_orderkey": [r[0] for r in rows], "o_custkey": [r[1] for r in rows], "o_orderdate": [r[2] for r in rows]}), tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = set(con.execute(ORACLE_SQL["paths"]).fetchall())
    assert {tuple(r) for r in QUERIES["paths"](spark, str(tmp_path)).collect()} == want
    assert {r[3] for r in want} == {"found", "further", "apart"}


def test_rounds_move_numbers(spark):
    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite() / 1e6

    rng = random.Random(1)
    name = lambda i: f"a node of a rather long name, of the kind {i * i % 997}:{i}"
    edges = [(name(i), name(rng.randrange(4_000))) for i in range(4_000)] + [(name(i), name(i + 1)) for i in range(3_999)]
    pairs = [(name(i), name(i + 1_000)) for i in range(0, 3_000, 20)]
    before = shuffled()
    got = P.shortest_paths(spark.createDataFrame(edges, "source_id string, target_id string"), spark.createDataFrame(pairs, "a string, b string"), 6).collect()
    mb = shuffled() - before
    graph = near(edges)
    assert {(r["a"], r["b"]): (r["hops"], r["status"], r["path"]) for r in got} == {p: plain(graph, *p, 6) for p in pairs}
    assert mb < 2.7  # by name 3.5

"""Labels anywhere in a text, as the SQL finds them."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lattis.operators import retrieval as R
from lattis.plans import catalog  # noqa: F401
from lattis.plans.registry import ORACLE_SQL, QUERIES

NAMES = ["large ring", "large string", "RING", "rin", "o", "hot stringer", "hot unstringent", "zzz", "!!", "what!! else", "un!!tidy bo!!lt", "é", "caf crémeux", "Large Ring", "blue", "steel plate", None, "old plate", "  ", "x zz", "plates steel of", "then", "n"]


@pytest.mark.parametrize("more", ([], [""]))
def test_match_target_equals_its_sql_on_odd_names(spark, tmp_path, more):
    names = [n for n in NAMES + more for _ in range(2)]
    pq.write_table(pa.table({"p_partkey": range(len(names)), "p_name": names}), tmp_path / "part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = con.execute(ORACLE_SQL["match_target"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["match_target"](spark, str(tmp_path)).collect()) == sorted(want)


def test_a_label_may_lie_within_words(spark):
    asked = spark.createDataFrame([(1, "the unstringent one"), (2, "a c++ case"), (3, "ring of one"), (4, None)], "qid int, text string")
    labels = spark.createDataFrame([("Stringent o",), ("++",), ("one ring",)], "label string")
    assert {tuple(r) for r in R.match_target(asked, labels).collect()} == {(1, "Stringent o", "substring"), (2, "++", "substring"), (3, "one ring", "overlap")}

"""Ties among lines whose part numbers have more than five digits."""

from lattis.plans import catalog  # noqa: F401
from lattis.plans.registry import QUERIES

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"


def _lines(spark, folder, rows):
    spark.createDataFrame(rows, LINES).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_trust_gate_takes_the_first_line_of_equal_discount(spark, tmp_path):
    """Line 1 names part 150000, so packed into one number it would come after line 2."""
    rows = [(1, 150_000, 1, 1, 50.0, 0.1, 0.0), (1, 1, 1, 2, 10.0, 0.1, 0.02), (1, 2, 1, 3, 10.0, 0.0, 0.04)]
    r = QUERIES["trust_gate"](spark, _lines(spark, tmp_path, rows)).first()
    assert (r["n"], r["overridden"], r["helped"], r["hurt"]) == (1, 1, 0, 1)


def test_weight_sweep_takes_lines_of_equal_score_in_order(spark, tmp_path):
    rows = [(1, 150_000, 1, 1, 50.0, 0.1, 0.1), (1, 1, 1, 2, 10.0, 0.1, 0.1)]
    found = QUERIES["weight_sweep"](spark, _lines(spark, tmp_path, rows)).collect()
    assert {r["w"]: (r["recall"], r["mrr"]) for r in found} == {w: (1.0, 1.0) for w in (0.0, 0.5, 1.0)}

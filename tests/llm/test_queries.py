"""The queries of this subpackage that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from lattis.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_exact_dedup", "op13_weighted_lloyd"])
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{file}')")
    result = con.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in result.description)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    want = [dict(zip([d[0] for d in result.description], r)) for r in result.fetchall()]
    assert sorted(str([r[c] for c in columns]) for r in want) == sorted(str([r[c] for c in columns]) for r in df.collect())

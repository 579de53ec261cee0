"""Plans: what is read, what is pushed down, and what never appears."""

import pytest

from lattis.plans import catalog  # noqa: F401
from lattis.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = (
    "bands",
    "bcubed",
    "bh_fdr",
    "canonical_collisions",
    "dedup_keeper",
    "degree_stats",
    "dual_metric",
    "ece_brier",
    "edge_type_distribution",
    "edge_type_monoculture",
    "entity_lookup",
    "events_sessions",
    "flat_token_overlap",
    "idf_token_retrieval",
    "infer_room",
    "isolates_by_type",
    "k_curve",
    "latency_percentiles",
    "modularity",
    "multihop_by_depth",
    "normalize_predicate",
    "project_edges",
    "rank_metrics",
    "scaffold_projection",
    "spearman",
    "strategy_flips",
    "superseded_edges",
    "token_cost",
    "trust_gate",
    "weight_sweep",
)


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_product_of_tables(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert not any(x in text for x in ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "FlatMapGroupsInPandas"))


def test_scans_read_the_columns_they_need(spark):
    text = plan(QUERIES["latency_percentiles"](spark, SF))
    assert "ReadSchema: struct<event_type:string,value:double>" in text and "PushedFilters: [IsNotNull(value)]" in text
    assert "html" not in plan(QUERIES["connected_components"](spark, SF)).partition("ReadSchema")[2].partition("\n")[0]


def test_a_filter_reaches_the_scan(spark):
    assert "EqualTo(label,3)" in plan(spark.read.parquet(f"{SF}/embeddings.parquet").where("label = 3").select("vec_id"))
    from lattis.sources.graphs import trade

    text = plan(trade(spark, SF).edges.where("edge_type = 'part_of'"))
    assert "customer.parquet" not in text and "supplier.parquet" not in text


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["flat_token_overlap"](spark, SF))

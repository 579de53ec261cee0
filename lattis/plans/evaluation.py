"""Queries over retrieval runs and their statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattis.operators import ranks as R
from lattis.operators import stats as T
from lattis.operators.ordering import summed_in_order
from lattis.operators.retrieval import hashed_topk
from lattis.plans.registry import query
from lattis.sources import graphs as S

#: Runs of three conditions over the same questions, from the events table.
_runs_sql = """runs AS (SELECT c.condition, event_id AS qid, user_id % 3 + 1 AS min_hops, (floor(value * k)::BIGINT % 5) / 4 AS recall, floor(value * k)::BIGINT % 5 > 0 AS hit, floor(value * 10)::BIGINT + k AS tokens
    FROM events, (VALUES ('A', 1), ('B', 3), ('C', 7)) c(condition, k))"""


def _runs(spark, sf_dir):
    arms = F.explode(F.array(*(F.struct(F.lit(c).alias("condition"), F.lit(k).alias("k")) for c, k in (("A", 1), ("B", 3), ("C", 7)))))
    level = F.floor(F.col("value") * F.col("x.k")) % 5
    e = S.read(spark, sf_dir, "events").withColumn("x", arms)
    return e.select("x.condition", F.col("event_id").alias("qid"), (F.col("user_id") % 3 + 1).alias("min_hops"), (level / 4).alias("recall"), (level > 0).alias("hit"), (F.floor(F.col("value") * 10) + F.col("x.k")).alias("tokens"))


_agg = "count(*) AS n, round(avg(recall), 6) AS mean_recall, round(avg(hit::INT), 6) AS hit_rate, round(avg(tokens), 6) AS mean_tokens, count(*) FILTER (recall >= 1) AS correct, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(tokens) / nullif(count(*) FILTER (recall >= 1), 0), 6) AS tokens_per_correct"


@query("multihop_by_depth", f"WITH {_runs_sql} SELECT condition, min_hops, {_agg} FROM runs GROUP BY GROUPING SETS ((condition, min_hops), (condition))")
def multihop_by_depth(spark, sf_dir):
    return R.multihop(_runs(spark, sf_dir))


_deltas_sql = f"""{_runs_sql}, m AS (SELECT min_hops, avg(recall) FILTER (condition = 'A') AS a, avg(recall) FILTER (condition = 'B') AS b, avg(recall) FILTER (condition = 'C') AS c FROM runs GROUP BY 1),
    dl AS (SELECT min_hops, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(100 * (b - a), 6) AS b_minus_a, round(100 * (b - c), 6) AS b_minus_c, round(b / a, 6) AS ratio FROM m)"""


@query("abc_deltas", f"WITH {_deltas_sql} SELECT * FROM dl")
def abc_deltas(spark, sf_dir):
    return R.condition_deltas(_runs(spark, sf_dir))


@query(
    "abc_verdict",
    f"""WITH {_deltas_sql}, v AS (SELECT count(*) FILTER (b_minus_a > 0.05) AS wins_a, count(*) FILTER (b_minus_a < -0.05) AS losses_a, count(*) FILTER (b_minus_c > 0.05) AS wins_c, count(*) FILTER (b_minus_c < -0.05) AS losses_c,
    last(ratio ORDER BY min_hops) > 1.001 * first(ratio ORDER BY min_hops) AS grows FROM dl)
    SELECT *, CASE WHEN losses_a > 0 AND wins_a = 0 THEN 'structure hurts' WHEN wins_a > 0 AND losses_a > 0 THEN 'mixed' WHEN wins_a > 0 AND wins_c > 0 AND grows THEN 'structure helps, more with depth' WHEN wins_a > 0 AND wins_c > 0 THEN 'structure helps' WHEN wins_a > 0 THEN 'content helps, structure doesn''t' ELSE 'no difference' END AS verdict FROM v""",
)
def abc_verdict(spark, sf_dir):
    """Thresholds of 0.05 points, as the three conditions hardly differ here."""
    return R.verdict(R.condition_deltas(_runs(spark, sf_dir)), points=0.05, growth=1.001)


_firsts_sql = """firsts AS (SELECT s.strategy, event_id AS qid, CASE WHEN floor(value * k)::BIGINT % 13 < 10 THEN floor(value * k)::BIGINT % 13 + 1 END AS rank FROM events, (VALUES ('hybrid', 3), ('union', 5), ('vector', 2)) s(strategy, k))"""


def _firsts(spark, sf_dir):
    arms = F.explode(F.array(*(F.struct(F.lit(c).alias("strategy"), F.lit(k).alias("k")) for c, k in (("hybrid", 3), ("union", 5), ("vector", 2)))))
    r = F.floor(F.col("value") * F.col("x.k")) % 13
    return S.read(spark, sf_dir, "events").withColumn("x", arms).select("x.strategy", F.col("event_id").alias("qid"), F.when(r < 10, r + 1).alias("rank"))


@query("first_hits", "SELECT l_returnflag AS strategy, l_orderkey AS qid, min(l_linenumber) FILTER (l_quantity > 40) AS rank FROM lineitem GROUP BY 1, 2")
def first_hits(spark, sf_dir):
    li = S.read(spark, sf_dir, "lineitem")
    return R.first_hits(li.select(F.col("l_returnflag").alias("strategy"), F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("rank"), (F.col("l_quantity") > 40).alias("relevant")))


@query("rank_metrics", f"WITH {_firsts_sql} SELECT strategy, count(*) AS n, round(avg((coalesce(rank, 99) <= 5)::INT), 6) AS r_at_5, round(avg((coalesce(rank, 99) <= 10)::INT), 6) AS r_at_10, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM firsts GROUP BY 1")
def rank_metrics(spark, sf_dir):
    return R.rank_metrics(_firsts(spark, sf_dir))


@query("latency_nearest_rank", "WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[least(floor(0.95 * len(v))::INT, len(v) - 1) + 1] AS p FROM s")
def latency_nearest_rank(spark, sf_dir):
    return R.nearest_rank(S.read(spark, sf_dir, "events"), ["event_type"], "value", 0.95)


@query(
    "strategy_flips",
    f"""WITH {_firsts_sql} SELECT x.strategy AS a, y.strategy AS b, CASE WHEN x.rank IS NULL THEN 'new' WHEN y.rank IS NULL THEN 'lost' WHEN y.rank < x.rank THEN 'moved_up' WHEN y.rank > x.rank THEN 'moved_down' ELSE 'same' END AS flip, count(*) AS n
    FROM firsts x JOIN firsts y ON x.qid = y.qid AND x.strategy < y.strategy WHERE x.rank IS NOT NULL OR y.rank IS NOT NULL GROUP BY 1, 2, 3""",
)
def strategy_flips(spark, sf_dir):
    return R.strategy_flips(_firsts(spark, sf_dir))


_kc = "SELECT strategy, k, round(avg((coalesce(rank, 99) <= k)::INT), 6) AS recall, round(avg(CASE WHEN rank <= k THEN 1 / rank ELSE 0 END), 6) AS mrr FROM firsts, (VALUES {ks}) t(k) GROUP BY 1, 2"


@query("k_curve", f"WITH {_firsts_sql} " + _kc.format(ks="(1), (3), (5), (10)"))
def k_curve(spark, sf_dir):
    return R.k_curve(_firsts(spark, sf_dir))


@query("topk_cliff", f"WITH {_firsts_sql} " + _kc.format(ks="(1), (2), (4), (8), (16)"))
def topk_cliff(spark, sf_dir):
    return R.k_curve(_firsts(spark, sf_dir), (1, 2, 4, 8, 16))


@query(
    "router_cross_table",
    f"""WITH {_firsts_sql}, p AS (SELECT coalesce(x.rank = 1, false) AS a, coalesce(y.rank = 1, false) AS b FROM firsts x JOIN firsts y ON x.qid = y.qid AND x.strategy = 'hybrid' AND y.strategy = 'vector')
    SELECT count(*) AS n, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither,
           round(count(*) FILTER (a OR b) / count(*), 6) AS router, round(count(*) FILTER (NOT a AND b) / count(*), 6) AS lift_a, round(count(*) FILTER (a AND NOT b) / count(*), 6) AS lift_b FROM p""",
)
def router_cross_table(spark, sf_dir):
    return R.router_table(_firsts(spark, sf_dir), "hybrid", "vector")


_cand_sql = "cand AS (SELECT l_orderkey AS qid, (l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS id, l_discount AS a, CASE WHEN l_linenumber % 5 <> 0 THEN l_tax END AS b, l_quantity > 40 AS relevant FROM lineitem)"


def _line_id():
    """A line's number, part, supplier and quantity in one number: the first alone may repeat in an order."""
    return (F.col("l_linenumber") * F.lit(10_000_000_000) + F.col("l_partkey") * 100_000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")


def _line_order():
    """A line's place among those of equal score: :func:`_line_id` is in this order only while a part's number has five digits."""
    return F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("line")


def _candidates(spark, sf_dir):
    li = S.read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("qid"), _line_id().alias("id"), F.col("l_discount").alias("a"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_tax")).alias("b"), (F.col("l_quantity") > 40).alias("relevant"))


_order = "SELECT '{s}' AS strategy, qid, min(r) FILTER (relevant) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {s} DESC NULLS LAST, id) AS r FROM cand) GROUP BY 2 HAVING count(*) FILTER (relevant) > 0"


@query("rerank_ab", f"WITH {_cand_sql}, o AS ({_order.format(s='a')} UNION ALL {_order.format(s='b')}) SELECT strategy, count(*) AS n, round(avg((rank <= 1)::INT), 6) AS r_at_1, round(avg((rank <= 5)::INT), 6) AS r_at_5, round(avg(1 / rank), 6) AS mrr FROM o GROUP BY 1")
def rerank_ab(spark, sf_dir):
    return R.rank_metrics(R.reorder(_candidates(spark, sf_dir), ["a", "b"]), (1, 5))


@query("pooled_ab", f"WITH {_cand_sql}, o AS ({_order.format(s='a')} UNION ALL {_order.format(s='b')}) SELECT * FROM o")
def pooled_ab(spark, sf_dir):
    return R.reorder(_candidates(spark, sf_dir), ["a", "b"]).withColumn("rank", F.col("rank").cast("long"))


@query(
    "weight_sweep",
    """WITH s AS (SELECT w, l_orderkey AS qid, l_quantity > 40 AS relevant, row_number() OVER (PARTITION BY w, l_orderkey ORDER BY round(w * l_discount + (1 - w) * l_tax, 9) DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem, (VALUES (0.0::DOUBLE), (0.5), (1.0)) g(w)),
    f AS (SELECT w, qid, min(r) FILTER (relevant) AS rank FROM s GROUP BY 1, 2)
    SELECT w, round(avg((coalesce(rank, 99) <= 2)::INT), 6) AS recall, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM f GROUP BY 1""",
)
def weight_sweep(spark, sf_dir):
    li = S.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), _line_order(), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), (F.col("l_quantity") > 40).alias("relevant"))
    return R.weight_sweep(li, (0.0, 0.5, 1.0), k=2, ties="line")


@query(
    "trust_gate",
    """WITH c AS (SELECT l_orderkey AS qid, first(struct_pack(id := (l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT), rel := l_quantity > 40, s := l_tax) ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS x, first(struct_pack(id := (l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT), rel := l_quantity > 40, s := l_tax) ORDER BY l_tax DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS y FROM lineitem GROUP BY 1),
    o AS (SELECT *, x.id <> y.id AND y.s - x.s >= 0.035 AS ov FROM c)
    SELECT count(*) AS n, count(*) FILTER (ov) AS overridden, count(*) FILTER (ov AND y.rel AND NOT x.rel) AS helped, count(*) FILTER (ov AND NOT y.rel AND x.rel) AS hurt FROM o""",
)
def trust_gate(spark, sf_dir):
    li = S.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), _line_id().alias("id"), _line_order(), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), (F.col("l_quantity") > 40).alias("relevant"))
    return R.trust_gate(li, 0.035, "line")


@query("ab_ranking", f"WITH {_firsts_sql} SELECT strategy, count(*) AS n, count(rank) AS found, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(quantile_cont(rank, 0.5), 6) AS median_rank FROM firsts GROUP BY 1")
def ab_ranking(spark, sf_dir):
    f = _firsts(spark, sf_dir)
    return f.groupBy("strategy").agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.percentile("rank", F.lit(0.5)), 6).alias("median_rank"))


@query("hit_at_k", f"WITH {_firsts_sql} SELECT strategy, qid, coalesce(rank <= 1, false) AS hit_1, coalesce(rank <= 5, false) AS hit_5, coalesce(rank <= 10, false) AS hit_10 FROM firsts")
def hit_at_k(spark, sf_dir):
    return _firsts(spark, sf_dir).select("strategy", "qid", *(F.coalesce(F.col("rank") <= k, F.lit(False)).alias(f"hit_{k}") for k in (1, 5, 10)))


@query("r1_misses", f"WITH {_firsts_sql} SELECT strategy, rank, count(*) AS n FROM firsts WHERE coalesce(rank, 99) > 1 GROUP BY 1, 2")
def r1_misses(spark, sf_dir):
    return _firsts(spark, sf_dir).where("coalesce(rank, 99) > 1").groupBy("strategy", "rank").agg(F.count("*").alias("n"))


@query("chunk_rollup", r"""WITH h AS (SELECT conv_id AS qid, 'chunk:s' || conv_id % 7 || '_' || turn % 3 || '_chunk_' || turn AS id, turn + 1 AS rank FROM conversations) SELECT qid, regexp_replace(regexp_replace(id, '^chunk:', ''), '_chunk_\d+$', '') AS parent, min(rank) AS rank FROM h GROUP BY 1, 2""")
def chunk_rollup(spark, sf_dir):
    c = S.read(spark, sf_dir, "conversations")
    text = lambda x: x.cast("string")
    key = F.concat(F.lit("chunk:s"), text(F.col("conv_id") % 7), F.lit("_"), text(F.col("turn") % 3), F.lit("_chunk_"), text(F.col("turn")))
    return R.chunk_rollup(c.select(F.col("conv_id").alias("qid"), key.alias("id"), (F.col("turn") + 1).alias("rank")))


@query(
    "entity_overlap",
    """WITH r AS (SELECT conv_id AS qid, list(role || ':' || turn) FILTER (turn > 0) AS retrieved, CASE WHEN conv_id % 9 = 0 THEN [] ELSE ['user', 'tem:0'] END AS expected FROM conversations GROUP BY 1)
    SELECT qid, round(CASE WHEN len(expected) = 0 THEN NULL WHEN coalesce(len(retrieved), 0) = 0 THEN 0 ELSE len(list_filter(retrieved, lambda x: len(list_filter(expected, lambda e: contains(x, e))) > 0)) / len(retrieved) END, 6) AS precision FROM r""",
)
def entity_overlap(spark, sf_dir):
    c = S.read(spark, sf_dir, "conversations")
    held = F.filter(F.collect_list(F.when(F.col("turn") > 0, F.concat("role", F.lit(":"), F.col("turn").cast("string")))), lambda x: x.isNotNull())
    rows = c.groupBy(F.col("conv_id").alias("qid")).agg(held.alias("retrieved"))
    none = F.array().cast("array<string>")
    return R.entity_overlap(rows.withColumn("expected", F.when(F.col("qid") % 9 == 0, none).otherwise(F.array(F.lit("user"), F.lit("tem:0")))))


@query(
    "token_utilization",
    r"""WITH x AS (SELECT conv_id * 100 + turn AS qid, text AS answer, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), CASE WHEN conv_id % 2 = 0 THEN text ELSE '' END) AS context FROM conversations),
    n AS (SELECT *, len(list_filter(regexp_split_to_array(trim(answer), '\s+'), lambda t: t <> '')) AS a, len(list_filter(regexp_split_to_array(trim(context), '\s+'), lambda t: t <> '')) AS c FROM x)
    SELECT qid, round(CASE WHEN c = 0 OR trim(answer) = trim(context) THEN NULL ELSE least(a, c) / c END, 6) AS utilization FROM n""",
)
def token_utilization(spark, sf_dir):
    c = S.read(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return R.token_utilization(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), F.col("text").alias("answer"), F.coalesce(before, F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise("")).alias("context")))


_pv = "SELECT user_id % 4 AS arm, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view FROM events GROUP BY 1"


@query("probe_pivot", f"WITH p AS ({_pv}), b AS (SELECT * FROM p WHERE arm = 0) SELECT p.arm, p.click, p.view, round(p.click - b.click, 6) AS delta_click, round(p.view - b.view, 6) AS delta_view FROM p, b")
def probe_pivot(spark, sf_dir):
    e = S.read(spark, sf_dir, "events").withColumn("arm", F.col("user_id") % 4)
    return R.pivot_deltas(e, "arm", "event_type", "value", ["click", "view"], 0)


@query("ablation_deltas", f"WITH {_firsts_sql}, p AS (SELECT strategy, round(avg(coalesce(1 / rank, 0)) FILTER (qid % 2 = 0), 6) AS even, round(avg(coalesce(1 / rank, 0)) FILTER (qid % 2 = 1), 6) AS odd FROM firsts GROUP BY 1), b AS (SELECT * FROM p WHERE strategy = 'vector') SELECT p.*, round(p.even - b.even, 6) AS delta_even, round(p.odd - b.odd, 6) AS delta_odd FROM p, b")
def ablation_deltas(spark, sf_dir):
    f = _firsts(spark, sf_dir).select("strategy", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd").alias("half"), F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("rr"))
    return R.pivot_deltas(f, "strategy", "half", "rr", ["even", "odd"], "vector")


@query("tokens_at_budget", "WITH h AS (SELECT conv_id AS qid, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations) SELECT qid, count(*) AS kept, CAST(max(total) AS BIGINT) AS tokens FROM h WHERE total <= 200 GROUP BY 1")
def tokens_at_budget(spark, sf_dir):
    c = S.read(spark, sf_dir, "conversations")
    return R.tokens_at_budget(c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), F.floor(F.length("text") / 4).alias("tokens")), 200)


@query("recall_at_k", f"WITH {_firsts_sql} SELECT strategy, qid % 3 + 1 AS hops, round(avg((coalesce(rank, 99) <= 5)::INT), 6) AS recall, count(*) AS n FROM firsts GROUP BY 1, 2")
def recall_at_k(spark, sf_dir):
    f = _firsts(spark, sf_dir)
    return f.groupBy("strategy", (F.col("qid") % 3 + 1).alias("hops")).agg(F.round(F.avg((F.coalesce("rank", F.lit(99)) <= 5).cast("double")), 6).alias("recall"), F.count("*").alias("n"))


@query("random_floor", "SELECT item_id AS qid, doc_id AS id FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY md5(item_id || '|' || doc_id), doc_id) AS r FROM benchmark, documents) WHERE r <= 3")
def random_floor(spark, sf_dir):
    """Three documents an item by hash order (RET31); the stated items against all documents."""
    q, d = S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")), S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return hashed_topk(q, d, 3)


@query("oracle_ceiling", f"WITH {_firsts_sql} SELECT qid, max(strategy) AS any_strategy, CAST(1 AS DOUBLE) AS recall FROM firsts WHERE rank IS NOT NULL GROUP BY 1")
def oracle_ceiling(spark, sf_dir):
    return _firsts(spark, sf_dir).where("rank is not null").groupBy("qid").agg(F.max("strategy").alias("any_strategy"), F.lit(1.0).alias("recall"))


@query("waypoints", "SELECT c_custkey AS qid, first(n_name ORDER BY length(n_name), n_name) AS waypoint FROM customer JOIN nation ON contains(c_name || ' ' || c_nationkey, CAST(n_nationkey AS VARCHAR)) GROUP BY 1")
def waypoints(spark, sf_dir):
    """The shortest name whose key is within the source string (RET33)."""
    c, n = S.read(spark, sf_dir, "customer"), S.read(spark, sf_dir, "nation")
    text = F.concat_ws(" ", "c_name", F.col("c_nationkey").cast("string"))
    hit = c.select(F.col("c_custkey").alias("qid"), text.alias("t")).join(F.broadcast(n), F.contains("t", F.col("n_nationkey").cast("string")))
    return hit.groupBy("qid").agg(F.min_by("n_name", F.struct(F.length("n_name"), F.col("n_name"))).alias("waypoint"))


# ---------------------------------------------------------------- statistics


def _arm(spark, sf_dir, c):
    return _runs(spark, sf_dir).where(F.col("condition") == c).select("qid", F.when(F.col("qid") % 11 != 0, F.col("recall")).alias("score") if c == "A" else F.col("recall").alias("score"))


_pair_sql = f"{_runs_sql}, pr AS (SELECT x.qid, x.recall AS b, y.recall AS a, x.recall - y.recall AS diff FROM runs x JOIN runs y ON x.qid = y.qid AND x.condition = 'B' AND y.condition = 'A' WHERE y.qid % 11 <> 0)"


@query("paired_scores", f"WITH {_pair_sql} SELECT qid, b AS a, a AS b, diff FROM pr")
def paired_scores(spark, sf_dir):
    return T.paired(_arm(spark, sf_dir, "B"), _arm(spark, sf_dir, "A"))


@query("paired_positional", "WITH a AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, o_orderpriority AS key_a, o_totalprice AS a FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, o_orderpriority AS key_b, o_totalprice AS b FROM orders WHERE o_orderstatus = 'F') SELECT CAST(i AS BIGINT) AS i, key_a, a, key_b, b, key_a = key_b AS agree FROM a JOIN b USING (i)")
def paired_positional(spark, sf_dir):
    o = S.read(spark, sf_dir, "orders")
    return T.paired_by_position(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), ["o_orderdate", "o_orderkey"], "o_orderpriority", "o_totalprice")


@query("paired_bootstrap_point", f"WITH {_pair_sql} SELECT qid % 3 AS hops, count(*) AS n, round(avg(diff), 6) AS mean FROM pr GROUP BY 1")
def paired_bootstrap_point(spark, sf_dir):
    """The point estimates of :func:`paired_bootstrap`, whose intervals are pinned by unit tests."""
    d = T.paired(_arm(spark, sf_dir, "B"), _arm(spark, sf_dir, "A")).select((F.col("qid") % 3).alias("hops"), F.col("qid").alias("ord"), "diff")
    return T.paired_bootstrap(d, ["hops"], resamples=200).select("hops", "n", F.round("mean", 6).alias("mean"))


@query("poisson_bootstrap")
def poisson_bootstrap(spark, sf_dir):
    d = T.paired(_arm(spark, sf_dir, "B"), _arm(spark, sf_dir, "A")).select((F.col("qid") % 3).alias("hops"), "qid", "diff")
    return T.poisson_bootstrap(d, ["hops"], "qid", resamples=100)


@query(
    "bh_fdr",
    """WITH t AS (SELECT user_id AS id, round(1 / (1 + sum(value) % 50), 9) AS p FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM t)
    SELECT id, p, round(least(1, min(p * m / k) OVER (ORDER BY k DESC)), 9) AS p_adjusted, least(1, min(p * m / k) OVER (ORDER BY k DESC)) <= 0.05 AS rejected FROM r""",
)
def bh_fdr(spark, sf_dir):
    """Values are added up as they stand in the file, since the remainder jumps where the last bit of a sum does."""
    e = S.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "value", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    sums = summed_in_order(e, "id", "value", "at", "total")
    return T.benjamini_hochberg(sums.select("id", F.round(1 / (1 + F.col("total") % 50), 9).alias("p")))


_binom = "CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END"


@query("mcnemar", f"WITH {_firsts_sql}, p AS (SELECT coalesce(x.rank = 1, false) AS a, coalesce(y.rank = 1, false) AS b FROM firsts x JOIN firsts y ON x.qid = y.qid AND x.strategy = 'hybrid' AND y.strategy = 'vector'), t AS (SELECT count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (NOT a AND b) AS c FROM p) SELECT b, c, round({_binom}, 9) AS p FROM t")
def mcnemar(spark, sf_dir):
    """Over all questions."""
    f = _firsts(spark, sf_dir)
    one = lambda s, n: f.where(F.col("strategy") == s).select("qid", F.coalesce(F.col("rank") == 1, F.lit(False)).alias(n))
    return T.mcnemar(one("hybrid", "a").join(one("vector", "b"), "qid"))


@query("sign_test", f"WITH {_pair_sql}, t AS (SELECT count(*) FILTER (diff > 0) AS b, count(*) FILTER (diff < 0) AS c FROM pr) SELECT b AS positive, c AS negative, round({_binom}, 9) AS p FROM t")
def sign_test(spark, sf_dir):
    return T.sign_test(T.paired(_arm(spark, sf_dir, "B"), _arm(spark, sf_dir, "A")))


@query("rrf_gate", f"WITH {_firsts_sql}, p AS (SELECT coalesce(1 / x.rank, 0) - coalesce(1 / y.rank, 0) AS d, coalesce(x.rank = 1, false) AS a, coalesce(y.rank = 1, false) AS b FROM firsts x JOIN firsts y ON x.qid = y.qid AND x.strategy = 'union' AND y.strategy = 'vector') SELECT count(*) AS n, round(avg(d), 6) AS delta_mrr, count(*) FILTER (a AND NOT b) AS gained, count(*) FILTER (NOT a AND b) AS lost, CASE WHEN avg(d) > 0 THEN 'ship' ELSE 'hold' END AS verdict FROM p")
def rrf_gate(spark, sf_dir):
    f = _firsts(spark, sf_dir)
    one = lambda s, n: f.where(F.col("strategy") == s).select("qid", F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias(n))
    p = one("union", "a").join(one("vector", "b"), "qid")
    d = F.avg(F.col("a") - F.col("b"))
    return p.agg(F.count("*").alias("n"), F.round(d, 6).alias("delta_mrr"), F.count_if((F.col("a") == 1) & (F.col("b") < 1)).alias("gained"), F.count_if((F.col("a") < 1) & (F.col("b") == 1)).alias("lost"), F.when(d > 0, "ship").otherwise("hold").alias("verdict"))


@query("headline_deltas", f"WITH {_pair_sql}, h AS (SELECT qid % 3 AS family, count(*) AS n, round(avg(b), 6) AS mean_b, round(avg(a), 6) AS mean_a, round(avg(diff), 6) AS delta, count(*) FILTER (diff <> 0) AS discordant FROM pr GROUP BY 1) SELECT *, discordant = 0 AS definitional_null, discordant < 30 AS fragile FROM h")
def headline_deltas(spark, sf_dir):
    p = T.paired(_arm(spark, sf_dir, "B"), _arm(spark, sf_dir, "A"))
    h = p.groupBy((F.col("qid") % 3).alias("family")).agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_b"), F.round(F.avg("b"), 6).alias("mean_a"), F.round(F.avg("diff"), 6).alias("delta"), F.count_if(F.col("diff") != 0).alias("discordant"))
    return h.withColumn("definitional_null", F.col("discordant") == 0).withColumn("fragile", F.col("discordant") < 30)


@query("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS y FROM part) SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r")
def spearman(spark, sf_dir):
    return T.spearman(S.read(spark, sf_dir, "part"), "p_size", "p_retailprice")


@query(
    "isotonic_fit",
    """WITH g AS (SELECT CAST(p_size AS DOUBLE) AS x, count(*) AS n, avg((p_retailprice > 1000 + p_size * 2)::INT) AS m FROM part GROUP BY 1),
    b AS (SELECT i.x AS i, j.x AS j, sum(g.n * g.m) / sum(g.n) AS mean FROM g i JOIN g j ON i.x <= j.x JOIN g ON g.x BETWEEN i.x AND j.x GROUP BY 1, 2),
    lo AS (SELECT k.x, b.i, min(b.mean) AS lo FROM g k JOIN b ON b.i <= k.x AND b.j >= k.x GROUP BY 1, 2)
    SELECT x, n, round(max(lo), 9) AS fitted FROM lo JOIN g USING (x) GROUP BY 1, 2""",
)
def isotonic_fit(spark, sf_dir):
    p = S.read(spark, sf_dir, "part")
    return T.isotonic(p.select(F.col("p_size").alias("score"), (F.col("p_retailprice") > 1000 + F.col("p_size") * 2).cast("int").alias("y")))


@query("ece_brier", "WITH r AS (SELECT least(l_discount * 10, 1.0) AS p, (l_quantity > 30)::INT AS y FROM lineitem), b AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a, sum(pow(p - y, 2)) AS sq FROM r GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(sq) / sum(n), 6) AS brier, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b")
def ece_brier(spark, sf_dir):
    li = S.read(spark, sf_dir, "lineitem")
    return T.calibration_error(li.select(F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("p"), (F.col("l_quantity") > 30).cast("int").alias("y")))


@query("latency_percentiles", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p999, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return T.latency_percentiles(S.read(spark, sf_dir, "events"), ["event_type"], "value")


_judged_sql = """judged AS (SELECT event_id AS qid, event_type AS category, (floor(value)::BIGINT % 5) / 4 AS recall, CASE event_id % 8 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'CORRECT' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'INCORRECT' WHEN 4 THEN 'ABSTAIN' WHEN 5 THEN 'ERROR' WHEN 6 THEN 'odd' END AS label, user_id % 2 = 0 AS is_abstention FROM events)"""


def _judged(spark, sf_dir):
    e = S.read(spark, sf_dir, "events")
    label = F.get(F.array(*(F.lit(x) for x in ("CORRECT", "CORRECT", "PARTIAL", "INCORRECT", "ABSTAIN", "ERROR", "odd", None))), F.col("event_id") % 8)
    return e.select(F.col("event_id").alias("qid"), F.col("event_type").alias("category"), (F.floor("value") % 5 / 4).alias("recall"), label.alias("label"), (F.col("user_id") % 2 == 0).alias("is_abstention"))


@query(
    "dual_metric",
    f"""WITH {_judged_sql}, l AS (SELECT category, recall, CASE WHEN label IS NULL THEN NULL WHEN label = 'odd' THEN 'ERROR' ELSE label END AS label FROM judged),
    a AS (SELECT category, count(*) AS n, count(*) FILTER (label <> 'ERROR') AS judged, round(avg(recall), 6) AS recall, count(*) FILTER (label IN ('CORRECT', 'ABSTAIN')) AS ok, count(*) FILTER (label = 'ERROR') AS errors FROM l GROUP BY ROLLUP (category))
    SELECT category, n, judged, recall, round(ok / nullif(judged, 0), 6) AS accuracy, round(recall - round(ok / nullif(judged, 0), 6), 6) AS gap, errors FROM a""",
)
def dual_metric(spark, sf_dir):
    return T.dual_metric(_judged(spark, sf_dir))


@query("label_accuracy", f"WITH {_judged_sql} SELECT category, count(*) AS n, count(*) FILTER (label = 'CORRECT' OR (label = 'ABSTAIN' AND is_abstention)) AS right, round(count(*) FILTER (label = 'CORRECT' OR (label = 'ABSTAIN' AND is_abstention)) / count(*), 6) AS accuracy FROM judged GROUP BY 1".replace(" AS right", ' AS "right"'))
def label_accuracy(spark, sf_dir):
    return T.label_accuracy(_judged(spark, sf_dir))


@query("disagreements", f"WITH {_judged_sql} SELECT qid, recall, label FROM judged WHERE (recall >= 0.5) <> (label = 'CORRECT')")
def disagreements(spark, sf_dir):
    return T.disagreements(_judged(spark, sf_dir)).select("qid", "recall", "label")


@query(
    "judge_majority",
    f"""WITH {_judged_sql}, v AS (SELECT qid // 5 AS q, qid AS rep, label FROM judged WHERE label <> 'ERROR'), c AS (SELECT q, label, count(*) AS k, min(rep) AS f FROM v GROUP BY 1, 2)
    SELECT q AS qid, first(label ORDER BY k DESC, f) AS label, CAST(sum(k) AS BIGINT) AS votes, round(max(k) / sum(k), 6) AS agreement FROM c GROUP BY 1""",
)
def judge_majority(spark, sf_dir):
    return T.judge_majority(_judged(spark, sf_dir).select(F.floor(F.col("qid") / 5).alias("qid"), F.col("qid").alias("replicate"), "label"))


@query("judge_parse", r"""WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Yes, it does. {"label": "CORRECT", "score": ' || user_id % 5 || '}' WHEN 1 THEN '```json {"label": "PARTIAL", "score": 2} ```' ELSE 'no' END AS reply FROM events) SELECT event_id, contains(lower(reply), 'yes') AS yes, nullif(regexp_extract(reply, '"label": "([A-Z]+)"', 1), '') AS label, TRY_CAST(nullif(regexp_extract(reply, '"score": (\d+)', 1), '') AS BIGINT) AS score FROM r""")
def judge_parse(spark, sf_dir):
    """Yes/no, and the object between the first and the last brace (STA17)."""
    k = F.col("event_id") % 3
    reply = F.when(k == 0, F.concat(F.lit('Yes, it does. {"label": "CORRECT", "score": '), (F.col("user_id") % 5).cast("string"), F.lit("}"))).when(k == 1, F.lit('```json {"label": "PARTIAL", "score": 2} ```')).otherwise("no")
    body = F.try_parse_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0))
    e = S.read(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return e.select("event_id", F.contains(F.lower("reply"), F.lit("yes")).alias("yes"), F.try_variant_get(body, "$.label", "string").alias("label"), F.try_variant_get(body, "$.score", "bigint").alias("score"))


@query("faithfulness", "SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE round(count(*) FILTER (role = 'assistant') / count(*), 6) END AS faithfulness FROM conversations GROUP BY 1")
def faithfulness(spark, sf_dir):
    """Supported claims over claims; null where the judge failed (STA18)."""
    claims = S.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("claims"))
    share = F.size(F.filter("claims", lambda c: c == "assistant")) / F.size("claims")
    return claims.select("conv_id", F.round(F.when(F.col("conv_id") % 7 == 0, None).when(F.size("claims") == 0, 0.0).otherwise(share), 6).alias("faithfulness"))


@query(
    "token_cost",
    """WITH pr AS (SELECT * FROM (VALUES ('click', 3.0::DOUBLE, 15.0::DOUBLE), ('view', 0.25, 1.25), ('error', 1.0, 5.0)) t(model, i, o)), r AS (SELECT event_type AS model, sum(user_id * i / 1e6 + event_id % 100 * o / 1e6) AS c, count(*) AS n, count(*) FILTER (value > 20) AS k FROM events JOIN pr ON model = event_type GROUP BY 1)
    SELECT model, n AS queries, k AS correct, round(c, 6) AS cost, round(c / n, 6) AS per_query, round(c / nullif(k, 0), 6) AS per_correct FROM r""",
)
def token_cost(spark, sf_dir):
    prices = spark.createDataFrame([("click", 3.0, 15.0), ("view", 0.25, 1.25), ("error", 1.0, 5.0)], "model string, input_per_1m double, output_per_1m double")
    e = S.read(spark, sf_dir, "events")
    return T.token_cost(e.select(F.col("event_type").alias("model"), F.col("user_id").alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"), (F.col("value") > 20).alias("correct")), prices)


@query("stratified_cap", "WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) SELECT event_id, event_type FROM r ORDER BY k, event_type NULLS LAST LIMIT 103")
def stratified_cap(spark, sf_dir):
    return T.stratified_cap(S.read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 103)


@query("stratified_sample", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) AS k FROM events) WHERE k <= 20")
def stratified_sample(spark, sf_dir):
    return T.stratified_sample(S.read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 20)


@query("failure_taxonomy", "SELECT event_id, CASE WHEN value IS NULL THEN 'no answer' WHEN event_type = 'error' THEN 'error' WHEN value < 5 THEN 'low' WHEN user_id % 2 = 0 AND value < 20 THEN 'partial' ELSE 'other' END AS failure FROM events")
def failure_taxonomy(spark, sf_dir):
    """Causes in order of priority (STA23)."""
    v = F.col("value")
    cause = F.when(v.isNull(), "no answer").when(F.col("event_type") == "error", "error").when(v < 5, "low").when((F.col("user_id") % 2 == 0) & (v < 20), "partial").otherwise("other")
    return S.read(spark, sf_dir, "events").select("event_id", cause.alias("failure"))


@query("nightly_drift", "WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS reading FROM events GROUP BY 1) SELECT day, reading, round(reading - lag(reading) OVER (ORDER BY day), 6) AS delta FROM d")
def nightly_drift(spark, sf_dir):
    d = S.read(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.avg("value"), 6).alias("reading"))
    return T.drift(d, "day", "reading")


@query("sweep_matrix", "WITH m AS (SELECT event_type, user_id % 4 AS arm, round(avg(value), 6) AS score, count(*) AS calls FROM events GROUP BY 1, 2) SELECT event_type, arm, score, calls, score = max(score) OVER () AS best FROM m")
def sweep_matrix(spark, sf_dir):
    """Every configuration, its calls and which is best (STA15)."""
    m = S.read(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 4).alias("arm")).agg(F.round(F.avg("value"), 6).alias("score"), F.count("*").alias("calls"))
    return m.crossJoin(m.agg(F.max("score").alias("top"))).select("event_type", "arm", "score", "calls", (F.col("score") == F.col("top")).alias("best"))


@query("system_matrix", "SELECT event_type AS system, count(*) AS n, round(avg((value > 20)::INT), 6) AS r_at_1, round(avg((value > 10)::INT), 6) AS r_at_5, count(*) FILTER (value IS NULL) AS errors FROM events GROUP BY 1")
def system_matrix(spark, sf_dir):
    e = S.read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("system")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 20).cast("int")), 6).alias("r_at_1"), F.round(F.avg((F.col("value") > 10).cast("int")), 6).alias("r_at_5"), F.count_if(F.col("value").isNull()).alias("errors"))


@query("cost_estimate", "SELECT conv_id % 10 AS vault, count(*) AS turns, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, round(sum(length(text) // 4) * 2.5 / 1e6 + count(*) * 300 * 10 / 1e6, 6) AS cost FROM conversations GROUP BY 1")
def cost_estimate(spark, sf_dir):
    tokens = F.sum(F.floor(F.length("text") / 4))
    c = S.read(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 10).alias("vault"))
    return c.agg(F.count("*").alias("turns"), tokens.alias("tokens"), F.round(tokens * 2.5 / 1e6 + F.count("*") * 300 * 10 / 1e6, 6).alias("cost"))


@query(
    "apply_resolution",
    """WITH m AS (SELECT o_orderpriority AS note, 'c' || o_custkey % 20 AS id, o_orderstatus || repeat('x', CAST(o_orderkey % 9 AS INT)) AS description FROM orders), r AS (SELECT DISTINCT id AS member, 'c' || CAST(id[2:] AS INT) // 2 AS canonical FROM m)
    SELECT note, canonical AS id, first(description ORDER BY length(description) DESC, description DESC) AS description FROM m JOIN r ON member = id GROUP BY 1, 2""",
)
def apply_resolution(spark, sf_dir):
    o = S.read(spark, sf_dir, "orders")
    m = o.select(F.col("o_orderpriority").alias("note"), F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string")).alias("id"), F.concat("o_orderstatus", F.repeat(F.lit("x"), (F.col("o_orderkey") % 9).cast("int"))).alias("description"))
    n = F.regexp_extract("id", r"(\d+)", 1).cast("int")
    r = m.select("id").distinct().select(F.col("id").alias("member"), F.concat(F.lit("c"), F.floor(n / 2).cast("string")).alias("canonical"), F.lit(2).alias("seq"))
    old = r.select("member", F.lit("stale").alias("canonical"), F.lit(1).alias("seq"))
    return T.apply_resolution(m, r.unionByName(old))


@query("call_through", "SELECT event_type AS kind, count(*) AS probes, count(*) FILTER (value > 5) AS passed, round(count(*) FILTER (value > 5) / count(*), 6) AS rate, CASE WHEN count(*) FILTER (value > 5) / count(*) >= 1 THEN 'healthy' WHEN count(*) FILTER (value > 5) / count(*) >= 0.8 THEN 'warning' ELSE 'concerning' END AS band FROM events GROUP BY 1")
def call_through(spark, sf_dir):
    """Probes that passed, by kind of surface (H9b)."""
    from lattis.operators.integrity import band

    p = S.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("probes"), F.count_if(F.col("value") > 5).alias("passed"))
    rate = F.col("passed") / F.col("probes")
    return p.select("kind", "probes", "passed", F.round(rate, 6).alias("rate"), band(rate, 1.0, 0.8, False).alias("band"))


@query("invocation_rate", "SELECT user_id % 3 + 1 AS min_hops, count(*) AS questions, count(*) FILTER (event_type <> 'view') AS invoked, round(count(*) FILTER (event_type <> 'view') / count(*), 6) AS rate, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def invocation_rate(spark, sf_dir):
    """Questions in which the tool was called; errors stay in the denominator (H9a)."""
    e = S.read(spark, sf_dir, "events").groupBy((F.col("user_id") % 3 + 1).alias("min_hops"))
    called = F.count_if(F.col("event_type") != "view")
    return e.agg(F.count("*").alias("questions"), called.alias("invoked"), F.round(called / F.count("*"), 6).alias("rate"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("mock_runner", "SELECT event_id AS qid, user_id % 3 + 1 >= 2 AS invoked, CASE WHEN user_id % 3 + 1 >= 2 THEN 2 ELSE 1 END AS turns FROM events")
def mock_runner(spark, sf_dir):
    """A stub that calls the tool from two hops on (H9c)."""
    calls = F.col("user_id") % 3 + 1 >= 2
    return S.read(spark, sf_dir, "events").select(F.col("event_id").alias("qid"), calls.alias("invoked"), F.when(calls, 2).otherwise(1).alias("turns"))


@query("hop_reachability", "SELECT conv_id, max(turn) AS needed, max(turn) <= 2 OR max(turn) IS NULL AS within_two FROM conversations GROUP BY 1")
def hop_reachability(spark, sf_dir):
    """Whether a conversation's last turn is within two `follows` hops of its first (an extension)."""
    c = S.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("needed"))
    return c.select("conv_id", "needed", (F.col("needed") <= 2).alias("within_two"))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    """Means, intervals and probabilities by depth, of 10,000 resamples; their stream is pinned by unit tests."""
    d = T.paired(_arm(spark, sf_dir, "B"), _arm(spark, sf_dir, "A")).select((F.col("qid") % 3).alias("hops"), F.col("qid").alias("ord"), "diff")
    return T.paired_bootstrap(d, ["hops"])


@query("calibration_cv")
def calibration_cv(spark, sf_dir):
    """Cross-validated calibration of discounts as scores (folds are hashed)."""
    li = S.read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_discount").alias("score"), (F.col("l_quantity") > 30).cast("int").alias("y"))
    return T.cross_validated_calibration(li, "l_orderkey")


@query("model_replies", "SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL WHEN length(text) % 2 = 0 THEN 'yes' ELSE 'no' END AS reply, length(text) % 2 = 0 AS yes FROM conversations")
def model_replies(spark, sf_dir):
    """An injected model's replies, judged (STA26)."""
    from lattis.functions import models

    reply = models.complete(F.col("text"), lambda prompts: ["yes" if len(p) % 2 == 0 else "no" for p in prompts])
    return S.read(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("reply")).withColumn("yes", models.verdict_yes(F.col("reply")))

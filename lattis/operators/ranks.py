"""Retrieval runs: recall by hops, rank metrics, strategy comparisons, reranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column, default: float | None = 0.0) -> Column:
    """part / whole as a double rounded to 6; ``default`` if whole is 0."""
    x = F.try_divide(part.cast("double"), whole)
    return F.round(x if default is None else F.coalesce(x, F.lit(default)), 6)


def multihop(runs: DataFrame) -> DataFrame:
    """``(condition, min_hops, n, mean_recall, hit_rate, mean_tokens, correct, tokens_per_correct)`` (RET12).

    One row a depth and one, with null ``min_hops``, for all depths.
    """
    agg = runs.groupingSets([[F.col("condition"), F.col("min_hops")], [F.col("condition")]], "condition", "min_hops").agg(
        F.count("*").alias("n"),
        F.round(F.avg("recall"), 6).alias("mean_recall"),
        F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"),
        F.round(F.avg("tokens"), 6).alias("mean_tokens"),
        F.count_if(F.col("recall") >= 1).alias("correct"),
        F.sum("tokens").alias("total_tokens"),
    )
    return agg.withColumn("tokens_per_correct", share(F.col("total_tokens"), F.col("correct"), None))


def condition_deltas(runs: DataFrame) -> DataFrame:
    """``(min_hops, a, b, c, b_minus_a, b_minus_c, ratio)`` of mean recalls, in percentage points (RET13, JN11)."""
    means = runs.groupBy("min_hops").pivot("condition", ["A", "B", "C"]).agg(F.avg("recall"))
    pp = lambda x, y: F.round(100 * (F.col(x) - F.col(y)), 6)
    return means.select("min_hops", *(F.round(x, 6).alias(x.lower()) for x in "ABC"), pp("B", "A").alias("b_minus_a"), pp("B", "C").alias("b_minus_c"), F.round(F.try_divide("B", "A"), 6).alias("ratio"))


def verdict(deltas: DataFrame, points: float = 5.0, growth: float = 1.2) -> DataFrame:
    """One row: how many depths B wins and loses (strictly by over ``points``), whether its ratio grows, the verdict (RET13)."""
    agg = deltas.agg(
        F.count_if(F.col("b_minus_a") > points).alias("wins_a"),
        F.count_if(F.col("b_minus_a") < -points).alias("losses_a"),
        F.count_if(F.col("b_minus_c") > points).alias("wins_c"),
        F.count_if(F.col("b_minus_c") < -points).alias("losses_c"),
        F.min_by("ratio", "min_hops").alias("first"),
        F.max_by("ratio", "min_hops").alias("last"),
    )
    grows = F.coalesce(F.col("last") > growth * F.col("first"), F.lit(False))
    text = (
        F.when((F.col("losses_a") > 0) & (F.col("wins_a") == 0), "structure hurts")
        .when((F.col("wins_a") > 0) & (F.col("losses_a") > 0), "mixed")
        .when((F.col("wins_a") > 0) & (F.col("wins_c") > 0) & grows, "structure helps, more with depth")
        .when((F.col("wins_a") > 0) & (F.col("wins_c") > 0), "structure helps")
        .when(F.col("wins_a") > 0, "content helps, structure doesn't")
        .otherwise("no difference")
    )
    return agg.select("wins_a", "losses_a", "wins_c", "losses_c", grows.alias("grows"), text.alias("verdict"))


def first_hits(hits: DataFrame) -> DataFrame:
    """``(strategy, qid, rank)`` of each query's first relevant hit; null if none (RET14)."""
    return hits.groupBy("strategy", "qid").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("rank"))


def rank_metrics(firsts: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """``(strategy, n, r_at_k..., mrr)``; all queries are the denominator (RET14)."""
    at = [F.round(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")), 6).alias(f"r_at_{k}") for k in ks]
    return firsts.groupBy("strategy").agg(F.count("*").alias("n"), *at, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def nearest_rank(values: DataFrame, by: Sequence[str], x: str, q: float) -> DataFrame:
    """``(by..., p)``: the value at index floor(q n), capped, of the sorted values (RET14)."""
    w = Window.partitionBy(*by).orderBy(x)
    ranked = values.where(F.col(x).isNotNull()).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    return ranked.where(F.col("i") == F.least(F.floor(F.col("n") * q), F.col("n") - 1)).select(*by, F.col(x).alias("p"))


def strategy_flips(firsts: DataFrame) -> DataFrame:
    """``(a, b, flip, n)`` over pairs of strategies: moved up or down, new, lost, same (RET15)."""
    x, y = (firsts.select("qid", F.col("strategy").alias(s), F.col("rank").alias(f"r{s}")) for s in "ab")
    pair = x.join(y, "qid").where("a < b and (ra is not null or rb is not null)")
    flip = F.when(F.col("ra").isNull(), "new").when(F.col("rb").isNull(), "lost").when(F.col("rb") < F.col("ra"), "moved_up").when(F.col("rb") > F.col("ra"), "moved_down").otherwise("same")
    return pair.groupBy("a", "b", flip.alias("flip")).agg(F.count("*").alias("n"))


def k_curve(firsts: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """``(strategy, k, recall, mrr)`` at each cut (RET16, RET17)."""
    cut = firsts.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.col("rank") <= F.col("k")
    return cut.groupBy("strategy", "k").agg(F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 6).alias("recall"), F.round(F.avg(F.when(hit, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr"))


def router_table(firsts: DataFrame, a: str, b: str) -> DataFrame:
    """One row: both, only a, only b, neither right at 1, and the best router's share and lifts (RET18)."""
    one = lambda s: firsts.where(F.col("strategy") == s).select("qid", F.coalesce(F.col("rank") == 1, F.lit(False)).alias(s))
    x, y = F.col(a), F.col(b)
    t = one(a).join(one(b), "qid").agg(F.count("*").alias("n"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))
    n = F.col("n")
    return t.select("n", "both", "only_a", "only_b", "neither", share(n - F.col("neither"), n).alias("router"), share(F.col("only_b"), n).alias("lift_a"), share(F.col("only_a"), n).alias("lift_b"))


def reorder(candidates: DataFrame, scores: Sequence[str], keep_hopeless: bool = False) -> DataFrame:
    """``(strategy, qid, rank)`` of the first relevant candidate under each score, nulls last (RET19, RET22, FLT10).

    Queries without a relevant candidate are dropped, unless they are kept
    with a null rank.
    """
    out = None
    for s in scores:
        w = Window.partitionBy("qid").orderBy(F.desc_nulls_last(s), "id")
        part = candidates.withColumn("r", F.row_number().over(w)).groupBy("qid").agg(F.min(F.when(F.col("relevant"), F.col("r"))).alias("rank")).select(F.lit(s).alias("strategy"), "qid", "rank")
        out = part if out is None else out.unionByName(part)
    return out if keep_hopeless else out.where("rank is not null")


def weight_sweep(candidates: DataFrame, weights: Sequence[float], k: int = 5, ties: str = "id") -> DataFrame:
    """``(w, recall, mrr)`` of ``w * a + (1 - w) * b`` over a grid (RET22); of equal scores the smallest ``ties`` is first."""
    grid = candidates.withColumn("w", F.explode(F.array(*(F.lit(float(x)) for x in weights))))
    score = F.round(F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b"), 9)
    ranked = grid.withColumn("r", F.row_number().over(Window.partitionBy("w", "qid").orderBy(F.desc(score), ties)))
    first = ranked.groupBy("w", "qid").agg(F.min(F.when(F.col("relevant"), F.col("r"))).alias("rank"))
    return first.groupBy("w").agg(F.round(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def trust_gate(candidates: DataFrame, margin: float, ties: str = "id") -> DataFrame:
    """One row: queries, overridden, helped, hurt when a rerank score replaces the first pick (RET20).

    The best rerank replaces the base's first only if it is another
    candidate and leads it by ``margin``. Of equal scores the smallest
    ``ties`` is first, a column or a struct of several.
    """
    pick = F.struct("id", "relevant", F.col("b").alias("s"))
    base = candidates.groupBy("qid").agg(*(F.min_by(pick, F.struct(-F.col(c), F.col(ties))).alias(n) for c, n in (("a", "x"), ("b", "y"))))
    over = (F.col("x.id") != F.col("y.id")) & (F.col("y.s") - F.col("x.s") >= margin)
    return base.agg(F.count("*").alias("n"), F.count_if(over).alias("overridden"), F.count_if(over & F.col("y.relevant") & ~F.col("x.relevant")).alias("helped"), F.count_if(over & ~F.col("y.relevant") & F.col("x.relevant")).alias("hurt"))


def chunk_rollup(hits: DataFrame) -> DataFrame:
    """``(qid, parent, rank)``: chunk ids without their suffix, each parent at its best rank (RET25)."""
    parent = F.regexp_replace(F.regexp_replace("id", r"^chunk:", ""), r"_chunk_\d+$", "")
    return hits.groupBy("qid", parent.alias("parent")).agg(F.min("rank").alias("rank"))


def entity_overlap(rows: DataFrame) -> DataFrame:
    """``(qid, precision)``: retrieved ids that hold an expected one; null without expected, 0 without retrieved (RET26)."""
    held = F.size(F.filter("retrieved", lambda r: F.exists("expected", lambda e: F.contains(r, e))))
    n = F.size("retrieved")
    return rows.select("qid", F.round(F.when(F.size("expected") == 0, None).when(n == 0, 0.0).otherwise(held / n), 6).alias("precision"))


def token_utilization(rows: DataFrame) -> DataFrame:
    """``(qid, utilization)``: the answer's share of the context's tokens, at most 1; null if there is no context or the answer is it (RET27)."""
    n = lambda c: F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != ""))
    a, c = n("answer"), n("context")
    return rows.select("qid", F.round(F.when((c == 0) | (F.trim("answer") == F.trim("context")), None).otherwise(F.least(a, c) / c), 6).alias("utilization"))


def pivot_deltas(rows: DataFrame, row: str, column: str, value: str, values: Sequence[str], baseline: str) -> DataFrame:
    """Means by ``row`` x ``column``, each less the baseline row's (RET34, RET35)."""
    table = rows.groupBy(row).pivot(column, list(values)).agg(F.round(F.avg(value), 6))
    base = table.where(F.col(row) == baseline).select(*(F.col(v).alias(f"base_{v}") for v in values))
    return table.crossJoin(F.broadcast(base)).select(row, *values, *(F.round(F.col(v) - F.col(f"base_{v}"), 6).alias(f"delta_{v}") for v in values))


def tokens_at_budget(hits: DataFrame, budget: int) -> DataFrame:
    """``(qid, kept, tokens)``: how many hits, in rank order, fit a token budget (an extension)."""
    total = F.sum("tokens").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("total", total).where(F.col("total") <= budget).groupBy("qid").agg(F.count("*").alias("kept"), F.max("total").alias("tokens"))

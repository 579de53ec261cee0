"""Statistics over paired runs, probabilities and labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattis.operators.ordering import global_index, running
from lattis.operators.ranks import share
from lattis.operators.twister import stream_from
from lattis.session import cut_lineage, materialize


def paired(a: DataFrame, b: DataFrame, key: str = "qid", x: str = "score") -> DataFrame:
    """``(key, a, b, diff)`` of pairs in which neither is null (JN5)."""
    both = a.select(key, F.col(x).alias("a")).join(b.select(key, F.col(x).alias("b")), key)
    return both.where("a is not null and b is not null").withColumn("diff", F.col("a") - F.col("b"))


def paired_by_position(a: DataFrame, b: DataFrame, order: Sequence[str], key: str, x: str) -> DataFrame:
    """Pairs by place in ``order``; ``agree`` tells whether the keys of a pair do (JN6)."""
    n = lambda df, s: global_index(df, order).select("i", F.col(key).alias(f"key_{s}"), F.col(x).alias(s))
    return n(a, "a").join(n(b, "b"), "i").withColumn("agree", F.col("key_a").eqNullSafe(F.col("key_b")))


def bootstrap_means(diffs: np.ndarray, resamples: int, seed: int, chunk: int = 1000) -> np.ndarray:
    """Means of resamples, ``chunk`` at a time from one legacy stream, so the chunk size changes nothing."""
    rng, n = np.random.RandomState(seed), len(diffs)
    out = [diffs[rng.randint(0, n, size=(min(chunk, resamples - k), n))].mean(axis=1) for k in range(0, resamples, chunk)]
    return np.concatenate(out)


def bootstrap_sums(diffs: np.ndarray, n: int, first: int, resamples: int, seed: int, draws: int = 4_000_000) -> np.ndarray:
    """What ``diffs``, which are those of ``n`` from place ``first`` on, add to each resample's sum; about ``draws`` places are drawn at a time from one legacy stream."""
    rng, out = np.random.RandomState(seed), np.zeros(resamples)
    held = np.append(diffs, 0.0)  # the last stands for places of other tasks
    rows, at = max(1, draws // n), 0
    while at < resamples:
        k = min(rows, resamples - at)
        for left in range(0, n, n if rows > 1 else draws):
            place = rng.randint(0, n, size=(k, n if rows > 1 else min(draws, n - left)))
            if len(diffs) < n:
                place = np.minimum((place - first).view(np.uint64), len(diffs)).view(np.int64)
            out[at : at + k] += held[place].sum(axis=1)
        at += k
    return out


def shared_sums(diffs: np.ndarray, n: int, first: int, resamples: int, seed: int, place: int, words: int | None, at: int, step: int = 1 << 21) -> np.ndarray:
    """:func:`bootstrap_sums` of only those draws that ``words`` words of the stream give, from its ``place`` on, or all that are left; ``at`` draws come before.

    A draw is the next word's lowest bits that are less than ``n``.
    """
    rng, out, end = stream_from(seed, place), np.zeros(resamples), resamples * n
    held, left = np.append(diffs, 0.0), words
    while at < end and left != 0:
        drawn = rng.randint(0, 1 << 32, size=step if left is None else min(step, left), dtype=np.uint32)
        left = None if left is None else left - len(drawn)
        drawn &= np.uint32((1 << (n - 1).bit_length()) - 1)
        drawn = drawn[drawn < n][: end - at]
        if not len(drawn):
            continue
        if len(diffs) < n:
            drawn = np.minimum((drawn.astype(np.int64) - first).view(np.uint64), len(diffs)).view(np.int64)
        row = at // n
        starts = np.append(0, np.arange((row + 1) * n, at + len(drawn), n) - at)
        out[row : row + len(starts)] += np.add.reduceat(held[drawn], starts)
        at += len(drawn)
    return out


def _accepted(n: int, seed: int, place: int, words: int, step: int = 1 << 21) -> int:
    """How many draws of ``n`` those words of the stream give."""
    rng, mask, found = stream_from(seed, place), np.uint32((1 << (n - 1).bit_length()) - 1), 0
    for k in range(0, words, step):
        found += int(np.count_nonzero((rng.randint(0, 1 << 32, size=min(step, words - k), dtype=np.uint32) & mask) < n))
    return found


#: The fewest words of a stream that are worth a task, and the most tasks among which a group's stream is dealt.
WORDS, SHARES = 1 << 31, 32


def _shares(n: int, resamples: int, words: int) -> list[tuple[int, int | None]]:
    """``(place, words)`` of the tasks among which the stream of a group of ``n`` is dealt; the last takes what is left."""
    whole = resamples << (n - 1).bit_length()
    k = min(SHARES, whole // words) if 1 < n <= 1 << 32 else 1
    each = whole // max(k, 1)
    return [(i * each, each if i < k - 1 else None) for i in range(max(k, 1))]


def _resampled(diffs: DataFrame, by: Sequence[str], resamples: int, seed: int, most: int, words: int = WORDS) -> DataFrame:
    """``(by..., n, total, block, sums)``: parts of ``most`` pairs of a group, in the order of ``ord``, and what each adds to the resamples' sums.

    A task holds its own pairs only. Where a group's stream is long, it is
    dealt among tasks: the draws that come before each are counted, by tasks
    too, and then every task draws its share for one part.
    """
    placed = global_index(diffs.select(*by, "ord", "diff"), [*by, "ord"], "_i")
    groups = placed.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), by, F.lit(True))
    at = F.col("_i") - F.col("_first")
    dealt = placed.join(groups, same).select(*by, "diff", "_n", at.alias("_at"), F.expr(f"(_i - _first) div {most}").alias("_block"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in diffs.dtypes if c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        d, n, first = pdf["diff"].to_numpy(dtype=float), int(pdf["_n"].iloc[0]), int(pdf["_at"].iloc[0])
        whole = len(_shares(n, resamples, words)) == 1
        row = {c: [pdf[c].iloc[0]] for c in by} | {"n": [n], "total": [d.sum()], "block": [pdf["_block"].iloc[0]], "first": [first]}
        return pd.DataFrame(row | {"sums": [bootstrap_sums(d, n, first, resamples, seed) if whole else None], "held": [None if whole else d.tobytes()]})

    own = materialize(dealt.groupBy(*by, "_block").applyInPandas(run, f"{kinds}, n long, total double, block long, first long, sums array<double>, held binary"), "resamples")
    done = own.where("held is null").select(*by, "n", "total", "block", "sums")
    parts = {r["n"]: r["k"] for r in own.where("held is not null").groupBy("n").agg(F.count("*").alias("k")).collect()}  # sizes whose streams are dealt
    if not parts:
        return done
    shares = [(n, i, place, left) for n in parts for i, (place, left) in enumerate(_shares(n, resamples, words))]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            some = [shares[k] for k in pdf["id"]]
            yield pd.DataFrame({"id": pdf["id"], "k": [0 if left is None else _accepted(n, seed, place, left) for n, _, place, left in some]})

    spark = diffs.sparkSession
    counts = {r["id"]: r["k"] for r in spark.range(0, len(shares), 1, len(shares)).mapInPandas(count, "id long, k long").collect()}
    rows, before = [], 0
    for k, (n, i, place, left) in enumerate(shares):
        before = before + counts[k - 1] if i else 0
        rows.append((n, i, place, left, before))
    table = F.broadcast(spark.createDataFrame(rows, "n long, share long, place long, words long, before long"))
    tasks = 4 * sum(k * len(_shares(n, resamples, words)) for n, k in parts.items())  # so that few get two
    spread = own.where("held is not null").drop("sums").join(table, "n").repartition(tasks, *by, "block", "share")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(len(pdf)):
                r = pdf.iloc[[k]]
                n, first, place, left, before = (r[c].iloc[0] for c in ("n", "first", "place", "words", "before"))
                left = None if pd.isna(left) else int(left)
                sums = shared_sums(np.frombuffer(r["held"].iloc[0]), int(n), int(first), resamples, seed, int(place), left, int(before))
                yield r[[*by, "n", "block"]].assign(total=r["total"].where(r["share"] == 0, 0.0), sums=[sums])[[*by, "n", "total", "block", "sums"]]

    return done.unionByName(spread.mapInPandas(draw, f"{kinds}, n long, total double, block long, sums array<double>"))


def _means(pdf: pd.DataFrame) -> tuple[int, float, np.ndarray]:
    """A group's pairs, their mean and the resamples' means, from the parts of :func:`_resampled`."""
    pdf = pdf.sort_values("block")
    n = int(pdf["n"].iloc[0])
    return n, float(pdf["total"].sum()) / n, np.sum(np.stack(pdf["sums"].to_list()), axis=0) / n


def paired_bootstrap(diffs: DataFrame, by: Sequence[str], resamples: int = 10_000, confidence: float = 0.95, seed: int = 42, most: int = 2_000_000) -> DataFrame:
    """``(by..., n, mean, low, high, p)`` of paired differences (STA1).

    Percentile interval, linear; p is twice the share of resampled means on
    the other side of 0, at most 1. A task holds ``most`` pairs of a group,
    of which there may be any number; the stream of draws is the same however
    a group or its stream is dealt. See :func:`poisson_bootstrap` for fewer draws.
    """
    tail = (1 - confidence) / 2 * 100

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, means = _means(pdf)
        low, high = np.percentile(means, [tail, 100 - tail])
        other = (means <= 0).mean() if mean > 0 else (means >= 0).mean()
        row = {c: [pdf[c].iloc[0]] for c in by}
        return pd.DataFrame(row | {"n": [n], "mean": [mean], "low": [low], "high": [high], "p": [min(1.0, 2 * other)]})

    kinds = ", ".join(f"`{c}` {t}" for c, t in diffs.dtypes if c in by)
    return _resampled(diffs, by, resamples, seed, most).groupBy(*by).applyInPandas(run, f"{kinds}, n long, mean double, low double, high double, p double")


def _bits(text: Column) -> Column:
    """The first 28 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def poisson_bootstrap(diffs: DataFrame, by: Sequence[str], key: str, resamples: int = 200, confidence: float = 0.95) -> DataFrame:
    """``(by..., n, mean, low, high)`` for any number of pairs: each is weighed by a hashed Poisson(1) draw a resample.

    The draw comes from the first 28 bits of the md5 of ``key|resample``.
    Sums are combined map-side, so a group moves ``resamples`` rows a task.
    """
    u = (_bits(F.concat_ws("|", F.col(key).cast("string"), F.col("r").cast("string"))) + 0.5) / float(1 << 28)
    weight, p, total = F.lit(0), np.exp(-1), 0.0
    for k in range(8):
        total += p
        weight = weight + (u > total).cast("int")
        p /= k + 1
    drawn = diffs.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight)
    means = drawn.groupBy(*by, "r").agg((F.sum(F.col("w") * F.col("diff")) / F.sum("w")).alias("m"))
    tail = (1 - confidence) / 2
    band = means.groupBy(*by).agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return diffs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("diff").alias("mean")).join(band, list(by))


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05, key: str = "id", p: str = "p") -> DataFrame:
    """``(key, p, p_adjusted, rejected)`` (STA2): monotone from the largest p, at most 1.

    ``alpha`` must be in (0, 1], and no p null, NaN or outside [0, 1].
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    checked = F.when(F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1), F.raise_error(F.lit("p must be in [0, 1]")).cast("double")).otherwise(F.col(p))
    ranked = global_index(tests.select(key, checked.alias("_p")), ["_p", key], "rank").crossJoin(tests.agg(F.count("*").alias("m")))
    raw = F.col("_p") * F.col("m") / F.col("rank")
    least = running(ranked, [F.desc("rank")], raw, F.min, "least")
    return least.withColumn("p_adjusted", F.least(F.lit(1.0), "least")).select(key, F.col("_p").alias(p), F.round("p_adjusted", 9).alias("p_adjusted"), (F.col("p_adjusted") <= alpha).alias("rejected"))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """The exact two-sided sign probability of ``k`` of ``n``; 1 for no trials.

    The tail's terms are built up in logarithms, one from the one before.
    """
    low = F.least(k, n - k).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    tail = F.aggregate(F.when(low > 0, F.sequence(F.lit(1), low)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """One row: ``b`` (only a right), ``c`` (only b right), exact p (STA4)."""
    t = pairs.agg(F.count_if(F.col("a") & ~F.col("b")).alias("b"), F.count_if(~F.col("a") & F.col("b")).alias("c"))
    return t.select("b", "c", F.round(binomial_two_sided(F.col("b"), F.col("b") + F.col("c")), 9).alias("p"))


def sign_test(diffs: DataFrame) -> DataFrame:
    """One row: positive, negative, exact p over differences that aren't 0 (STA5)."""
    t = diffs.agg(F.count_if(F.col("diff") > 0).alias("positive"), F.count_if(F.col("diff") < 0).alias("negative"))
    return t.select("positive", "negative", F.round(binomial_two_sided(F.col("positive"), F.col("positive") + F.col("negative")), 9).alias("p"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(n, rho)`` with average ranks; null for n < 3 or no variance (STA8).

    Ranks come from counts of distinct values, so ties and hot values are
    summed before they are put in order, by ranges.
    """

    def ranks(c: str) -> DataFrame:
        counts = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(c).agg(F.count("*").alias("k"))
        return running(counts, [c], "k", F.sum, "last").select(c, (F.col("last") - (F.col("k") - 1) / 2).alias(f"rank_{c}"))

    joined = rows.join(ranks(x), x).join(ranks(y), y)
    a, b = f"rank_{x}", f"rank_{y}"
    agg = joined.agg(F.count("*").alias("n"), F.covar_pop(a, b).alias("c"), (F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))).alias("s"))
    return agg.select("n", F.round(F.when(F.col("n") >= 3, F.try_divide("c", "s")), 6).alias("rho"))


def _pooled(m: Sequence[float], n: Sequence[float]) -> list[list[float]]:
    """Pool adjacent violators: ``[mean, weight, members]`` of each block."""
    blocks: list[list[float]] = []
    for mean, weight in zip(m, n):
        blocks.append([mean, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, n2, k2 = blocks.pop()
            m1, n1, k1 = blocks[-1]
            blocks[-1] = [(m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2, k1 + k2]
    return blocks


def isotonic(rows: DataFrame, x: str = "score", y: str = "y") -> DataFrame:
    """``(x, n, fitted)``: the non-decreasing least-squares fit over distinct ``x`` (STA9).

    Equal scores are pooled first, by a distributed aggregation, then
    adjacent violators within ranges of scores. What is pooled there stays
    together in the whole fit, so only the ranges' blocks meet in one task;
    scores come back to their block by its number.
    """
    pooled = rows.groupBy(F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("m"), F.count("*").alias("n"))
    dealt = cut_lineage(pooled.repartitionByRange("x").withColumn("range", F.shiftright(F.monotonically_increasing_id(), 33)))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        blocks = _pooled(pdf["m"], pdf["n"])
        each = np.array([k for _, _, k in blocks], dtype=np.int64)
        mean, weight = (np.repeat(np.array([b[i] for b in blocks], dtype=float), each) for i in (0, 1))
        return pd.DataFrame({"range": pdf["range"], "block": np.repeat(np.arange(len(each)), each), "x": pdf["x"], "n": pdf["n"], "mean": mean, "weight": weight})

    local = cut_lineage(dealt.groupBy("range").applyInPandas(within, "range long, block long, x double, n long, mean double, weight double"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["range", "block"])
        blocks = _pooled(pdf["mean"], pdf["weight"])
        fitted = np.concatenate([np.full(int(k), m) for m, _, k in blocks])
        return pd.DataFrame({"range": pdf["range"], "block": pdf["block"], "fitted": np.round(fitted, 9)})

    blocks = local.select("range", "block", "mean", "weight").distinct().withColumn("all", F.lit(0))
    fit = blocks.groupBy("all").applyInPandas(across, "range long, block long, fitted double")
    return local.select("range", "block", "x", "n").join(fit, ["range", "block"]).select("x", "n", "fitted")


def calibration_error(rows: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """One row ``(n, brier, ece)``; equal-width bins, the last closed (STA10)."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(y).alias("acc"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("sq"))
    n = F.sum("n")
    return per.agg(n.alias("n"), F.round(F.sum("sq") / n, 6).alias("brier"), F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / n, 6).alias("ece"))


def latency_percentiles(rows: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """``(by..., n, p50, p95, p99, p999, mean, min, max)`` with linear interpolation (L7b)."""
    q = lambda v: F.round(F.percentile(x, F.lit(v)), 6)
    return rows.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), q(0.999).alias("p999"), F.round(F.avg(x), 6).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))


def latency_sketch(rows: DataFrame, by: Sequence[str], x: str, accuracy: int = 10_000) -> DataFrame:
    """Approximate percentiles of bounded state, for inputs too large to sort."""
    q = F.percentile_approx(x, F.array(*map(F.lit, (0.5, 0.95, 0.99, 0.999))), accuracy)
    return rows.groupBy(*by).agg(F.count(x).alias("n"), q.alias("p50_p95_p99_p999"))


#: Judged labels that count.
CORRECT, ABSTAIN, KNOWN = "CORRECT", "ABSTAIN", ("CORRECT", "PARTIAL", "INCORRECT", "ABSTAIN", "ERROR")


def dual_metric(rows: DataFrame) -> DataFrame:
    """``(category, n, judged, recall, accuracy, gap, errors)``; a null category row is the whole (STA12).

    Null labels are skipped; unknown ones are errors and aren't judged.
    """
    label = F.when(F.col("label").isNull(), None).when(F.col("label").isin(*KNOWN), F.col("label")).otherwise("ERROR")
    agg = rows.withColumn("label", label).rollup("category").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") != "ERROR").alias("judged"),
        F.round(F.avg("recall"), 6).alias("recall"),
        F.count_if(F.col("label").isin(CORRECT, ABSTAIN)).alias("right"),
        F.count_if(F.col("label") == "ERROR").alias("errors"),
    )
    accuracy = share(F.col("right"), F.col("judged"), None)
    return agg.select("category", "n", "judged", "recall", accuracy.alias("accuracy"), F.round(F.col("recall") - accuracy, 6).alias("gap"), "errors")


def label_accuracy(rows: DataFrame) -> DataFrame:
    """``(category, n, right, accuracy)``; abstaining is right only where it is asked for (STA14)."""
    right = (F.col("label") == CORRECT) | ((F.col("label") == ABSTAIN) & F.col("is_abstention"))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if(right).alias("right"), share(F.count_if(right), F.count("*")).alias("accuracy"))


def judge_majority(votes: DataFrame) -> DataFrame:
    """``(qid, label, votes, agreement)``: the commonest label that isn't ERROR; ties: the one seen first (STA16)."""
    counts = votes.where("label <> 'ERROR'").groupBy("qid", "label").agg(F.count("*").alias("k"), F.min("replicate").alias("first"))
    return counts.groupBy("qid").agg(F.min_by("label", F.struct(-F.col("k"), "first")).alias("label"), F.sum("k").alias("votes"), share(F.max("k"), F.sum("k")).alias("agreement"))


def disagreements(rows: DataFrame) -> DataFrame:
    """Rows in which recall (0.5 or more) and the judge differ (STA13)."""
    return rows.where((F.col("recall") >= 0.5) != (F.col("label") == CORRECT))


def token_cost(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """``(model, queries, correct, cost, per_query, per_correct)`` (STA19, JN13)."""
    joined = rows.join(prices, "model")
    cost = F.sum(F.col("input_tokens") * F.col("input_per_1m") / 1e6 + F.col("output_tokens") * F.col("output_per_1m") / 1e6)
    agg = joined.groupBy("model").agg(F.count("*").alias("queries"), F.count_if("correct").alias("correct"), cost.alias("cost"))
    return agg.select("model", "queries", "correct", F.round("cost", 6).alias("cost"), F.round(F.try_divide("cost", "queries"), 6).alias("per_query"), F.round(F.try_divide("cost", "correct"), 6).alias("per_correct"))


def stratified_cap(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows, taken from the groups in turn, nulls last (STA21)."""
    r = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("turn") <= n)
    return r.orderBy("turn", F.col(group).isNull(), group).limit(n).drop("turn")


def stratified_sample(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows a group in the order of a hash of seed and key (STA22)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(digest, key))).where(F.col("turn") <= n).drop("turn")


def drift(series: DataFrame, day: str, metric: str) -> DataFrame:
    """Each day's reading and its change from the day before (STA25)."""
    return series.withColumn("delta", F.round(F.col(metric) - F.lag(metric).over(Window.orderBy(day)), 6))


def apply_resolution(mentions: DataFrame, resolution: DataFrame) -> DataFrame:
    """Mentions under their canonical ids; within a note the longest description stays (STA28).

    ``resolution`` is ``(member, canonical, seq)``; the last entry of a member wins.
    """
    one = resolution.groupBy("member").agg(F.max_by("canonical", "seq").alias("canonical"))
    joined = mentions.join(one, F.col("id") == F.col("member"), "left").withColumn("id", F.coalesce("canonical", "id"))
    return joined.groupBy("note", "id").agg(F.max_by("description", F.struct(F.length("description"), F.col("description"))).alias("description"))


def mrr_delta_interval(pairs: DataFrame, by: str, resamples: int = 2_000, seed: int = 0) -> DataFrame:
    """``(by, n, delta, low, high)`` of the MRR's change, with percentiles by index, not interpolated (STA6)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, means = _means(pdf)
        means = np.sort(means)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [n], "delta": [mean], "low": [means[int(0.025 * resamples)]], "high": [means[min(resamples - 1, int(0.975 * resamples))]]})

    return _resampled(pairs, [by], resamples, seed, 2_000_000).groupBy(by).applyInPandas(run, f"`{by}` {dict(pairs.dtypes)[by]}, n long, delta double, low double, high double")


def interpolate(fit: DataFrame, rows: DataFrame, x: str = "score") -> DataFrame:
    """Rows with ``p``: the fit at ``x``, linear between its points and flat beyond them (STA9).

    A row meets the points around it in an ordered union of both, dealt by
    range, so nothing is joined by range: the last point up to it, as a
    running maximum, and the next one, as a running minimum from the end.
    """
    point = F.struct(F.col("x").alias("x"), F.col("fitted").alias("f"))
    marks = fit.select("x", point.alias("piece"), F.lit(-1).cast("long").alias("row"))
    asked = rows.select(F.col(x).cast("double").alias("x"), F.lit(None).cast(marks.schema["piece"].dataType).alias("piece"), F.monotonically_increasing_id().alias("row"))
    below = running(marks.unionByName(asked), ["x", "row"], "piece", F.max, "low")
    both = running(below, [F.desc("x"), F.desc("row")], "piece", F.min, "high").where("row >= 0")
    t = (F.col("x") - F.col("low.x")) / (F.col("high.x") - F.col("low.x"))
    p = F.when(F.col("low").isNull(), F.col("high.f")).when(F.col("high").isNull(), F.col("low.f")).otherwise(F.col("low.f") + t * (F.col("high.f") - F.col("low.f")))
    return both.select(F.col("x").alias(x), p.alias("p"))


def cross_validated_calibration(rows: DataFrame, key: str, folds: int = 5, score: str = "score", y: str = "y") -> DataFrame:
    """One row ``(n, brier, ece)`` of calibrated scores, each fitted without its own fold (STA11).

    Folds are dealt by the md5 of the key.
    """
    dealt = rows.withColumn("fold", _bits(F.col(key).cast("string")) % folds)
    out = None
    for k in range(folds):
        held = dealt.where(F.col("fold") == k)
        fit = isotonic(dealt.where(F.col("fold") != k), score, y)
        # the score keeps its row's label through the ordered union: labels are averaged by score first
        by_score = held.groupBy(F.col(score).cast("double").alias(score)).agg(F.sum(y).alias("right"), F.count("*").alias("n"))
        part = interpolate(fit, by_score.select(score), score).join(by_score, score)
        out = part if out is None else out.unionByName(part)
    bin_ = F.least(F.floor(F.col("p") * 10), F.lit(9))
    sq = F.col("right") * F.pow(1 - F.col("p"), 2) + (F.col("n") - F.col("right")) * F.pow("p", 2)
    per = out.groupBy(bin_.alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("p") * F.col("n")).alias("conf"), F.sum("right").alias("right"), F.sum(sq).alias("sq"))
    return per.agg(F.sum("n").alias("n"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"), F.round(F.sum(F.abs(F.col("conf") - F.col("right"))) / F.sum("n"), 6).alias("ece"))

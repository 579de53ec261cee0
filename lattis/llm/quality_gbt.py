"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are trained on a bounded sample of labelled rows and flattened into
arrays; whole corpora are then scored by numpy traversal, a batch at a time.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lattis.llm.memory import trimmed

FEATURES = (
    "log_chars",
    "log_words",
    "mean_word_chars",
    "long_word_share",
    "upper_share",
    "title_share",
    "digit_share",
    "symbol_share",
    "space_share",
    "non_ascii_share",
    "comma_stop_share",
    "bang_share",
    "pipe_share",
    "odd_end_share",
    "stop_end_share",
    "distinct_share",
    "top_word_share",
    "same_next_share",
    "longest_run_share",
    "repeat_trigram_share",
    "repeat_line_share",
    "log_lines",
    "words_a_line",
    "words_a_stop",
    "packed_share",
)
_letters_upper = bytes(range(65, 91))
_digits = b"0123456789"
_space = b" \t\n\r\x0b\x0c"
_symbols = b"#$%&*+/<=>@[]^_`{|}~\\"


def statistics(text: str | None) -> list[float]:
    """The ``FEATURES`` of a whole text; a null or empty text gives zeros."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [math.log1p(len(text)), *[0.0] * (len(FEATURES) - 1)]
    count = lambda chars: size - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen = Counter(words)
    run = longest = 1
    same = 0
    last = None
    for w in words:
        if w == last:
            same += 1
            run += 1
            if run > longest:
                longest = run
        else:
            run = 1
        last = w
    trigrams = max(0, n - 2)
    distinct = len(set(zip(words, words[1:], words[2:])))
    ends = Counter(w[-1] for w in words)
    stops = ends[46] + ends[63] + ends[33]
    odd = sum(c for b, c in ends.items() if b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b in b".,;:!?'\")"))
    return [
        math.log1p(len(text)),
        math.log1p(n),
        len(text) / n - 1,
        sum(c for w, c in seen.items() if len(w) > 20) / n,
        count(_letters_upper) / size,
        sum(c for w, c in seen.items() if 65 <= w[0] <= 90) / n,
        count(_digits) / size,
        count(_symbols) / size,
        count(_space) / size,
        (size - len(text)) / size,
        count(b",.") / size,
        data.count(b"!") / size,
        data.count(b"|") / size,
        odd / n,
        stops / n,
        len(seen) / n,
        max(seen.values()) / n,
        same / n,
        longest / n,
        1 - distinct / trigrams if trigrams else 0.0,
        1 - len(set(lines)) / len(lines),
        math.log1p(len(lines)),
        n / len(lines),
        n / (1 + stops),
        len(zlib.compress(data, 1)) / size,
    ]


# ---------------------------------------------------------------- training


@dataclass
class Forest:
    """Trees as arrays, one row a tree: complete binary trees of equal depth.

    Node ``i`` has children ``2i + 1`` and ``2i + 2``; a row goes right where
    its feature is over the threshold. A branch that ended early keeps an
    infinite threshold, so its rows go left to the leaf.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**self.depth - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 48, rate: float = 0.15, l2: float = 2.0, least: float = 2.0) -> Forest:
    """Newton boosting of the logistic loss over ``bins`` quantile bins a feature.

    A split needs a Hessian weight of ``least`` on each side. With no rows,
    or rows of one label, every text gets the (smoothed) share of label 1.
    """
    n, width = x.shape if x.ndim == 2 else (0, len(FEATURES))
    inner, leaves = 2**depth - 1, 2**depth
    share = (float(y.sum()) + 1) / (n + 2)
    base = math.log(share / (1 - share))
    shape = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base, depth)
    if n == 0 or y.min() == y.max():
        return shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)])
    flat = binned + np.arange(width) * bins
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                at = np.flatnonzero(node == k)
                if len(at) < 2:
                    continue
                cells = flat[at].ravel()
                gs = np.bincount(cells, np.repeat(g[at], width), width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(cells, np.repeat(h[at], width), width * bins).reshape(width, bins).cumsum(axis=1)
                whole_g, whole_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (whole_g - gs) ** 2 / (whole_h - hs + l2) - whole_g**2 / (whole_h + l2)
                gain[(hs < least) | (whole_h - hs < least)] = -np.inf
                for f in range(width):
                    gain[f, len(edges[f]) :] = -np.inf
                f, b = divmod(int(gain.argmax()), bins)
                if not gain[f, b] > 1e-6:
                    continue
                feature[k], threshold[k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        own = node - inner
        top = np.bincount(own, g, leaves)
        leaf = -rate * top / (np.bincount(own, h, leaves) + l2)
        margin += leaf[own]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base, depth)


# --------------------------------------------------------------- operators


def held_out(id_col: str, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """A forest fitted to at most ``most`` labelled documents.

    Learns only from rows outside the held-out fold, in the order of a hash
    of their ids, so the sample is the same on every run. Labels other than
    0 and 1 are left out; of several labels of a document the largest
    counts. ``most`` rows of features, not texts, reach the driver.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", features(F.col("text")).alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], dtype=np.float64))


def features(text: Column) -> Column:
    @arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in trimmed(batches):
            yield pa.array([statistics(t.as_py()) for t in batch], type=pa.list_(pa.float64()))

    return run(text)


def score(text: Column, forest: Forest) -> Column:
    """The forest's probability of label 1 for each whole text, null and empty ones too."""

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in trimmed(batches):
            x = np.array([statistics(t.as_py()) for t in batch], dtype=np.float64).reshape(len(batch), len(FEATURES))
            yield pa.array(forest.score(x))

    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Null texts are scored like empty ones. Repeated rows and rows with a
    null id are rows of their own; other columns aren't read. No rows give no
    rows; with no labels every text has the score 0.5.
    """
    forest = train(docs, labels, id_col=id_col, text_col=text_col)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col).cast("string"), forest).alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more; columns as they are.

    Rows are judged one by one by their text, null ones as empty, so repeated
    rows go or stay together, whatever their id.
    """
    forest = train(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(score(F.col(text_col).cast("string"), forest) >= threshold)

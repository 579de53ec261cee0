"""Models as injectable functions: readers, judges, rerankers, orchestrators (STA26, RET36, H9c).

The engine calls no service. A caller gives a Python function from a list of
prompts to a list of replies; it runs in Arrow batches, on executors. Stubs
give replies that depend on the prompt only, so runs repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

Complete = Callable[[Sequence[str]], Sequence[str]]


def complete(prompt: Column, model: Complete) -> Column:
    """The model's reply to each prompt; a null prompt gives null. A batch that fails gives ``ERROR: ...`` replies."""

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            asked = batch.to_pylist()
            at = [i for i, p in enumerate(asked) if p is not None]
            try:
                replies = list(model([asked[i] for i in at]))
            except Exception as error:  # a service's failure is a row's result, not the job's
                replies = [f"ERROR: {error}"] * len(at)
            out: list[str | None] = [None] * len(asked)
            for i, reply in zip(at, replies, strict=True):
                out[i] = reply
            yield pa.array(out, pa.string())

    return run(prompt)


def hash_stub(replies: Sequence[str]) -> Complete:
    """A model that picks one of ``replies`` by the prompt's digest."""

    def model(prompts: Sequence[str]) -> list[str]:
        return [replies[int(hashlib.md5(p.encode()).hexdigest(), 16) % len(replies)] for p in prompts]

    return model


def score_pairs(query: Column, text: Column, scorer: Callable[[Sequence[tuple[str, str]]], Sequence[float]]) -> Column:
    """A cross-scorer's value for each pair of query and text; null if either is."""

    @arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for q, t in batches:
            pairs = list(zip(q.to_pylist(), t.to_pylist()))
            at = [i for i, p in enumerate(pairs) if None not in p]
            out: list[float | None] = [None] * len(pairs)
            for i, s in zip(at, scorer([pairs[i] for i in at]), strict=True):
                out[i] = float(s)
            yield pa.array(out, pa.float64())

    return run(query, text)


def verdict_yes(reply: Column) -> Column:
    """Whether a judge's reply says yes (STA17)."""
    return F.contains(F.lower(F.coalesce(reply, F.lit(""))), F.lit("yes"))


def verdict_label(reply: Column, labels: Sequence[str]) -> Column:
    """The first of ``labels`` that stands in the reply as a whole word; else ERROR (STA17)."""
    found = F.regexp_extract(F.upper(F.coalesce(reply, F.lit(""))), r"\b(" + "|".join(labels) + r")\b", 1)
    return F.when(found == "", "ERROR").otherwise(found)


def count_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down (RET28)."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")

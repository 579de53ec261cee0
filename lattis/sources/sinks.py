"""Sinks: reports, rendered corpora, incremental compiles, caches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str) -> None:
    """One row of headline metrics as one JSON record (SNK1)."""
    report.coalesce(1).write.mode("overwrite").json(path)


def scorecard(report: DataFrame, title: str) -> str:
    """The first row of a report as text, a metric a line (SNK2)."""
    row = report.first()
    body = [] if row is None else [f"  {k:<24} {'-' if v is None else v}" for k, v in row.asDict().items()]
    return "\n".join([title, "=" * len(title), *body])


def report_json(report: DataFrame) -> str:
    """The same as JSON, indented."""
    row = report.first()
    return json.dumps(row.asDict(recursive=True) if row else {}, indent=2, default=str)


def write_sessions(turns: DataFrame, path: str, user_only: bool = False) -> None:
    """One text a session under its question's folder (SNK3).

    ``turns`` is ``(question_id, session_id, turn_idx, role, content)``. Rich
    rendering marks roles; ``user_only`` joins the user's turns as they are.
    """
    from lattis.operators.retrieval import render_groups

    rows = turns.where("role = 'user'") if user_only else turns
    text = F.col("content") if user_only else F.concat(F.lit("**"), "role", F.lit("**: "), "content")
    body = render_groups(rows, ["question_id", "session_id"], ["turn_idx"], text)
    body.select("question_id", "session_id", F.col("body").alias("value")).write.mode("overwrite").partitionBy("question_id", "session_id").text(path)


def changed_notes(notes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Notes whose body's digest isn't in the manifest under their path, with the digest (SNK4)."""
    hashed = notes.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    return hashed.join(manifest.select("path", "digest"), ["path", "digest"], "left_anti")


def compile_index(notes: DataFrame, chars: int = 240) -> DataFrame:
    """``(path, summary)``: the first paragraph, at most ``chars`` characters (SNK4)."""
    first = F.get(F.filter(F.transform(F.split("body", r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != ""), F.lit(0))
    return notes.select("path", F.substring(F.coalesce(first, F.lit("")), 1, chars).alias("summary"))


def cache_key(rubric, body, model, provider, version):
    """The content address of a judged result (SNK5)."""
    return F.sha2(F.concat_ws("|", rubric, body, model, provider, version).cast("binary"), 256)


def evict(cache: DataFrame, key: str, ts: str, days: int = 30, most: int = 5_000, drop: float = 0.2) -> DataFrame:
    """What a cache keeps: entries of the last ``days``; of more than ``most``, not the oldest ``drop`` of that number (SNK5).

    Survivors are found by rank from the newest, a limit, so no entry list
    is gathered.
    """
    live = cache.crossJoin(cache.agg(F.max(ts).alias("_now"))).where(F.col(ts) >= F.col("_now") - F.make_dt_interval(F.lit(days))).drop("_now")
    if live.limit(most + 1).count() <= most:
        return live
    return live.orderBy(F.desc(ts), F.desc(key)).limit(int(most * (1 - drop)))


def pinned_context(contexts: DataFrame, path: str) -> None:
    """Contexts as they were shown, for offline replays (SNK6)."""
    contexts.write.mode("overwrite").parquet(path)


#: A character at which no number starts.
_PLAIN = r"(?:(?!(?=\d)\b).)"

#: Characters that no number starts at nor within 60 after, passed by 60, by 8 and one by one; then
#: a number with 60 characters around, or the rest of a text without one. So a text is read a few times, not 60.
NUMBERS = rf"(?s)(?:\D{{60}}(?=\D{{60}}))*+(?:{_PLAIN}{{60}}(?={_PLAIN}{{60}}))*+(?:{_PLAIN}{{8}}(?={_PLAIN}{{60}}))*+(?:{_PLAIN}(?={_PLAIN}{{60}}))*+(?:(.{{0,60}}\b\d[\d.,]*.{{0,60}})|.+)"


def review_surface(notes: DataFrame, numbers: int = 30, quotes: int = 20) -> DataFrame:
    """``(path, kind, i, text)``: numbers with 60 characters around, and quotes of over 8 (FLT13)."""
    around = F.slice(F.filter(F.regexp_extract_all("body", F.lit(NUMBERS), F.lit(1)), lambda x: x != ""), 1, numbers)
    said = F.slice(F.regexp_extract_all("body", F.lit(r'"([^"]{9,})"'), F.lit(1)), 1, quotes)
    rows = lambda kind, c: F.transform(c, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x.alias("text")))
    return notes.select("path", F.inline(F.concat(rows("number", around), rows("quote", said))))


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")

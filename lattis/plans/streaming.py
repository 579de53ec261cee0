"""Streaming operators (extensions): over a table at once, and as streams that stop and start again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattis.plans.registry import query
from lattis.sources import graphs as S
from lattis.streaming import events as E
from lattis.streaming import runs

_text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("events_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    return E.tumbling(S.read(spark, sf_dir, "events")).select(_text("start"), "event_type", "n", "errors")


@query("events_sliding", "WITH w AS (SELECT unnest([0, 6, 12, 18]) AS back), x AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - back * INTERVAL 1 HOUR AS start, event_type FROM events, w) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS error_rate FROM x GROUP BY 1")
def events_sliding(spark, sf_dir):
    return E.sliding_error_rate(S.read(spark, sf_dir, "events")).select(_text("start"), "n", "error_rate")


@query(
    "events_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def events_sessions(spark, sf_dir):
    return E.sessions(S.read(spark, sf_dir, "events"), gap="6 hours").select("user_id", _text("start"), _text("end"), "n")


#: Events of the first third of the time that come last of all.
_streamed = """t AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events),
s AS (SELECT e.*, event_id % 50 = 0 AND epoch_us(ts) < low + (high - low) // 3 AS held_back FROM events e, t)"""


def _events(spark, sf_dir):
    return S.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


def _tumbled(spark, sf_dir):
    first, second, third = runs.thirds(_events(spark, sf_dir))
    late = first.where("event_id % 50 = 0")
    parts = [first.where("event_id % 50 <> 0"), second, third, late]
    return runs.latest(runs.replay(parts, lambda rows: E.tumbling(rows, late="1 hour")), ["start", "event_type"])


@query("stream_tumbling", f"WITH {_streamed} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM s WHERE NOT held_back GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """Days' counts of a stream that stops and starts three times; what is later than its watermark counts no more (STR4)."""
    return _tumbled(spark, sf_dir).select(_text("start"), "event_type", "n", "errors")


@query("stream_late", f"WITH {_streamed} SELECT count(*) AS events, count(*) FILTER (NOT held_back) AS counted, count(*) FILTER (held_back) AS late FROM s")
def stream_late(spark, sf_dir):
    """How many events came too late for their window."""
    counted = _tumbled(spark, sf_dir).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"))
    return _events(spark, sf_dir).where("ts is not null").agg(F.count("*").alias("events")).crossJoin(counted).select("events", "counted", (F.col("events") - F.col("counted")).alias("late"))


@query("stream_dedupe", "SELECT event_id, user_id FROM events")
def stream_dedupe(spark, sf_dir):
    """A stream in which a third of the events come twice, each once (STR6)."""
    parts = [part.unionByName(part.where("event_id % 3 = 0")) for part in runs.thirds(_events(spark, sf_dir))]
    return runs.replay(parts, lambda rows: E.dedupe(rows), "append").select("event_id", "user_id")


@query("stream_latest", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_max(value, ts) AS value FROM events GROUP BY user_id")
def stream_latest(spark, sf_dir):
    """Each user's newest value, kept as state over restarts; the second third of the time arrives last (STR5)."""
    first, second, third = runs.thirds(_events(spark, sf_dir).select("user_id", "ts", "value"))
    told = runs.replay([first, third, second], E.latest_facts, settings=runs.STATE_STORE)
    return runs.latest(told.drop("superseded"), ["user_id"]).select("user_id", _text("ts"), "value")

"""Streams that stop, fail and start again give what a batch gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lattis.streaming import events as E
from lattis.streaming import runs


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def facts(spark, rows):
    return spark.createDataFrame([(u, at(m), v) for u, m, v in rows], "user_id long, ts timestamp, value double")


def test_latest_facts_keep_the_newest_over_restarts(spark):
    parts = [[(1, 5, 1.0), (1, 9, 2.0), (2, 3, 7.0)], [(1, 7, 8.0), (3, 1, 3.0)], [(2, 30, 9.0), (1, 10, 4.0), (3, 0, 5.0)]]
    told = runs.replay([facts(spark, p) for p in parts], E.latest_facts, settings=runs.STATE_STORE)
    got = {r["user_id"]: (r["ts"], r["value"]) for r in runs.latest(told.drop("superseded"), ["user_id"]).collect()}
    assert got == {1: (at(10), 4.0), 2: (at(30), 9.0), 3: (at(1), 3.0)}
    heard = {(r["user_id"], r["ts"], r["superseded"]) for r in told.collect()}
    assert (1, at(9), 0) in heard and (2, at(30), 1) in heard  # an older fact that comes late supersedes nothing
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != runs.STATE_STORE["spark.sql.streaming.stateStore.providerClass"]


def test_latest_facts_equal_following_each_key(spark, monkeypatch):
    """Many keys to a state, ties, a null key, large keys and values that are missing; groups and calls of the store are bounded by the states."""
    rng = random.Random(3)
    keys = [None, 0, 5, (1 << 60) + 1, (1 << 60) + 2, *range(100, 130)]
    parts = [[(rng.choice(keys), rng.randrange(40), rng.choice([None, *map(float, range(9))])) for _ in range(200)] for _ in range(3)]
    monkeypatch.setattr(E, "BUCKETS", 3)
    told = runs.replay([facts(spark, p).coalesce(1) for p in parts], E.latest_facts, settings=runs.STATE_STORE)
    now, want = {}, set()
    for number, part in enumerate(parts):
        replaced = {}
        for user, minute, value in part:
            replaced.setdefault(user, 0)
            if user not in now or minute >= now[user][0]:
                replaced[user] += user in now
                now[user] = (minute, value)
        want |= {(number, u, at(now[u][0]), now[u][1], n) for u, n in replaced.items()}
    got = told.select("batch", "user_id", "ts", "value", "superseded").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_latest_facts_keep_a_state_for_many_keys(spark, tmp_path):
    facts(spark, [(1, 5, 1.0)]).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("user_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    assert "bucket" in E.latest_facts(rows)._jdf.queryExecution().analyzed().toString()


def test_a_batch_that_fails_half_way_counts_once(spark):
    events = spark.range(300).select(F.col("id").alias("event_id"), (F.timestamp_seconds(F.col("id") * 600)).alias("ts"), F.when(F.col("id") % 7 == 0, "error").otherwise("view").alias("event_type"))
    run = runs.Run(spark, events.schema, E.tumbling)
    run.arrive(events.where("event_id < 100"))
    run.catch_up()
    run.arrive(events.where("event_id >= 100"))

    def broken(batch, number):
        run.write(batch.limit(2), number)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run.catch_up(broken)
    run.catch_up()
    got = runs.latest(run.results(), ["start", "event_type"])
    key = lambda df: sorted(map(tuple, df.select("start", "event_type", "n", "errors").collect()))
    assert key(got) == key(E.tumbling(events)) and run.results().select("batch").distinct().count() == 2


def test_rows_behind_the_watermark_are_left_out(spark):
    rows = lambda *m: spark.createDataFrame([(at(x), "view") for x in m], "ts timestamp, event_type string")
    told = runs.replay([rows(0, 10), rows(5 * 1440), rows(20, 5 * 1440 + 1)], lambda s: E.tumbling(s, late="1 hour"))
    assert {(r["start"], r["n"]) for r in runs.latest(told, ["start", "event_type"]).collect()} == {(at(0), 2), (at(5 * 1440), 2)}


def test_thirds(spark):
    events = spark.createDataFrame([(at(m),) for m in (0, 10, 19, 20, 30)] + [(None,)], "ts timestamp")
    assert [p.count() for p in runs.thirds(events)] == [1, 2, 2]
    assert [p.count() for p in runs.thirds(events.where("ts is null"))] == [0, 0, 0]

"""Streams of events: windows, sessions, deduplication, latest facts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """``(start, event_type, n, errors)`` a window (STR1, STR4); batch or stream, with a watermark if ``late`` is given."""
    rows = events.withWatermark("ts", late) if late else events
    agg = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return agg.select(F.col("window.start").alias("start"), "event_type", "n", "errors")


def sliding_error_rate(events: DataFrame, width: str = "1 day", step: str = "6 hours") -> DataFrame:
    """``(start, n, error_rate)`` of overlapping windows (STR2)."""
    agg = events.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("rate"))
    return agg.select(F.col("window.start").alias("start"), "n", F.round("rate", 6).alias("error_rate"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """``(user_id, start, end, n)`` of activity without a longer gap (STR3)."""
    rows = events.withWatermark("ts", late) if late else events
    agg = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def dedupe(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark (STR6)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


#: Keys share so many states: calls to the state store, and groups in Python, are as many at any number of keys.
BUCKETS = 1024


class LatestFact(StatefulProcessor):
    """The newest fact of each key of a bucket; an older one that arrives late changes nothing (STR5).

    A bucket's state is its keys in order, with the time and the value of each, as bytes: 24 a key.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "keys binary, us binary, vals binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (b"", b"", b"")
        now = pd.DataFrame({c: np.frombuffer(bytes(b), t) for c, b, t in zip(("user", "us", "value"), held, ("<i8", "<i8", "<f8"))})
        heard: list[pd.DataFrame] = []
        for pdf in rows:
            both = pd.concat([now, pdf[["user", "us", "value"]].astype(now.dtypes)], ignore_index=True)
            us = both.groupby("user")["us"]
            # a fact that is as late as all before it, in the order of arrival, takes the place of one, if there was one
            stands = both["us"] == us.cummax()
            replaced = stands & (us.cumcount() > 0)
            now = both[stands].drop_duplicates("user", keep="last").sort_values("user", ignore_index=True)
            heard.append(replaced.groupby(both["user"]).sum()[np.unique(pdf["user"])])
        if heard:
            self.state.update(tuple(now[c].to_numpy(t).tobytes() for c, t in (("user", "<i8"), ("us", "<i8"), ("value", "<f8"))))
            counts = pd.concat(heard).groupby(level=0).sum()
            told = now[now["user"].isin(counts.index)]
            yield told.assign(bucket=key[0], superseded=counts.to_numpy())[["bucket", "user", "us", "value", "superseded"]]

    def close(self) -> None:
        pass


def latest_facts(events: DataFrame) -> DataFrame:
    """A stream of each key's newest fact whenever it is heard of (STR5); a fact without a time is none."""
    bucket = F.when(F.col("user_id").isNotNull(), F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS))).otherwise(-1)
    rows = events.where("ts is not null").select(bucket.alias("bucket"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").cast("double").alias("value"))
    told = rows.groupBy("bucket").transformWithStateInPandas(LatestFact(), "bucket long, user long, us long, value double, superseded long", "Update", "None")
    return told.select(F.when(F.col("bucket") >= 0, F.col("user")).alias("user_id"), F.timestamp_micros("us").alias("ts"), "value", "superseded")

"""Streams run to the end of what is there, and taken up again where they stopped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.session import new_shared_path


class Run:
    """A stream over files that arrive little by little, with its checkpoint and results in the shared folder.

    ``transform`` makes the streaming result of the streaming input. A batch
    writes its rows to a folder of its own number and overwrites it if it
    runs again, so a batch that was lost half-way leaves no row twice.
    """

    def __init__(self, spark: SparkSession, schema, transform: Callable[[DataFrame], DataFrame], mode: str = "update"):
        self.spark, self.schema, self.transform, self.mode = spark, schema, transform, mode
        self.folder = new_shared_path(spark, "stream")

    def arrive(self, rows: DataFrame) -> None:
        """More files of input."""
        rows.select(*self.schema.names).write.mode("append").parquet(f"{self.folder}/in")

    def catch_up(self, write: Callable[[DataFrame, int], None] | None = None) -> None:
        """Start from the checkpoint, take in all files that are there, and stop."""
        rows = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in")
        out = self.transform(rows).writeStream.outputMode(self.mode).option("checkpointLocation", f"{self.folder}/checkpoint")
        out.foreachBatch(write or self.write).trigger(availableNow=True).start().awaitTermination()

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/out/batch={number}")

    def results(self, spark: SparkSession | None = None) -> DataFrame:
        """All rows that batches gave, with the ``batch``."""
        return (spark or self.spark).read.parquet(f"{self.folder}/out")


def latest(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows that updates gave for a key, those of its last batch."""
    rest = [c for c in results.columns if c not in (*keys, "batch")]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_x")).select(*keys, "_x.*")


def replay(parts: Sequence[DataFrame], transform: Callable[[DataFrame], DataFrame], mode: str = "update", settings: dict[str, str] | None = None) -> DataFrame:
    """The results of a stream that stops after each of ``parts`` and starts again from its checkpoint.

    ``settings`` hold for the stream alone, in a session of its own.
    """
    spark = parts[0].sparkSession
    own = spark
    if settings:
        own = spark.newSession()
        for name, value in {"spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"), "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), **settings}.items():
            own.conf.set(name, value)
    run = Run(own, parts[0].schema, transform, mode)
    for part in parts:
        run.arrive(part)
        run.catch_up()
    return run.results(spark)


#: What stateful processors need of a session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def thirds(events: DataFrame, ts: str = "ts") -> list[DataFrame]:
    """``events`` in three parts of equal length in time; those without a time are in none."""
    us = F.unix_micros(ts)
    span = events.agg(F.min(us).alias("low"), F.max(us).alias("high")).first()
    low, high = (span["low"], span["high"]) if span["low"] is not None else (0, 0)
    cuts = [low + (high - low) * k // 3 for k in (1, 2)]
    return [events.where(us < cuts[0]), events.where((us >= cuts[0]) & (us < cuts[1])), events.where(us >= cuts[1])]

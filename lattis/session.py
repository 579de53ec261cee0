"""Session factory and the two ways this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lattis", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use.

    On a cluster the caller brings its own session; every operator takes
    the session it finds and changes none of its settings.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LATTIS_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as an URI.

    It is the one named in ``spark.checkpoint.dir``. Only in local mode,
    where one machine is the whole cluster, an unset folder is set to a
    temporary one; elsewhere an unset folder is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lattis-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    if named.startswith("/"):
        named = "file://" + named
    if named.startswith("file:/") and not named.startswith("file:///"):
        named = "file://" + named[len("file:") :]
    return named.rstrip("/")


def new_shared_path(spark: SparkSession, kind: str) -> str:
    """A path under :func:`shared_dir` that nothing has used yet."""
    return f"{shared_dir(spark)}/lattis/{kind}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Remove what :func:`new_shared_path` has given out, once no result that reads it is needed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lattis")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` through a reliable checkpoint; any executor may be lost after it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, kind: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Columnar and compressed, so it takes less of the shared disk than a
    checkpoint; used where a result feeds more than one plan.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """``df`` dealt out by ``keys`` to the session's number of shuffle partitions, or ``least``.

    A number that is asked for is kept: small rows that stand for much work
    (a file, a shard) aren't put together by their size.
    """
    n = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)

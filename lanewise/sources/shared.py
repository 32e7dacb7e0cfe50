"""Stage outputs kept as tables in the shared folder of the cluster.

A table written there outlives any executor, so it is the way to cut a long
lineage.  The folder is that of ``spark.checkpoint.dir`` (or the one given to
``SparkContext.setCheckpointDir``); without it every function here raises, on
any master.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing = Lock(), {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that driver and executors share"
        )
    return named.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tables/{name}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes inside give the disk of their shuffles back as soon as they end.

    Spark keeps them until the driver collects garbage, so that a job of many tables
    holds all its shuffles at once.  A write is a plan of its own, which nothing runs
    again.  The setting is as before when the last write of the session ends.
    """
    key = spark.sparkContext.applicationId, id(spark._jsparkSession)
    with _lock:
        writes, before = _writing.get(key, (0, None))
        if not writes:
            before = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _writing[key] = writes + 1, before
    try:
        yield
    finally:
        with _lock:
            writes, before = _writing.pop(key)
            if writes > 1:
                _writing[key] = writes - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def saved_once(
    spark: SparkSession, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The frame of ``build``, written on first use and read back afterwards.

    What has been written is known to the session: each table is a view there.
    """
    view = "saved_" + re.sub(r"\W+", "_", name)
    if not spark.catalog.tableExists(view):
        path = table_path(spark, name)
        df = build()
        with shuffles_dropped(spark):
            df.write.mode("overwrite").parquet(path)
        spark.read.parquet(path).createOrReplaceTempView(view)
    return spark.table(view)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written under a new name and read back, its size known to Spark."""
    path = table_path(df.sparkSession, f"{name}-{uuid4().hex}")
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, columns: list[str]) -> DataFrame:
    """The frame written in buckets, one file each, and read back as a table.

    The session's catalog knows the table under a new name; dropping it leaves
    the files, which go with the shared folder.
    """
    spark = df.sparkSession
    table = f"{re.sub(r'[^0-9a-z]+', '_', name.lower())}_{uuid4().hex}"
    with shuffles_dropped(spark):
        (
            df.repartition(buckets, *columns)
            .write.bucketBy(buckets, *columns)
            .option("path", table_path(spark, table))
            .saveAsTable(table)
        )
    return spark.table(table)

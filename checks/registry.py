"""Registered queries and their SQL checks."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.inputs import prelude
from checks.sql_steps import STEPS
from checks.world import World

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
# The statements as written, without the steps they need.
BODY: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Dates, moments and lists as text, so that both engines print the same."""

    def shown(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(c, ",").alias(f.name)
        return c

    return df.select(*(shown(f) for f in df.schema))


def with_folder(spark: SparkSession) -> None:
    """A folder of the process's own where a one-process session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None and re.match(r"local(\[|$)", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lanewise-"))


def check(name: str, sql: str | None = None):
    """Register a query ``world -> DataFrame`` under a name, with its SQL."""

    def register(build: Callable[[World], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with_folder(spark)
            return plain(build(World(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            BODY[name] = sql
            SQL[name] = prelude(" ".join(sql.split()), STEPS)
        return build

    return register

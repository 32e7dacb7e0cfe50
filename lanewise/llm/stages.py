"""Tables that cut a lineage, kept in the folder the cluster shares."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are the runs of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session (``spark.checkpoint.dir``)."""
    named = spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that driver and executors share"
        )
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The written table outlives every executor: what follows never recomputes
    what came before.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a row, never null: its id and a hash of its text.

    Rows that share both are repeats of one row.  Null ids are equal to each
    other inside the struct, so that plain joins match them.
    """
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("text"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(
        text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )

"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.sources.shared import stored

ROWS_PER_SLICE = 500_000
BROADCAST_ROWS = 500_000
SALT = "_salt"
# Rows of the largest table for which a shuffle has a partition, and how much
# Spark puts into one when it merges small ones.  Keys that run on compress well:
# 16 MB of a shuffle are some hundred MB of memory when a task sorts them.
ROWS_PER_PARTITION = 250_000
PARTITION_SIZE = "16m"
# How much of a file a task reads.  Stock and lines take two to fifteen bytes a row,
# so 8 MB are up to some million rows, and the aggregates of a task fit its memory;
# of Spark's 128 MB a task would spill, and few tasks would share the work.
READ_SIZE = "8m"


def shuffles_for(spark: SparkSession, rows: int) -> None:
    """Let shuffles of the session have partitions for so many rows, and scans too.

    What a task holds is then bounded, however large the tables; Spark merges
    the partitions that turn out small.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(least, -(-rows // ROWS_PER_PARTITION))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", wanted)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_SIZE)
    spark.conf.set("spark.sql.files.maxPartitionBytes", READ_SIZE)


def slices_of(counts: DataFrame, keys: list[str], rows: Column, rows_per_slice: int) -> DataFrame:
    """Keys with more than one slice of ``rows``, and how many slices they take.

    Each listed key stands for more than ``rows_per_slice`` rows, so the list is
    shorter than all rows divided by that number.
    """
    slices = F.ceil(rows / F.lit(rows_per_slice)).cast("int")
    return counts.select(*keys, slices.alias("_slices")).where(F.col("_slices") > 1)


def hot_keys(
    df: DataFrame, keys: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """All keys with more than ``rows_per_slice`` rows and their slice count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return slices_of(counts, keys, F.col("_rows"), rows_per_slice)


def salt(
    df: DataFrame, keys: list[str], salt_on: list[str], hot: DataFrame | None
) -> DataFrame:
    """Add the slice of each row, by a hash of its ``salt_on`` columns.

    A repeated task puts a row in the same slice.  ``hot`` is a list of
    :func:`slices_of`, or None where no key has several; its size, known where
    it has been written, decides how it is joined.
    """
    if hot is None:
        return df.withColumn(SALT, F.lit(0))
    slice_of = F.pmod(F.xxhash64(*salt_on), F.col("_slices")).cast("int")
    return (
        df.join(hot, keys, "left")
        .withColumn(SALT, F.coalesce(slice_of, F.lit(0)))
        .drop("_slices")
    )


def salted_copies(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """A copy of each row for every slice of its key."""
    last = F.coalesce(F.col("_slices"), F.lit(1)) - 1
    return (
        df.join(hot, keys, "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), last)))
        .drop("_slices")
    )


def salted_join(
    many: DataFrame,
    few: DataFrame,
    keys: list[str],
    how: str,
    salt_on: list[str],
    hot: DataFrame,
) -> DataFrame:
    """Join ``many`` with ``few`` on ``keys``, the hot keys cut into slices.

    A row of ``many`` goes to one slice of its key; ``few`` is copied to all of
    them.  ``hot`` is the list of :func:`hot_keys`, which is shorter than all
    rows divided by the size of a slice.
    """
    left = salt(many, keys, salt_on, hot)
    right = salted_copies(few, keys, hot)
    return left.join(right, [*keys, SALT], how).drop(SALT)


def within_rows(
    frames: dict[str, DataFrame], most: int = BROADCAST_ROWS
) -> dict[str, bool]:
    """Whether each frame has at most ``most`` rows.

    One small job counts no further than the limit.
    """
    probes = [
        df.select(F.lit(name).alias("name")).limit(most + 1)
        for name, df in frames.items()
    ]
    counts = reduce(DataFrame.unionAll, probes).groupBy("name").count()
    sizes = {r["name"]: r["count"] for r in counts.collect()}
    return {name: sizes.get(name, 0) <= most for name in frames}


def ranked_blocks(
    df: DataFrame, order_by: str, tie: str, blocks: int, into: str = "_block"
) -> DataFrame:
    """The rows in ``blocks`` of about equal size, numbered in ascending order.

    Spark's range partitioning takes the edges from a sample of score and tie
    together, so equal and unknown scores are split by their tie.  The rows are
    written with their block: worked out twice, a sample might differ.
    """
    ranged = df.repartitionByRange(blocks, F.col(order_by).asc_nulls_last(), F.col(tie).asc())
    return stored(ranged.withColumn(into, F.spark_partition_id()), "ranked")


def running_total(
    df: DataFrame, order_by: str, tie: str, values: dict[str, str], blocks: int | None = None
) -> DataFrame:
    """Running sums in ascending order, nulls last, without sorting all rows in one task.

    Only the totals of the blocks of :func:`ranked_blocks` (as many as shuffle
    partitions unless told) are summed in one window, the rest inside each block.
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = ranked_blocks(df, order_by, tie, blocks)
    totals = placed.groupBy("_block").agg(
        *(F.sum(v).alias(f"_sum_{new}") for v, new in values.items())
    )
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_block",
        *(
            F.coalesce(F.sum(f"_sum_{new}").over(before), F.lit(0)).alias(f"_from_{new}")
            for new in values.values()
        ),
    )
    inside = (
        Window.partitionBy("_block")
        .orderBy(F.col(order_by).asc_nulls_last(), F.col(tie).asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    added: dict[str, Column] = {
        new: F.sum(v).over(inside) + F.col(f"_from_{new}") for v, new in values.items()
    }
    return (
        placed.join(F.broadcast(starts), "_block")
        .withColumns(added)
        .select(*df.columns, *values.values())
    )

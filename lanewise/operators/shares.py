"""Shares of a total and how they change between two results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import numbers


#: How many keys the one of a row stands for, in a frame of :func:`alike`.
TIMES = "_times"


def alike(df: DataFrame, key: str, fact: list[Column]) -> DataFrame:
    """The rows of one key for all keys that have the same set of facts.

    Distinct counts of the key by any of the facts need no more than these rows and
    their ``TIMES``: keys with the same facts count for the same groups.  Rows are
    shuffled once, by key; after that only distinct sets move.  The key is a new
    number; rows without a key keep it unknown and stand for none.
    """
    row = F.struct(*fact)
    sets = (
        df.where(F.col(key).isNotNull())
        .select(key, row.alias("_fact"))
        .repartition(key)
        .groupBy(key)
        .agg(F.sort_array(F.collect_set("_fact")).alias("_facts"))
        .groupBy("_facts")
        .agg(F.count(F.lit(1)).alias(TIMES))
    )
    known = sets.select(F.monotonically_increasing_id().alias(key), "_facts", TIMES)
    known = known.select(key, TIMES, F.inline("_facts"))
    without = df.where(F.col(key).isNull()).select(row.alias("_fact")).distinct()
    without = without.select(
        F.lit(None).cast("bigint").alias(key), F.lit(0).cast("bigint").alias(TIMES), "_fact.*"
    )
    return known.unionAll(without)


def distinct_counts(df: DataFrame, keys: list, value_col: str, name: str) -> DataFrame:
    """Distinct values by group, each as often as it stands for one."""
    if TIMES not in df.columns:
        return df.groupBy(*keys).agg(F.count_distinct(F.col(value_col)).alias(name))
    rows = df.select(*keys, F.col(value_col).alias("_value"), TIMES)
    groups = rows.columns[:-2]
    each = rows.groupBy(*groups, "_value").agg(F.max(TIMES).alias(TIMES))
    return each.groupBy(*groups).agg(numbers.total(TIMES).alias(name))


def _grouped(df: DataFrame, keys: list[str], value_col: str, how: str) -> DataFrame:
    if how == "nunique":
        return distinct_counts(df, keys, value_col, "value")
    if how == "sum":
        return df.groupBy(*keys).agg(numbers.total(value_col).alias("value"))
    raise ValueError(f"unknown aggregate {how!r}")


def _known(cols: list[str]) -> Column:
    """Rows without a group key belong to no group."""
    return reduce(Column.__and__, (F.col(c).isNotNull() for c in cols))


def share_of_total(
    df: DataFrame,
    group_cols: list[str],
    value_col: str,
    how: str,
    denom_cols: list[str] | None = None,
) -> DataFrame:
    """Value per group, its total and its percent of the total.

    The total is the sum of the group values, by ``denom_cols`` or over all.
    Rows are aggregated before anything else moves; the total reads the
    aggregated groups again from the same shuffle.
    """
    groups = _grouped(df.where(_known(group_cols)), group_cols, value_col, how)
    if denom_cols:
        totals = groups.groupBy(*denom_cols).agg(F.sum("value").alias("total"))
        groups = groups.join(totals, denom_cols)
    else:
        groups = groups.withColumn("total", numbers.one_value(groups, F.sum("value")))
    return groups.select(
        *group_cols,
        "value",
        "total",
        numbers.percent("value", "total").alias("percent"),
    )


def share_change(
    base: DataFrame,
    iteration: DataFrame,
    group_cols: list[str],
    value_col: str,
    how: str,
    denom_cols: list[str] | None = None,
    join: str = "inner",
) -> DataFrame:
    """Values and percents of both results and the signed change of the percent.

    With the inner join a group that only one result has is left out.
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return share_of_total(df, group_cols, value_col, how, denom_cols).select(
            *group_cols,
            F.col("value").alias(f"{prefix}_value"),
            F.col("percent").alias(f"{prefix}_percent"),
        )

    return (
        side(base, "base")
        .join(side(iteration, "iter"), group_cols, join)
        .withColumn("abs_percent_change", F.col("iter_percent") - F.col("base_percent"))
    )


def relative_change(change: DataFrame) -> DataFrame:
    """Add the absolute and the relative change of the value."""
    difference = F.col("iter_value") - F.col("base_value")
    return change.withColumns(
        {
            "change_to_baseline": difference,
            "percent_change_to_baseline": numbers.ratio(difference, "base_value"),
        }
    )

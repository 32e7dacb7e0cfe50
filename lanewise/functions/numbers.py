"""Numeric columns and one-row summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.codes import col


def zero_if_null(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


def half_even(c: str | Column, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null instead of an error when b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def percent(part: str | Column, whole: str | Column) -> Column:
    return half_even(ratio(part, whole) * 100, 4)


def total(c: str | Column) -> Column:
    """Sum in which no values at all make zero."""
    return zero_if_null(F.sum(col(c)))


def one_value(df: DataFrame, value: Column) -> Column:
    """An aggregate over all of ``df`` as a scalar: one value, whatever the size."""
    return df.agg(value.alias("one")).scalar()


def impute_mean(df: DataFrame, *fields: str) -> DataFrame:
    """Fill nulls with the column mean; a column without values stays null."""
    means = one_value(df, F.struct(*(F.avg(f).alias(f) for f in fields)))
    return df.withColumn("_means", means).select(
        *(
            F.coalesce(F.col(c).cast("double"), F.col(f"_means.{c}")).alias(c)
            if c in fields
            else F.col(c)
            for c in df.columns
        )
    )


def min_max_scale(
    df: DataFrame, fields: dict[str, str], on_constant: str = "zero"
) -> DataFrame:
    """Add ``new = (old - min) / (max - min)`` for each ``old: new`` of ``fields``.

    A constant column becomes 0 with ``on_constant='zero'`` and null with 'null'.
    """
    edges = one_value(
        df,
        F.struct(
            *(
                F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f)
                for f in fields
            )
        ),
    )

    def scaled(f: str) -> Column:
        lo, hi = F.col(f"_edges.{f}.lo"), F.col(f"_edges.{f}.hi")
        value = ratio(F.col(f) - lo, hi - lo)
        if on_constant == "zero":
            value = F.when(F.col(f).isNotNull() & (lo == hi), 0.0).otherwise(value)
        return value

    added = {new: scaled(old) for old, new in fields.items()}
    return df.withColumn("_edges", edges).withColumns(added).drop("_edges")


def weighted(terms: dict[str, float]) -> Column:
    """Sum of the columns times their weights, in the order given."""
    parts = [F.col(c) * F.lit(w) for c, w in terms.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def exact_mean(value: str | Column) -> Column:
    """Mean of amounts to six decimals, summed exactly, so in any order the same."""
    amount = col(value).cast("decimal(18,6)")
    return F.try_divide(F.sum(amount).cast("double"), F.count(amount))

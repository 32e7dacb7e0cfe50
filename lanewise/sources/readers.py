"""Sources: day-partitioned Parquet, SQL with parameters, JDBC, CSV, saved runs."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions import calendar, codes
from lanewise.sources import schemas


def scan_partition_range(
    spark: SparkSession,
    path: str,
    start,
    end,
    date_col: str = "order_placed_date",
    columns: dict[str, str] | None = None,
    schema: T.StructType | None = None,
    table: str | None = None,
) -> DataFrame:
    """Day partitions from ``start`` to ``end``, both included.

    Missing days are simply not there.  ``columns`` maps the names to read to
    the names to give.  With a ``schema``, or the name of a declared ``table``,
    nothing is inferred and a path that does not exist gives an empty frame; of
    a table, rows without its keys fail.
    """
    schema = schemas.schema(table) if table else schema
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.parquet(path)
    except AnalysisException as error:
        if schema is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    days = df.where(calendar.within_days(date_col, start, end))
    if table:
        days = schemas.required(days, table)
    if columns is None:
        return days
    return days.select(*(F.col(old).alias(new) for old, new in columns.items()))


def scan_sql(
    spark: SparkSession,
    text: str,
    params: dict | None = None,
    date_col: str | None = None,
    **frames: DataFrame,
) -> DataFrame:
    """Result of one statement with named parameters and lower-case column names."""
    df = codes.lower_names(spark.sql(text, args=params, **frames))
    return df.withColumn(date_col, F.to_date(date_col)) if date_col else df


def scan_sql_steps(
    spark: SparkSession,
    steps: dict[str, str],
    params: dict | None = None,
    **frames: DataFrame,
) -> DataFrame:
    """Result of the last of several statements, each seeing the ones before.

    A step refers to a frame or an earlier step as ``{name}``.
    """
    known, last = dict(frames), None
    for name, text in steps.items():
        asked = {k: v for k, v in known.items() if f"{{{k}}}" in text}
        named = {k: v for k, v in (params or {}).items() if f":{k}" in text}
        last = scan_sql(spark, text, named or None, **asked)
        known[name] = last
    return last


def scan_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    partition_column: str | None = None,
    lower=None,
    upper=None,
    partitions: int = 8,
    **options: str,
) -> DataFrame:
    """A query of a relational database, read in parallel ranges of one column."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if partition_column is None:
        return reader.option("query", query).load()
    return (
        reader.option("dbtable", f"({query}) q")
        .option("partitionColumn", partition_column)
        .option("lowerBound", str(lower))
        .option("upperBound", str(upper))
        .option("numPartitions", partitions)
        .load()
    )


def scan_csv_zip_list(
    spark: SparkSession, path: str, zip_col: str = "zip5"
) -> DataFrame:
    """Zip list with a header line; zips become five characters."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumn("zip5", codes.zip_from_number(zip_col))


def _of_runs(df: DataFrame, run_dates) -> DataFrame:
    wanted = F.col("run_date").isin(*[calendar.as_date(d) for d in run_dates])
    return df.where(wanted)


def scan_latest_run_files(
    spark: SparkSession, paths: list[str], run_dates, table: str = "recommendation_history"
) -> DataFrame:
    """Full recommendations of some run dates from several folders."""
    declared = schemas.schema(table)
    parts = [
        _of_runs(spark.read.schema(declared).parquet(p), run_dates).where(
            F.col("zip_count_tag") == "all"
        )
        for p in paths
    ]
    return schemas.required(reduce(DataFrame.unionByName, parts), table)


def scan_metadata_runs(
    spark: SparkSession, path: str, run_dates, schema: T.StructType
) -> DataFrame:
    """Master tables of some run dates in one partitioned read."""
    return _of_runs(spark.read.schema(schema).parquet(path), run_dates)

"""Sinks: partition replacement, history, recommendations, metrics."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.sources.shared import shuffles_dropped

# Files that a task of an unshuffled write keeps open; with more it sorts its rows.
OPEN_FILES = 8


def sink_partition_replace(
    df: DataFrame, path: str, *partition_cols: str, gather: bool = True
) -> None:
    """Write Parquet by partition; only the partitions present are replaced.

    Rows gather by partition value; adaptive execution merges small partitions
    and splits a large day over many tasks, so files come out of even size.
    Without ``gather`` a task writes the rows it has, a file for each value: right for
    a large result of few values, whose rows then do not move at all.
    """
    spark = df.sparkSession
    named, files = "spark.sql.maxConcurrentOutputFileWriters", None
    if gather:
        df = df.hint("rebalance", *partition_cols)
    else:
        files = spark.conf.get(named)
        spark.conf.set(named, OPEN_FILES)
    try:
        with shuffles_dropped(spark):
            (
                df.write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(*partition_cols)
                .parquet(path)
            )
    finally:
        if files is not None:
            spark.conf.set(named, files)


def replaced(df: DataFrame, path: str, *partition_cols: str, gather: bool = True) -> DataFrame:
    """Write like :func:`sink_partition_replace`, and read the whole table back."""
    sink_partition_replace(df, path, *partition_cols, gather=gather)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sink_replace_by_week(df: DataFrame, path: str) -> None:
    """Replace the weeks in the frame, keep all others."""
    sink_partition_replace(df, path, "week_start_date")


@dataclass(frozen=True)
class Appended:
    """What an append did: whether it wrote, in how many files, and how many rows."""

    success: bool
    chunks: int
    rows: int


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The frame, and what counts its rows while they are written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _new_runs(df: DataFrame, history: DataFrame | None, run_keys: tuple[str, ...]) -> DataFrame:
    """Rows of runs that the history does not have yet."""
    if history is None or not run_keys:
        return df
    known = history.select(*run_keys).distinct().withColumnsRenamed(
        {c: f"_known_{c}" for c in run_keys}
    )
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_known_{c}")) for c in run_keys))
    return df.join(known, same, "left_anti")


def _files(df: DataFrame | None) -> set[str]:
    return set() if df is None else set(df.inputFiles())


def sink_append_history(
    df: DataFrame, path: str, run_keys: tuple[str, ...] = ()
) -> Appended:
    """Append to a history; the first write creates it.

    With ``run_keys``, rows of a run that is there already are left out, so a
    repeated run appends nothing.  Rows are counted while they are written.
    """
    reader = df.sparkSession.read.schema(df.schema)

    def history() -> DataFrame | None:
        try:
            return reader.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    before = history()
    rows, seen = _counted(_new_runs(df, before, run_keys))
    rows.write.mode("append").parquet(path)
    return Appended(True, len(_files(history()) - _files(before)), seen.get["rows"])


def sink_append_table(
    df: DataFrame, name: str, run_keys: tuple[str, ...] = ()
) -> Appended:
    """Append to a catalog table, created on first use; like :func:`sink_append_history`."""
    spark = df.sparkSession
    before = spark.table(name) if spark.catalog.tableExists(name) else None
    old = _files(before)
    rows, seen = _counted(_new_runs(df, before, run_keys))
    rows.write.mode("append").saveAsTable(name)
    spark.catalog.refreshTable(name)
    return Appended(True, len(_files(spark.table(name)) - old), seen.get["rows"])


def with_run(
    df: DataFrame, run_at, run_name: str, zip_count: int = P.ALL_ZIPS
) -> DataFrame:
    """Add the run columns; only the sentinel count makes a full run.

    ``run_at`` is the moment of the run, as a date, a moment or a text of
    either; a date means its midnight.
    """
    tag = "all" if zip_count == P.ALL_ZIPS else "partial"
    moment = F.lit(run_at).cast("timestamp")
    return df.withColumns(
        {
            "run_dttm": moment,
            "run_date": moment.cast("date"),
            "run_name": F.lit(run_name),
            "zip_count": F.lit(int(zip_count)),
            "zip_count_tag": F.lit(tag),
        }
    )


def with_run_of_counts(df: DataFrame, run_at, run_name: str) -> DataFrame:
    """Add the run columns to rows that carry their ``zip_count``."""
    tag = F.when(F.col("zip_count") == P.ALL_ZIPS, "all").otherwise("partial")
    columns = with_run(df, run_at, run_name).drop("zip_count", "zip_count_tag").columns
    return (
        with_run(df.withColumnRenamed("zip_count", "_count"), run_at, run_name)
        .withColumn("zip_count", F.col("_count"))
        .withColumn("zip_count_tag", tag)
        .select(*columns, "zip_count", "zip_count_tag")
    )


def parameter_texts(parameters: dict) -> tuple[str, str]:
    """The names and the values of parameters as JSON texts."""
    return json.dumps(list(parameters)), json.dumps(list(parameters.values()))


def add_parameters(df: DataFrame, parameters: dict) -> DataFrame:
    """Add the names and the values of the parameters as JSON texts."""
    names, values = parameter_texts(parameters)
    return df.withColumns(
        {"parameter_names": F.lit(names), "parameter_values": F.lit(values)}
    )


def sink_zip_list(df: DataFrame, path: str) -> None:
    """Chosen zips as Parquet and as CSV, one partition for each run and count.

    The CSV is made from the Parquet files, so the frame is computed once.  Run
    again, a run replaces its own lists and leaves the others.
    """
    by = ["run_date", "run_name", "zip_count_tag", "zip_count"]
    runs = replaced(df, f"{path}/parquet", *by)
    mine = runs.join(F.broadcast(df.select(*by).distinct()), by, "left_semi")
    (
        mine.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy(*by)
        .csv(f"{path}/csv")
    )


def sink_metrics(metrics: dict[str, DataFrame], path: str) -> None:
    """One dataset per metric, by run date and count, so no pass hides another."""
    for name, df in metrics.items():
        sink_partition_replace(df, f"{path}/{name}", "run_date", "zip_count")


def sink_decision_metadata(df: DataFrame, path: str) -> None:
    """The master table before the constraints, by run date."""
    sink_partition_replace(df, path, "run_date")

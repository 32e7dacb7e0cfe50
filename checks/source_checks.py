"""Checks of sources and sinks: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import key_of
from checks.registry import check
from checks.world import RUN_DATE, World
from lanewise.sources import readers, writers
from lanewise.sources.shared import table_path


def folder(w: World, name: str) -> str:
    return table_path(w.spark, key_of(w.sf_dir, f"out/{name}"))


def _orders_by_day(w: World):
    return w.order_lines.select(
        "order_id", "order_line_id", "qty", "order_placed_date"
    )


RANGE_SQL = """
    select order_id, order_line_id as line, qty,
           cast(order_placed_date as varchar) as order_placed_date
    from order_lines
    where order_placed_date between date '2025-11-03' and date '2025-11-09'
"""
RANGE = {
    "order_id": "order_id",
    "order_line_id": "line",
    "qty": "qty",
    "order_placed_date": "order_placed_date",
}


@check("scan_partition_range", RANGE_SQL)
def scan_partition_range(w: World):
    path = folder(w, "order_lines")
    writers.sink_partition_replace(_orders_by_day(w), path, "order_placed_date")
    return readers.scan_partition_range(
        w.spark, path, "2025-11-03", "2025-11-09", columns=RANGE
    )


@check(
    "sink_partition_replace",
    """
    select cast(order_placed_date as varchar) as order_placed_date, count(*) as rows,
           cast(sum(case when order_placed_date = date '2025-11-05' then 2 * qty
                         else qty end) as bigint) as qty
    from order_lines group by all
    """,
)
def sink_partition_replace(w: World):
    path = folder(w, "replaced_days")
    rows = _orders_by_day(w)
    writers.sink_partition_replace(rows, path, "order_placed_date")
    day = F.col("order_placed_date") == F.lit("2025-11-05").cast("date")
    again = rows.where(day).withColumn("qty", F.col("qty") * 2)
    writers.sink_partition_replace(again, path, "order_placed_date")
    return (
        w.spark.read.parquet(path)
        .groupBy("order_placed_date")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("qty").alias("qty"))
    )


@check(
    "sink_append_history",
    """
    select source, 2 * count(*) as rows, count(distinct zip5) as zips
    from recommendation_history group by source
    """,
)
def sink_append_history(w: World):
    path = folder(w, "history")
    w.recommendation_history.limit(0).write.mode("overwrite").parquet(path)
    for _ in range(2):
        writers.sink_append_history(w.recommendation_history, path)
    return (
        w.spark.read.parquet(path)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("zip5").alias("zips"))
    )


@check(
    "sink_append_repeated",
    """
    select source, count(*) as rows, true as success,
           (select count(*) from recommendation_history) as first_rows,
           cast(0 as bigint) as second_rows
    from recommendation_history group by source
    """,
)
def sink_append_repeated(w: World):
    """The same runs twice: the second append finds them and writes no row."""
    path = folder(w, "history_of_runs")
    w.recommendation_history.limit(0).write.mode("overwrite").parquet(path)
    runs = ("run_dttm", "run_name", "source")
    told = [writers.sink_append_history(w.recommendation_history, path, runs) for _ in range(2)]
    return (
        w.spark.read.schema(w.recommendation_history.schema)
        .parquet(path)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumns(
            {
                "success": F.lit(all(t.success for t in told)),
                "first_rows": F.lit(told[0].rows).cast("bigint"),
                "second_rows": F.lit(told[1].rows).cast("bigint"),
            }
        )
    )


@check(
    "sink_replace_by_week",
    """
    select cast(cast(date_trunc('week', order_placed_date) as date) - 1 as varchar)
             as week_start_date, count(*) as rows
    from order_lines group by all
    """,
)
def sink_replace_by_week(w: World):
    from lanewise.operators.fidelity import with_week

    path = folder(w, "weeks")
    rows = with_week(_orders_by_day(w), "order_placed_date")
    writers.sink_replace_by_week(rows, path)
    newest = rows.where(F.col("week_start_date") >= "2025-11-09")
    writers.sink_replace_by_week(newest, path)
    return (
        w.spark.read.parquet(path)
        .groupBy("week_start_date")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _zip_list(w: World):
    path = folder(w, "zips_to_remediate")
    listed = writers.with_run(w.chosen, RUN_DATE, "default")
    writers.sink_zip_list(listed, path)
    return path


CHOSEN_SQL = f"""
    select zip5, '{RUN_DATE}' as run_date, 999999 as zip_count, 'all' as zip_count_tag
    from chosen
"""


@check("sink_file_parquet", CHOSEN_SQL)
def sink_file_parquet(w: World):
    return w.spark.read.parquet(f"{_zip_list(w)}/parquet").select(
        "zip5", "run_date", "zip_count", "zip_count_tag"
    )


@check("sink_csv", CHOSEN_SQL)
def sink_csv(w: World):
    return (
        w.spark.read.option("header", True)
        .csv(f"{_zip_list(w)}/csv")
        .select("zip5", "run_date", F.col("zip_count").cast("int"), "zip_count_tag")
    )


@check("scan_csv_zip_list", "select zip5 from chosen")
def scan_csv_zip_list(w: World):
    path = folder(w, "numbers_csv")
    numbers = w.chosen.select(F.col("zip5").cast("int").alias("zip5"))
    numbers.write.mode("overwrite").option("header", True).csv(path)
    return readers.scan_csv_zip_list(w.spark, path).select("zip5")


RUNS_SQL = """
    select cast(run_date as varchar) as run_date, final_recommendation, count(*) as rows
    from runs where final_recommendation <> 'None' group by all
"""


@check("scan_latest_run_files", RUNS_SQL)
def scan_latest_run_files(w: World):
    paths = []
    for side, wanted in (("remediate", "deactivate"), ("expand", "activate")):
        path = folder(w, f"recommended_{side}")
        rows = w.runs.where(F.col("final_recommendation") == wanted)
        tagged = rows.withColumn("zip_count_tag", F.lit("all")).unionByName(
            rows.withColumn("zip_count_tag", F.lit("partial"))
        )
        writers.sink_partition_replace(tagged, path, "run_date")
        paths.append(path)
    return (
        readers.scan_latest_run_files(w.spark, paths, ["2025-11-14", RUN_DATE])
        .groupBy("run_date", "final_recommendation")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@check(
    "sink_decision_metadata",
    """
    select cast(run_date as varchar) as run_date, zip5, active, final_recommendation
    from runs
    """,
)
def sink_decision_metadata(w: World):
    path = folder(w, "metadata")
    writers.sink_decision_metadata(w.runs, path)
    return w.spark.read.parquet(path).select(
        "run_date", "zip5", "active", "final_recommendation"
    )


@check(
    "scan_metadata_runs",
    """
    select cast(run_date as varchar) as run_date, active, count(*) as zips
    from runs where run_date = date '2025-11-14' group by all
    """,
)
def scan_metadata_runs(w: World):
    path = folder(w, "metadata_runs")
    writers.sink_decision_metadata(w.runs, path)
    return (
        readers.scan_metadata_runs(w.spark, path, ["2025-11-14"], w.runs.schema)
        .groupBy("run_date", "active")
        .agg(F.count(F.lit(1)).alias("zips"))
    )


@check(
    "sink_metric_sheets",
    f"""
    select sim_tnt, count(*) as packages, '{RUN_DATE}' as run_date, 999999 as zip_count,
           count(distinct zip5) as zips
    from spliced group by sim_tnt
    """,
)
def sink_metric_sheets(w: World):
    path = folder(w, "metrics")
    spliced = w.spliced
    counted = {
        "packages": F.count(F.lit(1)),
        "zips": F.count_distinct("zip5"),
    }
    writers.sink_metrics(
        {
            name: writers.with_run(
                spliced.groupBy("sim_tnt").agg(value.alias(name)), RUN_DATE, "default"
            )
            for name, value in counted.items()
        },
        path,
    )
    packages, zips = (w.spark.read.parquet(f"{path}/{name}") for name in counted)
    return packages.select("sim_tnt", "packages", "run_date", "zip_count").join(
        zips.select("sim_tnt", "zips"), "sim_tnt"
    )


@check(
    "scan_sql_params",
    """
    select fc_name, carrier_code, count(*) as packages,
           cast(min(cast(order_placed_ts as date)) as varchar) as first_day
    from shipments
    where cast(order_placed_ts as date) between date '2025-11-02' and date '2025-11-13'
    group by all
    """,
)
def scan_sql_params(w: World):
    text = """
        select fc_name as FC_NAME, carrier_code as CARRIER_CODE, count(*) as PACKAGES,
               cast(min(cast(order_placed_ts as date)) as string) as FIRST_DAY
        from {shipments}
        where cast(order_placed_ts as date) between cast(:start_date as date)
                                                and cast(:end_date as date)
        group by 1, 2
    """
    days = {"start_date": "2025-11-02", "end_date": "2025-11-13"}
    return readers.scan_sql(
        w.spark, text, days, date_col="first_day", shipments=w.shipments
    )


@check(
    "scan_sql_script",
    """
    select zip5, count(*) as packages, cast(sum(units) as bigint) as units from shipments
    where cast(order_placed_ts as date) >= date '2025-11-02' group by zip5
    """,
)
def scan_sql_script(w: World):
    steps = {
        "scope": """
            select zip5, units from {shipments}
            where cast(order_placed_ts as date) >= cast(:start_date as date)
        """,
        "by_zip": """
            select zip5, count(*) as packages, sum(units) as units from {scope} group by zip5
        """,
    }
    return readers.scan_sql_steps(
        w.spark, steps, {"start_date": "2025-11-02"}, shipments=w.shipments
    )

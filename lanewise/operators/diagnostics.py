"""Looking at saved recommendations: distributions, coverage, outside lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.operators.zips import distinct_zips, runs_per_zip


def none_for_null(df: DataFrame, *columns: str) -> DataFrame:
    """Null as the text 'None' in the given columns, which become text."""
    wanted = columns or df.columns
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(P.NONE)) for c in wanted}
    )


def recommendation_distribution(df: DataFrame, *by: str) -> DataFrame:
    """Distinct zips by run date, status and any reasons and decisions."""
    keys = ["run_date", "active", *by]
    return (
        none_for_null(df, *by).groupBy(*keys).agg(F.count_distinct("zip5").alias("zips"))
    )


def zip_run_counts(recommendations: DataFrame) -> DataFrame:
    """Zips and rows by the number of runs a zip was recommended in."""
    return (
        runs_per_zip(recommendations)
        .groupBy("run_count")
        .agg(
            F.count_distinct("zip5").alias("zips"),
            F.count(F.lit(1)).alias("recommendations"),
        )
    )


def rows_with_runs(recommendations: DataFrame, runs: int) -> DataFrame:
    """Recommendations of zips that appear in exactly that many runs."""
    return runs_per_zip(recommendations).where(F.col("run_count") == runs)


def daily_signal_zips(signal: DataFrame, date_col: str) -> DataFrame:
    """Distinct zips a signal covers by carrier and date."""
    return (
        signal.where(F.col("carrier_code").isNotNull())
        .groupBy("carrier_code", date_col)
        .agg(F.count_distinct("zip5").alias("zips"))
    )


def signal_coverage(metadata: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct zips with and without each signal column."""
    with_value = [
        F.struct(
            F.lit(c).alias("signal"),
            F.count_distinct(F.when(F.col(c).isNotNull(), F.col("zip5"))).alias("present"),
            F.count_distinct(F.when(F.col(c).isNull(), F.col("zip5"))).alias("missing"),
        )
        for c in columns
    ]
    return metadata.agg(F.array(*with_value).alias("rows")).select(F.inline("rows"))


def missing_signal_rows(
    metadata: DataFrame, column: str, signal: DataFrame
) -> DataFrame:
    """Raw signal rows of the zips that lack the signal in the master table."""
    lacking = distinct_zips(metadata.where(F.col(column).isNull()))
    return signal.join(lacking, "zip5", "left_semi")


FAIL_FLAGS = (
    "zip_volume_req_fail",
    "fc_switch_package_per_fail",
    "challenger_service_high",
)
SIGNALS = (
    "fc_switch_package_per",
    "daily_package_count_avg",
    "reason_code_dea",
    *(f"{c}_{what}" for what in ("unpadded_edd_dea", "act_package_count", "days_behind") for c in P.CARRIERS),
)
FINAL_REASONS = ("final_reason_dea", "final_reason_shutdown", "final_reason_backlog")


def fail_flags(
    volume_floor: float = 25,
    switch_threshold: float = 0.15,
    service_threshold: float = 0.9,
    challenger=P.CHALLENGER,
) -> dict[str, Column]:
    """1 where a limit is broken, or the service is as good as asked; else 0."""
    tests = (
        F.col("daily_package_count_avg") < volume_floor,
        F.col("fc_switch_package_per") > switch_threshold,
        F.col(f"{challenger}_unpadded_edd_dea") >= service_threshold,
    )
    return {n: F.when(test, 1).otherwise(0) for n, test in zip(FAIL_FLAGS, tests)}


def external_compare(
    external: DataFrame, metadata: DataFrame, recommendations: DataFrame, **limits
) -> DataFrame:
    """An outside zip list next to what the master table and the decisions say.

    The list keeps its own columns; each run of the master adds a row with its
    signals, the final reasons and the flags of :func:`fail_flags`, which takes
    the ``limits``.
    """
    decided = ["final_recommendation", *FINAL_REASONS, "priority_score"]
    compared = external.join(
        metadata.select("zip5", "run_date", "active", *SIGNALS), "zip5", "left"
    ).join(
        recommendations.select("zip5", "run_date", *decided), ["zip5", "run_date"], "left"
    )
    return none_for_null(
        compared, "run_date", "active", "final_recommendation"
    ).withColumns(fail_flags(**limits))


def without_decision(compared: DataFrame) -> DataFrame:
    """Rows of the comparison no decision speaks about, without the decision's columns."""
    rows = compared.where(F.col("final_recommendation") == P.NONE)
    return rows.drop(*FINAL_REASONS, "priority_score", *FAIL_FLAGS)


def external_counts(compared: DataFrame, *by: str) -> DataFrame:
    """Rows of the comparison by run date, decision and flags."""
    keys = by or ("run_date", "final_recommendation", *FAIL_FLAGS)
    return compared.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))

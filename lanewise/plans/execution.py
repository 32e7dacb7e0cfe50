"""Signals to recommended zips, and the effect of switching them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions import calendar
from lanewise.operators import whatif
from lanewise.operators.decisions import KINDS, add_current_decision, add_final_decision
from lanewise.operators.scoring import priority_score_exec
from lanewise.operators.signals import (
    fc_carrier_switch,
    last_recommendation,
    reason_backlog,
    reason_service,
    zip_daily_volume,
)
from lanewise.operators.sweep import Sweep
from lanewise.operators.zips import ranked_zips, zip_status, zips_of_counts
from lanewise.sources.readers import scan_partition_range
from lanewise.sources.shared import stored
from lanewise.sources.writers import (
    parameter_texts,
    replaced,
    sink_metrics,
    sink_partition_replace,
    sink_zip_list,
    with_run_of_counts,
)

DECISION_COLUMNS = [
    "zip5",
    "active",
    "daily_package_count_avg",
    *(
        f"{stage}_{what}"
        for stage in ("current", "last", "final")
        for what in ("recommendation", *(f"reason_{k}" for k in KINDS))
    ),
]
INFO_COLUMNS = [
    "fc_switch_package_per",
    *(
        f"{carrier}_{what}"
        for what in ("act_package_count", "unpadded_edd_dea", "days_behind")
        for carrier in P.CARRIERS
    ),
]


def decision_master(
    status: DataFrame,
    base: DataFrame,
    remediate: DataFrame,
    service: DataFrame,
    backlog: DataFrame,
    last: DataFrame,
    params: P.ExecutionParams = P.ExecutionParams(),
    expand: DataFrame | None = None,
) -> DataFrame:
    """All zips with signals, reasons and decisions, before any constraint.

    The switch share is known for active zips; with ``switch_for_inactive`` the
    inactive ones take the share of the expansion scenario.
    """
    switch = fc_carrier_switch(base, remediate).select("zip5", "fc_switch_package_per")
    switch = switch.withColumnRenamed("fc_switch_package_per", "_active_share")
    share = F.when(F.col("active") == 1, F.col("_active_share"))
    master = status.join(switch, "zip5", "left")
    if params.switch_for_inactive and expand is not None:
        opened = fc_carrier_switch(base, expand).select(
            "zip5", F.col("fc_switch_package_per").alias("_inactive_share")
        )
        master = master.join(opened, "zip5", "left")
        share = share.otherwise(F.col("_inactive_share"))
    decided = (
        master.withColumn("fc_switch_package_per", share)
        .drop("_active_share", "_inactive_share")
        .join(zip_daily_volume(base), "zip5", "left")
        .join(
            reason_service(
                service, params.service_threshold, params.minimum_service_days
            ),
            "zip5",
            "left",
        )
        .join(reason_backlog(backlog, params.backlog_threshold), "zip5", "left")
        .transform(add_current_decision)
        .join(last, "zip5", "left")
    )
    told = ["last_recommendation", *(f"last_reason_{k}" for k in KINDS)]
    return decided.fillna({c: P.NONE for c in told}).transform(add_final_decision)


def meet_constraints(
    master: DataFrame, volume_floor: float | None, switch_threshold: float | None
) -> DataFrame:
    """Zips with enough volume and few FC switches; unknown values do not pass.

    A limit of zero or none switches its rule off.
    """
    if volume_floor:
        master = master.where(F.col("daily_package_count_avg") >= volume_floor)
    if switch_threshold:
        master = master.where(F.col("fc_switch_package_per") <= switch_threshold)
    return master


def split_by_decision(master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active zips to deactivate, and inactive zips to activate."""
    final = F.col("final_recommendation")
    return (
        master.where((F.col("active") == 1) & (final == "deactivate")),
        master.where((F.col("active") == 0) & (final == "activate")),
    )


def scored_group(group: DataFrame, carrier: str, weights: dict) -> DataFrame:
    """Decision columns, score by the given carrier's measures, and the signals."""
    measures = {
        name: F.col(f"{carrier}_{name}")
        for name in ("act_package_count", "unpadded_edd_dea", "days_behind")
    }
    return priority_score_exec(group.withColumns(measures), weights).select(
        *DECISION_COLUMNS, "priority_score", *INFO_COLUMNS
    )


def zip_recommendation(
    master: DataFrame, params: P.ExecutionParams = P.ExecutionParams()
) -> tuple[DataFrame, DataFrame]:
    """Scored zips to remediate and to expand.

    ``master`` is the frame of :func:`decision_master`, best written once with
    ``sink_decision_metadata`` and read back.
    """
    allowed = meet_constraints(
        master, params.zip_volume_floor, params.fc_switch_threshold
    )
    remediate, expand = split_by_decision(allowed)
    return (
        scored_group(remediate, P.CHALLENGER, params.weights),
        scored_group(expand, P.INCUMBENT, params.weights),
    )


def run_parameters(params: P.ExecutionParams, remediated: int, expanded: int) -> dict:
    """Parameters written next to the results, under the names of the run log."""
    return {
        "REMEDIATION_ZIP_COUNT": remediated,
        "EXPANSION_ZIP_COUNT": expanded,
        "DEA_THRESHOLD": params.service_threshold,
        "DEA_LOOKBACK_DAY_COUNT": params.service_lookback_days,
        "BACKLOG_THRESHOLD": params.backlog_threshold,
        "CLEAR_DATE_THRESHOLD": params.clear_date_threshold,
        "FC_SWITCH_THRESHOLD": params.fc_switch_threshold,
        "LOOKBACK_DAY_COUNT": params.lookback_days,
    }


@dataclass(frozen=True)
class ExecutionTables:
    """What the run of a day reads, already limited to its windows."""

    base: DataFrame
    remediate: DataFrame
    expand: DataFrame
    ship_map_base: DataFrame
    ship_map_eligible: DataFrame
    service: DataFrame
    backlog: DataFrame
    proxy: DataFrame


def scan_execution_tables(
    spark: SparkSession,
    path: str,
    run_date,
    proxy: DataFrame,
    params: P.ExecutionParams = P.ExecutionParams(),
    signals: P.SignalParams = P.SignalParams(),
) -> ExecutionTables:
    """The stage tables below ``path``, each over its own window before the run day."""
    first, last = calendar.lookback_window(run_date, params.lookback_days)
    service_from, _ = calendar.lookback_window(
        run_date, params.service_lookback_days, end_offset=0
    )
    backlog_from, _ = calendar.lookback_window(
        run_date, signals.backlog_lookback_days, end_offset=0
    )

    def days(name: str, start, end, column: str, table: str | None = None) -> DataFrame:
        return scan_partition_range(spark, f"{path}/{name}", start, end, column, table=table)

    def routed(scenario: str) -> DataFrame:
        return days(
            f"simulations/{scenario}", first, last, "order_placed_date", "routing_result"
        )

    return ExecutionTables(
        base=whatif.as_base(routed("baseline")),
        remediate=routed("remediation"),
        expand=routed("expansion"),
        ship_map_base=days("smf/baseline", first, last, "shipdate", "ship_map"),
        ship_map_eligible=days("smf/expansion", first, last, "shipdate", "ship_map"),
        service=days("execution_data/unpadded_dea", service_from, last, "unpadded_edd"),
        backlog=days("execution_data/backlog", backlog_from, run_date, "date"),
        proxy=proxy,
    )


SIDES = {"remediation": "zips_to_remediate", "expansion": "zips_to_expand"}


def recommendation_history(
    spark: SparkSession, path: str, side: str, run_date, days: int
) -> DataFrame:
    """Zip lists of earlier runs, empty before the first run."""
    first, last = calendar.lookback_window(run_date, days)
    return scan_partition_range(
        spark,
        f"{path}/{SIDES[side]}/parquet",
        first,
        last,
        "run_date",
        table="recommendation_history",
    )


def run_execution(
    tables: ExecutionTables,
    path: str,
    run_at,
    params: P.ExecutionParams = P.ExecutionParams(),
) -> None:
    """The run of a day: decide, score, and write the effect of every zip count.

    Below ``path`` stand the master (``metadata``), the zip lists with their
    run, which the next days read back as history, the spliced results
    (``simulation_output``) and seven metrics, all by run date and zip count.
    Master, scores and spliced results are written first and read back by what
    follows.  A run again on the same day replaces its own partitions.
    """
    spark = tables.base.sparkSession
    run_date = calendar.as_date(str(run_at)[:10])
    _, check_date = calendar.lookback_window(run_date, params.lookback_days)
    histories = [
        recommendation_history(spark, path, side, run_date, params.history_days)
        for side in SIDES
    ]
    master = decision_master(
        zip_status(tables.ship_map_base, tables.ship_map_eligible, check_date),
        tables.base,
        tables.remediate,
        tables.service,
        tables.backlog,
        last_recommendation(*histories, run_date, params.run_name, params.history_days),
        params,
        tables.expand,
    )
    day = F.lit(run_date).cast("date")
    today = F.col("run_date") == day
    dated = master.withColumn("run_date", day)
    written = replaced(dated, f"{path}/metadata", "run_date").where(today)

    scored = {}
    wanted = {"remediation": params.remediation, "expansion": params.expansion}
    scores = zip_recommendation(written.drop("run_date"), params)
    for side, df in zip(SIDES, scores):
        kept = replaced(df.withColumn("run_date", day), f"{path}/scores/{side}", "run_date")
        kept = kept.where(today)
        size = kept.count()
        if wanted[side] and size:
            scored[side] = (kept.drop("run_date"), size)

    scenario = {"remediation": tables.remediate, "expansion": tables.expand}
    ranked = {
        side: stored(ranked_zips(df), f"ranked-{side}") for side, (df, _) in scored.items()
    }
    most = max((size for _, size in scored.values()), default=0)
    counts = [*(c for c in params.zip_counts if c <= most), P.ALL_ZIPS]
    sizes = {
        count: {side: min(size, count) for side, (_, size) in scored.items()}
        for count in counts
    }

    def of_run(df: DataFrame) -> DataFrame:
        """Run columns and parameters of rows tagged with their zip count."""
        told = [
            (count, *parameter_texts(_told(params, of_count)))
            for count, of_count in sizes.items()
        ]
        kind = "zip_count int, parameter_names string, parameter_values string"
        named = df.join(F.broadcast(spark.createDataFrame(told, kind)), "zip_count")
        return with_run_of_counts(named, run_at, params.run_name)

    swept = Sweep(tables.base, [(scenario[side], ranked[side]) for side in scored], counts)
    columns = spliced_columns(tables.base, [scenario[side] for side in scored])
    sink_partition_replace(
        of_run(swept.spliced(tables.base, columns)),
        f"{path}/simulation_output",
        "run_date",
        "zip_count",
        gather=False,
    )
    metrics = {name: of_run(df) for name, df in swept.metrics(tables.proxy).items()}
    sink_metrics(metrics, f"{path}/metrics")
    for side, df in ranked.items():
        listed = of_run(zips_of_counts(df, counts).drop("zip_rank"))
        # The count of a list is that of its zips.
        own = F.least(F.col("zip_count"), F.lit(scored[side][1])).cast("int")
        sink_zip_list(listed.withColumn("zip_count", own), f"{path}/{SIDES[side]}")


def _told(params: P.ExecutionParams, sizes: dict[str, int]) -> dict:
    return run_parameters(params, sizes.get("remediation", 0), sizes.get("expansion", 0))


def spliced_columns(base: DataFrame, scenarios: list[DataFrame]) -> list[str]:
    """Columns of a spliced result: those that baseline and scenario share."""
    known = whatif.as_scenario(base).columns
    return [c for c in scenarios[0].columns if c in known] if scenarios else known

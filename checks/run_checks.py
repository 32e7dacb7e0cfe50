"""Checks of whole runs: what they write below the shared folder, read back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.inputs import key_of
from checks.registry import BODY, check
from checks.signal_checks import rounded
from checks.sql_steps import STEPS, over, renamed
from checks.world import BACKLOG_END, END, EXECUTION, RUN_DATE, START, World
from lanewise import params as P
from lanewise.operators import fidelity
from lanewise.plans import execution, impact, planning
from lanewise.plans import fidelity as weekly
from lanewise.plans import signals as daily
from lanewise.sources.readers import scan_partition_range
from lanewise.sources.shared import table_path

FIRST_RUN, SECOND_RUN = "2025-11-14 08:00:00", f"{RUN_DATE} 06:30:00"
FEW = 3
RUN = replace(EXECUTION, expansion=True, zip_counts=(FEW, 1_000))


def once(w: World, name: str, run) -> str:
    """The folder of a run, which takes place on first use."""
    path = table_path(w.spark, key_of(w.sf_dir, f"runs/{name}"))

    def build() -> DataFrame:
        run(path)
        return w.spark.range(1)

    w.saved(f"run_{name}", build)
    return path


# --- execution: two days, the second reads what the first has written ----------
STEPS["recommendation_history_none"] = "select * from recommendation_history where false"
STEPS |= over("none", "recommendation_history", last="scored")
STEPS["recommendation_history_second"] = f"""
    select zip5, final_recommendation, timestamp '{FIRST_RUN}' as run_dttm,
           'default' as run_name, 'all' as zip_count_tag, final_reason_dea,
           final_reason_shutdown, final_reason_backlog, side as source
    from groups_none
"""
STEPS |= over("second", "recommendation_history", last="scored")


def spliced(suffix: str, most: int) -> None:
    """The spliced result of the best zips of both sides, and what follows from it."""
    picked = f"""
        select zip5 from (
          select *, row_number() over (partition by side
                                       order by priority_score desc nulls last, zip5) as place
          from scored_second)
        where place <= {most} and side = '{{side}}'
    """
    STEPS[f"off_{suffix}"] = picked.format(side="remediation")
    STEPS[f"on_{suffix}"] = picked.format(side="expansion")
    columns = (
        "order_id, tracking_number, order_placed_date, zip5, sim_fc_name, "
        "sim_carrier_code, sim_route, sim_tnt, sim_transit_cost, units"
    )
    STEPS[f"spliced_{suffix}"] = f"""
        select {columns} from routing_baseline
        where zip5 not in (select zip5 from off_{suffix})
          and zip5 not in (select zip5 from on_{suffix})
        union all
        select {columns} from routing_remediation
        where zip5 in (select zip5 from off_{suffix})
        union all
        select {columns} from routing_expansion
        where zip5 in (select zip5 from on_{suffix})
    """
    STEPS.update(over(suffix, "spliced"))


spliced("few", FEW)
spliced("all", P.ALL_ZIPS)


def of(suffix: str, text: str) -> str:
    """A statement about the spliced result, for one of the run's results."""
    names = ("spliced", "before_after", "proxy_spliced")
    return renamed(text, {n: f"{n}_{suffix}" for n in names})


def counted(text: str) -> str:
    """A statement for both zip counts."""
    return f"""
        select *, {FEW} as zip_count from ({of("few", text)})
        union all
        select *, {P.ALL_ZIPS} as zip_count from ({of("all", text)})
    """


def execution_path(w: World) -> str:
    tables = execution.ExecutionTables(
        w.base,
        w.routing("remediation"),
        w.routing("expansion"),
        w.smap(),
        w.smap("expansion"),
        w.service,
        w.backlog,
        w.wms_proxy,
    )

    def run(path: str) -> None:
        for moment in (FIRST_RUN, SECOND_RUN):
            execution.run_execution(tables, path, moment, RUN)

    return once(w, "execution", run)


DECIDED = """
    select zip5, active, current_recommendation, last_recommendation, last_reason_dea,
           final_recommendation, final_reason_dea, final_reason_shutdown,
           final_reason_backlog from {0}
"""


def decided(w: World, day: str) -> DataFrame:
    master = w.spark.read.parquet(f"{execution_path(w)}/metadata")
    return master.where(F.col("run_date") == F.lit(day).cast("date")).select(
        "zip5",
        "active",
        "current_recommendation",
        "last_recommendation",
        "last_reason_dea",
        "final_recommendation",
        "final_reason_dea",
        "final_reason_shutdown",
        "final_reason_backlog",
    )


@check("execution_run_first_day", DECIDED.format("master_none"))
def execution_run_first_day(w: World):
    return decided(w, FIRST_RUN[:10])


@check("execution_run_second_day", DECIDED.format("master_second"))
def execution_run_second_day(w: World):
    return decided(w, RUN_DATE)


LISTED = T.StructType(
    [
        T.StructField("zip5", T.StringType()),
        T.StructField("priority_score", T.DoubleType()),
        T.StructField("run_date", T.DateType()),
        T.StructField("zip_count_tag", T.StringType()),
        T.StructField("zip_count", T.LongType()),
    ]
)
LIST_SQL = """
    select '{day}' as run_date, side, zip5, round(priority_score, 6) as priority_score,
           '{tag}' as zip_count_tag, count(*) over (partition by side) as zip_count
    from (select *, row_number() over (partition by side
                      order by priority_score desc nulls last, zip5) as place
          from {scored})
    where place <= {most}
"""


@check(
    "execution_run_zip_lists",
    " union all ".join(
        LIST_SQL.format(day=day, tag=tag, scored=scored, most=most)
        for day, scored in ((FIRST_RUN[:10], "scored_none"), (RUN_DATE, "scored_second"))
        for tag, most in (("partial", FEW), ("all", P.ALL_ZIPS))
    ),
)
def execution_run_zip_lists(w: World):
    path = execution_path(w)
    both = None
    for side, name in execution.SIDES.items():
        rows = scan_partition_range(
            w.spark, f"{path}/{name}/parquet", START, RUN_DATE, "run_date", schema=LISTED
        ).select(
            "run_date",
            F.lit(side).alias("side"),
            "zip5",
            "priority_score",
            "zip_count_tag",
            "zip_count",
        )
        both = rows if both is None else both.unionAll(rows)
    return rounded(both, priority_score=6)


@check(
    "execution_run_csv",
    "select zip5 from scored_second where side = 'remediation'",
)
def execution_run_csv(w: World):
    rows = w.spark.read.option("header", True).csv(
        f"{execution_path(w)}/zips_to_remediate/csv"
    )
    today = (F.col("run_date") == RUN_DATE) & (F.col("zip_count_tag") == "all")
    return rows.where(today).select("zip5")


@check(
    "execution_run_output",
    counted("select zip5, sim_carrier_code, count(*) as packages from spliced group by all"),
)
def execution_run_output(w: World):
    final = w.spark.read.parquet(f"{execution_path(w)}/simulation_output")
    return (
        final.where(F.col("run_date") == F.lit(RUN_DATE).cast("date"))
        .groupBy("zip5", "sim_carrier_code", "zip_count")
        .agg(F.count(F.lit(1)).alias("packages"))
    )


METRICS = {
    "carrier_net_before_wms_proxy": "carrier_change",
    "carrier_net_after_wms_proxy": "carrier_change_proxy",
    "cost_saving": "cost_saving",
    "cost_saving_by_zip": "cost_by_zip",
    "fc_charge_changes": "fc_charge_change",
    "fc_flow": "fc_flow",
    "fc_carrier_flow": "fc_carrier_flow",
}
SIX = {"base_value": 6, "iter_value": 6, "cost_change": 6, "cost_saving": 6}


def cents(df: DataFrame, name: str) -> DataFrame:
    """Sums of money to six digits; shares and counts as they are."""
    if not name.startswith("cost"):
        return df
    return rounded(df, **{c: d for c, d in SIX.items() if c in df.columns})


def _register_metric(name: str, body: str):
    @check(f"execution_run_{name}", counted(BODY[body]))
    def metric(w: World):
        rows = w.spark.read.parquet(f"{execution_path(w)}/metrics/{name}")
        run = ["run_dttm", "run_date", "run_name", "zip_count_tag"]
        told = ["parameter_names", "parameter_values"]
        second = F.col("run_date") == F.lit(RUN_DATE).cast("date")
        return cents(rows.where(second).drop(*run, *told), name)


for _name, _body in METRICS.items():
    _register_metric(_name, _body)


@check(
    "execution_run_parameters",
    f"""
    select '{SECOND_RUN}' as run_dttm, 'default' as run_name, zip_count, zip_count_tag,
           '["REMEDIATION_ZIP_COUNT", "EXPANSION_ZIP_COUNT", "DEA_THRESHOLD", '
           || '"DEA_LOOKBACK_DAY_COUNT", "BACKLOG_THRESHOLD", "CLEAR_DATE_THRESHOLD", '
           || '"FC_SWITCH_THRESHOLD", "LOOKBACK_DAY_COUNT"]' as parameter_names,
           '[' || rem || ', ' || exp || ', 0.5, 7, 0.25, 1, 0.9, 7]' as parameter_values
    from (
      select {FEW} as zip_count, 'partial' as zip_count_tag,
             (select count(*) from off_few) as rem, (select count(*) from on_few) as exp
      union all
      select {P.ALL_ZIPS}, 'all', (select count(*) from off_all),
             (select count(*) from on_all))
    """,
)
def execution_run_parameters(w: World):
    rows = w.spark.read.parquet(f"{execution_path(w)}/metrics/cost_saving")
    return rows.where(F.col("run_date") == F.lit(RUN_DATE).cast("date")).select(
        "run_dttm",
        "run_name",
        "zip_count",
        "zip_count_tag",
        "parameter_names",
        "parameter_values",
    )


# --- planning -----------------------------------------------------------------
CHANGE = 2_000
PLAN = P.PlanningParams(
    remediation=True, fc_switch_threshold=0.9, package_changes=(CHANGE,)
)
STEPS["off_plan"] = f"""
    select zip5 from remediation_scores
    where carrier_switch_package_count_cumsum <= {CHANGE}
"""
STEPS["on_plan"] = f"""
    select zip5 from expansion_scores
    where carrier_switch_package_count_cumsum <= {CHANGE}
"""
STEPS["spliced_plan"] = renamed(
    STEPS["spliced_all"], {"off_all": "off_plan", "on_all": "on_plan"}
)
STEPS |= {k: v for k, v in over("plan", "spliced").items() if k not in STEPS}


def planning_path(w: World) -> str:
    tables = planning.PlanningTables(
        w.base,
        w.routing("remediation"),
        w.routing("expansion"),
        w.smap(),
        w.smap("expansion"),
        w.wms_proxy,
    )

    def run(path: str) -> None:
        for _ in range(2):  # run again: no change
            assert planning.run_planning(tables, path, "plan", PLAN) == [CHANGE]

    return once(w, "planning", run)


PLANNED = (
    "carrier_change",
    "fc_carrier_change",
    "carrier_change_proxy",
    "fc_carrier_change_proxy",
    "fc_charge_change",
)
REALISED = BODY["realised_share"]


def _register_planned(name: str):
    body = f"""
        select *, {CHANGE} as package_change, '2025-11-01' as first_date,
               '2025-11-14' as last_date, cast(0.18 as double) as target_share,
               (select realised_share from ({REALISED})) as realised_share
        from ({BODY[name]})
    """

    @check(f"planning_run_{name}", of("plan", body))
    def planned(w: World):
        return w.spark.read.parquet(f"{planning_path(w)}/metrics/{name}").drop("run_name")


for _name in PLANNED:
    _register_planned(_name)


@check(
    "planning_run_zips",
    "select 'remediation' as side, zip5 from off_plan "
    "union all select 'expansion', zip5 from on_plan",
)
def planning_run_zips(w: World):
    path, both = planning_path(w), None
    for side in ("remediation", "expansion"):
        rows = w.spark.read.schema("zip5 string").parquet(f"{path}/zips_{side}")
        rows = rows.select(F.lit(side).alias("side"), "zip5")
        both = rows if both is None else both.unionAll(rows)
    return both


# --- fidelity -----------------------------------------------------------------
def fidelity_path(w: World) -> str:
    routed = fidelity.ors_daily(w.routed_packages, START, END)

    def run(path: str) -> None:
        for moment in (FIRST_RUN, SECOND_RUN):  # the second replaces the week
            weekly.run_fidelity(w.routing(), routed, w.wms_proxy, path, moment)

    return once(w, "fidelity", run)


def _register_week(name: str):
    body = f"select *, '{SECOND_RUN}' as run_dttm from ({BODY[f'fidelity_{name}']})"

    @check(f"fidelity_run_{name}", body)
    def week(w: World):
        rows = w.spark.read.parquet(f"{fidelity_path(w)}/{name}")
        return rows.withColumn("week_start_date", F.col("week_start_date").cast("string"))


for _name in weekly.TABLES:
    _register_week(_name)


# --- signals ------------------------------------------------------------------
def signals_path(w: World) -> str:
    def run(path: str) -> None:
        tables = (
            w.service_failures,
            w.station_backlog,
            w.station_zip_a,
            w.station_zip_b,
            path,
        )
        for day in ("2025-11-10", "2025-11-17", "2025-11-17"):
            daily.run_signals(*tables, day)
        daily.run_signals(*tables, BACKLOG_END, P.SignalParams(lookback_days=30))

    return once(w, "signals", run)


@check(
    "signal_run_service",
    """
    select cast(unpadded_edd as varchar) as unpadded_edd, fc_name, carrier_code, zip5,
           on_time_count, package_count from service
    where unpadded_edd between date '2025-10-27' and date '2025-11-17'
    """,
)
def signal_run_service(w: World):
    path = f"{signals_path(w)}/unpadded_dea"
    return w.spark.read.schema(w.service.schema).parquet(path)


@check(
    "signal_run_backlog",
    """
    select cast(date as varchar) as date, dest_facility_num, zip5, days_behind, carrier_code
    from backlog where zip5 is not null
    """,
)
def signal_run_backlog(w: World):
    rows = w.spark.read.schema(w.backlog.schema).parquet(f"{signals_path(w)}/backlog")
    return rows.where(F.col("zip5").isNotNull()).select(
        "date", "dest_facility_num", "zip5", "days_behind", "carrier_code"
    )


# --- effect of an outside list ------------------------------------------------
IMPACT = {
    "carrier_change": "carrier_change",
    "carrier_change_proxy": "carrier_change_proxy",
    "cost_change": "cost_change",
    "fc_charge_change": "fc_charge_change_units",
    "fc_flow": "fc_flow_units",
    "fc_carrier_flow": "fc_carrier_flow_units",
    "tnt_change": "tnt_change",
}


def _register_impact(name: str, body: str):
    @check(f"impact_{name}", BODY[body])
    def effect(w: World):
        frames = impact.impact_metrics(
            w.base, [(w.routing("remediation"), w.chosen)], w.wms_proxy
        )
        return cents(frames[name], name)


for _name, _body in IMPACT.items():
    _register_impact(_name, _body)

"""Checks of spliced results, metrics, fidelity and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.signal_checks import rounded
from checks.sql_steps import FCS, PACKAGES, STEPS, change, proxied, share
from checks.world import END, RUN_DATE, START, World
from lanewise import params as P
from lanewise.functions import codes
from lanewise.operators import diagnostics, fidelity, shares, signals, sweep, whatif, zips
from lanewise.plans import execution, impact, planning
from lanewise.sources import writers

FINAL = [
    "order_id",
    "tracking_number",
    "zip5",
    "sim_fc_name",
    "sim_carrier_code",
    "sim_tnt",
    "sim_transit_cost",
]
SPLICED_SQL = f"select {', '.join(FINAL)} from spliced"


# --- splice -----------------------------------------------------------------
@check("splice_scenario", SPLICED_SQL)
def splice_scenario(w: World):
    return w.spliced.select(*FINAL)


@check(
    "splice_two_scenarios",
    """
    select order_id, tracking_number, zip5, sim_fc_name, sim_carrier_code
    from routing_baseline where zip5 not in (select zip5 from chosen)
      and zip5 not in (select zip5 from status where active = 0)
    union all
    select order_id, tracking_number, zip5, sim_fc_name, sim_carrier_code
    from routing_remediation where zip5 in (select zip5 from chosen)
    union all
    select order_id, tracking_number, zip5, sim_fc_name, sim_carrier_code
    from routing_expansion where zip5 in (select zip5 from status where active = 0)
    """,
)
def splice_two_scenarios(w: World):
    opened = w.status.where(F.col("active") == 0)
    choices = [
        (w.routing("remediation"), w.chosen),
        (w.routing("expansion"), opened),
    ]
    return whatif.splice_scenario(w.base, choices).select(
        "order_id", "tracking_number", "zip5", "sim_fc_name", "sim_carrier_code"
    )


@check(
    "union_all_parts",
    """
    select scenario, count(*) as rows, count(distinct zip5) as zips from (
      select 'baseline' as scenario, zip5 from routing_baseline
      union all select 'remediation', zip5 from routing_remediation
      union all select 'expansion', zip5 from routing_expansion)
    group by scenario
    """,
)
def union_all_parts(w: World):
    first, second, third = (
        w.routing(s).select(F.lit(s).alias("scenario"), "zip5")
        for s in ("baseline", "remediation", "expansion")
    )
    return (
        first.unionByName(second)
        .unionByName(third)
        .groupBy("scenario")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("zip5").alias("zips"))
    )


@check(
    "project_rename",
    """
    select order_id, tracking_number, sim_fc_name as base_fc_name,
           sim_carrier_code as base_carrier_code, sim_transit_cost as base_transit_cost,
           act_fc_name from routing_baseline
    """,
)
def project_rename(w: World):
    return whatif.as_base(w.routing()).select(
        "order_id",
        "tracking_number",
        "base_fc_name",
        "base_carrier_code",
        "base_transit_cost",
        "act_fc_name",
    )


@check(
    "join_semi_zips",
    """
    select order_id, tracking_number, zip5 from routing_remediation
    where zip5 in (select zip5 from chosen)
    """,
)
def join_semi_zips(w: World):
    return zips.scenario_of_zips(w.routing("remediation"), w.chosen).select(
        "order_id", "tracking_number", "zip5"
    )


@check(
    "join_compare_scenarios",
    """
    select order_id, tracking_number, zip5, base_fc_name, sim_fc_name, base_carrier_code,
           sim_carrier_code from before_after
    """,
)
def join_compare_scenarios(w: World):
    return signals.matched(w.base, w.spliced, "units").select(
        "order_id",
        "tracking_number",
        "zip5",
        "base_fc_name",
        "sim_fc_name",
        "base_carrier_code",
        "sim_carrier_code",
    )


# --- shares -----------------------------------------------------------------
CARRIER_SQL = change("routing_baseline", "spliced", "sim_carrier_code", PACKAGES)


@check("carrier_change", CARRIER_SQL)
def carrier_change(w: World):
    return whatif.carrier_change(w.base, w.spliced)


@check(
    "agg_share_change",
    change("routing_baseline", "spliced", "zip5, sim_carrier_code", PACKAGES, "zip5"),
)
def agg_share_change(w: World):
    return shares.share_change(
        whatif.as_scenario(w.base),
        w.spliced,
        ["zip5", "sim_carrier_code"],
        "tracking_number",
        "nunique",
        ["zip5"],
    )


@check(
    "join_share_change",
    change("routing_baseline", "spliced", "sim_route", PACKAGES),
)
def join_share_change(w: World):
    return shares.share_change(
        w.routing(), w.spliced, ["sim_route"], "tracking_number", "nunique"
    )


@check(
    "win_total_by_group",
    f"select * from ({share('base', 'zip5, base_fc_name', PACKAGES, 'zip5')})".replace(
        "sum(value) over (partition by zip5) as total",
        "cast(sum(value) over (partition by zip5) as bigint) as total",
    ),
)
def win_total_by_group(w: World):
    return shares.share_of_total(
        w.base, ["zip5", "base_fc_name"], "tracking_number", "nunique", ["zip5"]
    )


@check(
    "agg_global_total",
    f"select * from ({share('base', 'base_fc_name', 'sum(units)')})".replace(
        "sum(units) as value", "cast(sum(units) as bigint) as value"
    ).replace("sum(value) over () as total", "cast(sum(value) over () as bigint) as total"),
)
def agg_global_total(w: World):
    return shares.share_of_total(w.base, ["base_fc_name"], "units", "sum")


@check(
    "fc_carrier_change",
    change(
        "routing_baseline",
        "spliced",
        "sim_fc_name, sim_carrier_code",
        PACKAGES,
        "sim_fc_name",
    ),
)
def fc_carrier_change(w: World):
    return whatif.fc_carrier_change(w.base, w.spliced)


CHARGE = change("routing_baseline", "spliced", "sim_fc_name", "{value}")
CHARGE_SQL = f"""
    select *, iter_value - base_value as change_to_baseline,
           (iter_value - base_value) / base_value as percent_change_to_baseline
    from ({CHARGE})
"""


@check("fc_charge_change", CHARGE_SQL.format(value=PACKAGES))
def fc_charge_change(w: World):
    return whatif.fc_charge_change(w.base, w.spliced)


@check(
    "fc_charge_change_units",
    CHARGE_SQL.format(value="cast(sum(units) as bigint)"),
)
def fc_charge_change_units(w: World):
    return whatif.fc_charge_change(w.base, w.spliced, "units", "sum")


@check(
    "share_diff",
    f"""
    select sim_fc_name, percent_change_to_baseline from
    ({CHARGE_SQL.format(value=PACKAGES)})
    """,
)
def share_diff(w: World):
    return whatif.fc_charge_change(w.base, w.spliced).select(
        "sim_fc_name", "percent_change_to_baseline"
    )


@check(
    "tnt_change",
    change("routing_baseline", "spliced", "sim_tnt", PACKAGES),
)
def tnt_change(w: World):
    return whatif.tnt_change(w.base, w.spliced)


# --- proxy ------------------------------------------------------------------
PROXY_SQL = """
    select cast(order_placed_date as varchar) as order_placed_date, fc, carrier,
           package_count from {0}
"""


@check("wms_proxy", PROXY_SQL.format("proxy_base"))
def wms_proxy(w: World):
    return whatif.wms_proxy(w.routing(), w.wms_proxy)


@check(
    "join_proxy_filter",
    """
    select cast(n.order_placed_date as varchar) as order_placed_date, n.fc, n.carrier,
           n.packages, p.fdxhd_proxy, p.ontrgd_proxy
    from (select order_placed_date, sim_fc_name as fc, sim_carrier_code as carrier,
                 count(distinct tracking_number) as packages
          from routing_baseline group by all) n
    join wms_proxy p on p.fc = n.fc and p.dayofweek = dayofweek(n.order_placed_date)
      and p.proxy_carrier = n.carrier
    """,
)
def join_proxy_filter(w: World):
    rows = whatif.counted_with_proxy(w.routing(), w.wms_proxy)
    return rows.withColumnRenamed("proxy_carrier", "carrier").drop("dayofweek")


@check(
    "unpivot_carriers",
    "select carrier, sum(package_count) as package_count from proxy_base group by carrier",
)
def unpivot_carriers(w: World):
    return (
        whatif.wms_proxy(w.routing(), w.wms_proxy)
        .groupBy("carrier")
        .agg(F.sum("package_count").alias("package_count"))
    )


@check(
    "carrier_change_proxy",
    change("proxy_base", "proxy_spliced", "carrier", "sum(package_count)"),
)
def carrier_change_proxy(w: World):
    return whatif.carrier_change_proxy(w.base, w.spliced, w.wms_proxy)


@check(
    "fc_carrier_change_proxy",
    change("proxy_base", "proxy_spliced", "fc, carrier", "sum(package_count)", "fc"),
)
def fc_carrier_change_proxy(w: World):
    return whatif.fc_carrier_change_proxy(w.base, w.spliced, w.wms_proxy)


# --- cost and flow ----------------------------------------------------------
ZIP_COST_SQL = """
    select b.zip5, round(b.v, 6) as base_value, round(i.v, 6) as iter_value,
           round(i.v - b.v, 6) + 0 as cost_change
    from (select zip5, coalesce(sum(sim_transit_cost), 0) as v from routing_baseline
          group by zip5) b
    join (select zip5, coalesce(sum(sim_transit_cost), 0) as v from spliced group by zip5) i
      on i.zip5 = b.zip5
"""


@check("cost_by_zip", ZIP_COST_SQL)
def cost_by_zip(w: World):
    return rounded(
        whatif.cost_by_zip(w.base, w.spliced),
        base_value=6,
        iter_value=6,
        cost_change=6,
    )


TOTAL_COST_SQL = """
    select round((select sum(sim_transit_cost) from spliced)
                 - (select sum(sim_transit_cost) from routing_baseline), 6) as cost_saving
"""


@check("cost_saving", TOTAL_COST_SQL)
def cost_saving(w: World):
    saved = whatif.cost_saving(whatif.cost_by_zip(w.base, w.spliced))
    return rounded(saved, cost_saving=6)


@check("cost_change", TOTAL_COST_SQL)
def cost_change(w: World):
    return rounded(whatif.cost_change(w.base, w.spliced), cost_saving=6)


AGG_COST_SQL = """
    select round(base_cost, 6) as base_cost, round(iteration_cost, 6) as iteration_cost,
           round(iteration_cost - base_cost, 6) + 0 as cost_change
    from (select coalesce(sum(sim_transit_cost), 0) as base_cost from routing_baseline)
    cross join (select coalesce(sum(sim_transit_cost), 0) as iteration_cost from spliced)
"""


@check("agg_cost_change", AGG_COST_SQL)
def agg_cost_change(w: World):
    totals = whatif.cost_totals(w.base, w.spliced)
    return rounded(totals, base_cost=6, iteration_cost=6, cost_change=6)


def flow_sql(sources: str, goals: str, value: str) -> str:
    keys = f"{sources}, {goals}"
    return f"""
        select {keys}, value, percent from (
          select *, row_number() over (partition by {sources}
                                       order by value desc, {goals}) as place
          from ({share('before_after', keys, value, sources)}))
        where place <= 4
    """


FC = ("base_fc_name", "sim_fc_name")
FC_CARRIER = ("base_fc_name, base_carrier_code", "sim_fc_name, sim_carrier_code")
UNITS = "cast(sum(units) as bigint)"


@check("fc_flow", flow_sql(*FC, PACKAGES))
def fc_flow(w: World):
    return whatif.fc_flow(w.base, w.spliced)


@check("fc_carrier_flow", flow_sql(*FC_CARRIER, PACKAGES))
def fc_carrier_flow(w: World):
    return whatif.fc_carrier_flow(w.base, w.spliced)


@check("fc_flow_units", flow_sql(*FC, UNITS))
def fc_flow_units(w: World):
    return whatif.fc_flow(w.base, w.spliced, "units", "sum")


@check("fc_carrier_flow_units", flow_sql(*FC_CARRIER, UNITS))
def fc_carrier_flow_units(w: World):
    return whatif.fc_carrier_flow(w.base, w.spliced, "units", "sum")


TOP_FLOW_SQL = """
    select base_fc_name, sim_fc_name, n as value from (
      select *, row_number() over (partition by base_fc_name
                                   order by n desc, sim_fc_name) as place
      from (select base_fc_name, sim_fc_name, count(*) as n from before_after group by all))
    where place <= {0}
"""


def _top_flow(w: World, k: int):
    flow = (
        signals.matched(w.base, w.spliced, "units")
        .groupBy("base_fc_name", "sim_fc_name")
        .agg(F.count(F.lit(1)).alias("value"))
    )
    return zips.rank_within(flow, ["base_fc_name"], "value", ["sim_fc_name"], k)


@check("topk_per_group", TOP_FLOW_SQL.format(4))
def topk_per_group(w: World):
    return _top_flow(w, 4)


@check("win_cumcount_topk", TOP_FLOW_SQL.format(2))
def win_cumcount_topk(w: World):
    return _top_flow(w, 2)


@check(
    "switched_packages",
    """
    select count(distinct tracking_number) as carrier_switch_package_count from base
    where base_carrier_code = 'ONTRGD' and zip5 in (select zip5 from chosen)
    """,
)
def switched_packages(w: World):
    return whatif.switched_packages(w.base, w.chosen, "base_carrier_code")


# --- plans ------------------------------------------------------------------
@check(
    "selection_metrics",
    f"select *, '{RUN_DATE}' as run_date, 'default' as run_name, 999999 as zip_count, "
    "'all' as zip_count_tag, "
    "'[\"DEA_THRESHOLD\", \"DEA_LOOKBACK_DAY_COUNT\", \"BACKLOG_THRESHOLD\", "
    "\"CLEAR_DATE_THRESHOLD\", \"FC_SWITCH_THRESHOLD\", \"LOOKBACK_DAY_COUNT\"]' "
    "as parameter_names, '[0.9, 7, 0.5, 1, 0.15, 7]' as parameter_values "
    f"from ({CARRIER_SQL})",
)
def selection_metrics(w: World):
    told = execution.run_parameters(P.ExecutionParams(), 0, 0)
    told = {k: v for k, v in told.items() if not k.endswith("_ZIP_COUNT")}
    ranked = w.chosen.distinct().withColumn("priority_score", -F.col("zip5").cast("double"))
    choices = [(w.routing("remediation"), zips.ranked_zips(ranked))]
    shares = sweep.Sweep(w.base, choices, [P.ALL_ZIPS]).carrier_change()
    tagged = writers.with_run_of_counts(writers.add_parameters(shares, told), RUN_DATE, "default")
    return tagged.drop("run_dttm")


@check("impact_metrics", change("routing_baseline", "spliced", "sim_tnt", PACKAGES))
def impact_metrics(w: World):
    metrics = impact.impact_metrics(
        w.base, [(w.routing("remediation"), w.chosen)], w.wms_proxy
    )
    return metrics["tnt_change"]


@check(
    "agg_minmax_date",
    """
    select cast(min(order_placed_date) as varchar) as first_date,
           cast(max(order_placed_date) as varchar) as last_date from base
    """,
)
def agg_minmax_date(w: World):
    return planning.date_span(w.base)


@check(
    "realised_share",
    f"""
    select round_even(iter_percent, 1) as realised_share
    from ({CARRIER_SQL}) where sim_carrier_code = 'ONTRGD'
    """,
)
def realised_share(w: World):
    return planning.realised_share(whatif.carrier_change(w.base, w.spliced))


# --- fidelity ---------------------------------------------------------------
STEPS.update(
    {
        "routed_daily": f"""
            select cast(batch_ts - interval '4' hour as date) as date,
                   fc_name as ors_fc_name, ship_method as ors_carrier_code,
                   count(distinct cast(order_id as varchar) || '-'
                         || cast(cast(cartonization_id as int) as varchar) || '-' || fc_name
                         || '-' || ship_method) as packages
            from routed_packages
            where itemtype = 'NORMAL' and fc_name in ({FCS})
              and batch_ts between timestamp '2025-11-01' and timestamp '2025-11-14'
            group by all
        """,
        "sim_weeks": """
            select *, cast(cast(date_trunc('week', order_placed_date) as date) - 1
                           as varchar) as week_start_date
            from routing_baseline
        """,
        "sim_week": """
            select * from sim_weeks
            where week_start_date = (select max(week_start_date) from sim_weeks)
        """,
        "ors_weeks": """
            select *, cast(cast(date_trunc('week', date) as date) - 1 as varchar)
                        as week_start_date
            from routed_daily
        """,
        "ors_week": """
            select * from ors_weeks
            where week_start_date = (select max(week_start_date) from ors_weeks)
        """,
        "proxy_week": f"""
            select *, cast(cast(date_trunc('week', order_placed_date) as date) - 1
                           as varchar) as week_start_date
            from ({proxied('sim_week', 'sim_fc_name', 'sim_carrier_code')})
        """,
    }
)


def region(c: str) -> str:
    cases = " ".join(
        f"when {c} in ({', '.join(repr(fc) for fc in group)}) then '{name}'"
        for name, group in P.FC_REGIONS.items()
    )
    return f"case {cases} else 'None' end"


def fidelity_sql(ours, our_key, our_value, other, other_key, other_value, name, prefix):
    def side(source, key, value, tag):
        rows = f"(select *, trim({key}) as {name}_key from {source})"
        return f"""
            (select week_start_date, {name}_key as {name}, value as {tag}_package_count,
                    percent as {tag}_package_percent
             from ({share(rows, f'week_start_date, {key}, {name}_key', value,
                          'week_start_date')}))
        """

    return f"""
        select week_start_date, {name}, sim_package_count, sim_package_percent,
               {prefix}_package_count, {prefix}_package_percent,
               sim_package_percent - {prefix}_package_percent as abs_per_diff
        from {side(ours, our_key, our_value, 'sim')}
        left join {side(other, other_key, other_value, prefix)}
          using (week_start_date, {name})
    """


@check("ors_daily", "select * replace (cast(date as varchar) as date) from routed_daily")
def ors_daily(w: World):
    return fidelity.ors_daily(w.routed_packages, START, END)


@check(
    "agg_count_distinct_concat",
    """
    select fc_name, count(distinct cast(order_id as varchar) || '-' || ship_method) as n
    from routed_packages group by all
    """,
)
def agg_count_distinct_concat(w: World):
    key = codes.joined_key("order_id", "ship_method")
    return w.routed_packages.groupBy("fc_name").agg(F.count_distinct(key).alias("n"))


@check(
    "fidelity_carrier_before",
    fidelity_sql(
        "sim_week",
        "sim_carrier_code",
        PACKAGES,
        "ors_week",
        "ors_carrier_code",
        "cast(sum(packages) as bigint)",
        "carrier",
        "ors",
    ),
)
def fidelity_carrier_before(w: World):
    routed = fidelity.ors_daily(w.routed_packages, START, END)
    return fidelity.fidelity_carrier_before(w.routing(), routed)


AFTER_SQL = fidelity_sql(
    "proxy_week",
    "carrier",
    "sum(package_count)",
    "sim_week",
    "act_carrier_code",
    PACKAGES,
    "carrier",
    "act",
).replace("select *, trim(carrier) as carrier_key", "select *, carrier as carrier_key")


@check("fidelity_carrier_after", AFTER_SQL)
def fidelity_carrier_after(w: World):
    return fidelity.fidelity_carrier_after(w.routing(), w.wms_proxy)


STEPS["region_week"] = f"""
    select *, {region('sim_fc_name')} as sim_region, {region('act_fc_name')} as act_region
    from sim_week
"""
REGION_SQL = fidelity_sql(
    "region_week",
    "sim_region",
    PACKAGES,
    "region_week",
    "act_region",
    PACKAGES,
    "fc_region",
    "act",
)
FC_SQL = fidelity_sql(
    "sim_week", "sim_fc_name", PACKAGES, "sim_week", "act_fc_name", PACKAGES, "fc_name", "act"
)


@check("fidelity_region", REGION_SQL)
def fidelity_region(w: World):
    return fidelity.fidelity_region(w.routing())


@check("fidelity_fc", FC_SQL)
def fidelity_fc(w: World):
    return fidelity.fidelity_fc(w.routing())


@check("join_left_fidelity", f"select fc_name, abs_per_diff from ({FC_SQL})")
def join_left_fidelity(w: World):
    return fidelity.fidelity_fc(w.routing()).select("fc_name", "abs_per_diff")


@check(
    "carrier_coverage",
    f"""
    select week_start_date, trim(ors_carrier_code) as carrier,
           value as ors_package_count, percent as ors_package_percent
    from ({share('ors_weeks', 'week_start_date, ors_carrier_code',
                 'cast(sum(packages) as bigint)', 'week_start_date')})
    """,
)
def carrier_coverage(w: World):
    routed = fidelity.ors_daily(w.routed_packages, START, END)
    return fidelity.carrier_coverage(
        fidelity.with_week(routed, "date"),
        ["week_start_date", "ors_carrier_code"],
        "packages",
        "sum",
        ["week_start_date"],
        "ors_carrier_code",
        "ors",
    )


@check(
    "fc_charges",
    f"""
    select week_start_date, act_fc_name as fc_name, value as act_package_count,
           percent as act_package_percent
    from ({share('sim_weeks', 'week_start_date, act_fc_name', PACKAGES,
                 'week_start_date')})
    """,
)
def fc_charges(w: World):
    return fidelity.fc_charges(
        fidelity.with_week(w.routing(), "order_placed_date"),
        ["week_start_date", "act_fc_name"],
        "tracking_number",
        "nunique",
        ["week_start_date"],
        "act_fc_name",
        "act",
    )


@check(
    "filter_latest_week",
    "select week_start_date, count(*) as rows from sim_week group by all",
)
def filter_latest_week(w: World):
    return (
        fidelity.latest_week(w.routing(), "order_placed_date")
        .groupBy("week_start_date")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


# --- diagnostics ------------------------------------------------------------
STEPS["runs"] = """
    select *, date '2025-11-15' as run_date from master
    union all
    select *, date '2025-11-14' from master where current_recommendation <> 'ok'
"""


@check(
    "recommendation_distribution",
    """
    select cast(run_date as varchar) as run_date, active,
           coalesce(reason_code_dea, 'None') as reason_code_dea, current_recommendation,
           final_recommendation, count(distinct zip5) as zips
    from runs group by all
    """,
)
def recommendation_distribution(w: World):
    return diagnostics.recommendation_distribution(
        w.runs, "reason_code_dea", "current_recommendation", "final_recommendation"
    )


RUN_COUNT_SQL = """
    select zip5, count(distinct run_date) as run_count from runs group by zip5
"""


@check(
    "zip_run_counts",
    f"""
    select c.run_count, count(distinct r.zip5) as zips, count(*) as recommendations
    from runs r join ({RUN_COUNT_SQL}) c on c.zip5 = r.zip5 group by c.run_count
    """,
)
def zip_run_counts(w: World):
    return diagnostics.zip_run_counts(w.runs)


@check(
    "win_nunique_by_group",
    f"""
    select r.zip5, cast(r.run_date as varchar) as run_date, c.run_count
    from runs r join ({RUN_COUNT_SQL}) c on c.zip5 = r.zip5 where c.run_count = 2
    """,
)
def win_nunique_by_group(w: World):
    return diagnostics.rows_with_runs(w.runs, 2).select("zip5", "run_date", "run_count")


COVERED = ["FDXHD_unpadded_edd_dea", "ONTRGD_unpadded_edd_dea", "FDXHD_days_behind"]


@check(
    "signal_coverage",
    " union all ".join(
        f"""
        select '{c}' as signal,
               count(distinct case when {c} is not null then zip5 end) as present,
               count(distinct case when {c} is null then zip5 end) as missing
        from master
        """
        for c in COVERED
    ),
)
def signal_coverage(w: World):
    return diagnostics.signal_coverage(w.master, COVERED)


@check(
    "signal_daily_zips",
    """
    select carrier_code, cast(unpadded_edd as varchar) as unpadded_edd,
           count(distinct zip5) as zips
    from service group by all
    """,
)
def signal_daily_zips(w: World):
    return diagnostics.daily_signal_zips(w.service, "unpadded_edd")


@check(
    "signal_missing_rows",
    """
    select zip5, cast(unpadded_edd as varchar) as unpadded_edd, fc_name, carrier_code,
           package_count
    from service where zip5 in (
      select zip5 from master where ONTRGD_unpadded_edd_dea is null)
    """,
)
def signal_missing_rows(w: World):
    return diagnostics.missing_signal_rows(
        w.master, "ONTRGD_unpadded_edd_dea", w.service
    ).select("zip5", "unpadded_edd", "fc_name", "carrier_code", "package_count")


EXTERNAL_SQL = """
    select e.zip5, coalesce(cast(m.run_date as varchar), 'None') as run_date,
           coalesce(cast(m.active as varchar), 'None') as active,
           coalesce(r.final_recommendation, 'None') as final_recommendation,
           case when m.daily_package_count_avg < 25 then 1 else 0 end
             as zip_volume_req_fail,
           case when m.fc_switch_package_per > 0.15 then 1 else 0 end
             as fc_switch_package_per_fail,
           case when m.ONTRGD_unpadded_edd_dea >= 0.5 then 1 else 0 end
             as challenger_service_high
    from (select lpad(cast(zip5 as varchar), 5, '0') as zip5 from removal_zips
          union all select '99999') e
    left join runs m on m.zip5 = e.zip5
    left join (select * from runs where final_recommendation <> 'None') r
      on r.zip5 = m.zip5 and r.run_date = m.run_date
"""


def _compared(w: World):
    listed = w.removal_zips.select(
        codes.zip_pad("zip5").alias("zip5"), (F.col("zip5") * 7).alias("weekly_volume")
    )
    unknown = listed.limit(1).withColumn("zip5", F.lit("99999"))
    external = listed.unionByName(unknown.withColumn("weekly_volume", F.lit(-1)))
    decided = w.runs.where(F.col("final_recommendation") != "None").withColumn(
        "priority_score", F.lit(0.0)
    )
    return diagnostics.external_compare(
        external, w.runs, decided, service_threshold=0.5
    )


@check("external_compare", EXTERNAL_SQL)
def external_compare(w: World):
    return _compared(w).select(
        "zip5",
        "run_date",
        "active",
        "final_recommendation",
        *diagnostics.FAIL_FLAGS,
    )


OWN_SQL = """
    select lpad(cast(zip5 as varchar), 5, '0') as zip5, zip5 * 7 as weekly_volume
    from removal_zips union all select '99999', -1
"""
SIGNALS = ", ".join(f"m.{c}" for c in diagnostics.SIGNALS)
REASONS = ", ".join(f"r.{c}" for c in diagnostics.FINAL_REASONS)


@check(
    "external_compare_signals",
    f"""
    select e.zip5, e.weekly_volume, coalesce(cast(m.run_date as varchar), 'None') as run_date,
           {SIGNALS}, {REASONS}
    from ({OWN_SQL}) e
    left join runs m on m.zip5 = e.zip5
    left join (select * from runs where final_recommendation <> 'None') r
      on r.zip5 = m.zip5 and r.run_date = m.run_date
    """,
)
def external_compare_signals(w: World):
    return _compared(w).select(
        "zip5",
        "weekly_volume",
        "run_date",
        *diagnostics.SIGNALS,
        *diagnostics.FINAL_REASONS,
    )


@check(
    "external_without_decision",
    f"""
    select e.zip5, e.weekly_volume, coalesce(cast(m.run_date as varchar), 'None') as run_date,
           coalesce(cast(m.active as varchar), 'None') as active, 'None' as
           final_recommendation, {SIGNALS}
    from ({OWN_SQL}) e
    left join runs m on m.zip5 = e.zip5
    where coalesce(m.final_recommendation, 'None') = 'None'
    """,
)
def external_without_decision(w: World):
    return diagnostics.without_decision(_compared(w))


@check(
    "agg_value_counts",
    f"""
    select run_date, final_recommendation, zip_volume_req_fail,
           fc_switch_package_per_fail, challenger_service_high, count(*) as rows
    from ({EXTERNAL_SQL}) group by all
    """,
)
def agg_value_counts(w: World):
    return diagnostics.external_counts(_compared(w))


@check(
    "join_external_compare",
    f"select run_date, active, count(*) as rows from ({EXTERNAL_SQL}) group by all",
)
def join_external_compare(w: World):
    return diagnostics.external_counts(_compared(w), "run_date", "active")


@check(
    "add_parameters",
    """
    select zip5, '["A", "B"]' as parameter_names, '[0.9, 7]' as parameter_values
    from master
    """,
)
def add_parameters(w: World):
    return writers.add_parameters(w.master.select("zip5"), {"A": 0.9, "B": 7})


@check(
    "json_params",
    """
    select zip5, '["' || current_recommendation || '","' || final_recommendation || '"]'
             as decisions
    from master
    """,
)
def json_params(w: World):
    pair = F.to_json(F.array("current_recommendation", "final_recommendation"))
    return w.master.select("zip5", pair.alias("decisions"))


@check(
    "constant_columns",
    f"""
    select zip5, '{RUN_DATE} 00:00:00' as run_dttm, '{RUN_DATE}' as run_date,
           'default' as run_name, 50 as zip_count, 'partial' as zip_count_tag from master
    """,
)
def constant_columns(w: World):
    return writers.with_run(w.master.select("zip5"), RUN_DATE, "default", 50)

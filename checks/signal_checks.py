"""Checks of signals, decisions and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.world import BACKLOG_END, BACKLOG_START, END, EXECUTION, RUN_DATE, World
from lanewise import params as P
from lanewise.functions import calendar, codes, numbers
from lanewise.operators import decisions, diagnostics, scoring, shares, signals, zips
from lanewise.plans import execution, planning


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


# --- service ----------------------------------------------------------------
@check(
    "service_rate",
    "select * replace (cast(unpadded_edd as varchar) as unpadded_edd) from service",
)
def service_rate(w: World):
    return w.service


@check(
    "agg_sum_group",
    """
    select carrier_code, zip, cast(sum(total) - sum(failures) as bigint) as on_time,
           cast(sum(total) as bigint) as packages
    from service_failures group by all
    """,
)
def agg_sum_group(w: World):
    return w.service_failures.groupBy("carrier_code", "zip").agg(
        (F.sum("total") - F.sum("failures")).alias("on_time"),
        F.sum("total").alias("packages"),
    )


@check("reason_service", "select * from service_reason")
def reason_service(w: World):
    return signals.reason_service(w.service, 0.5)


@check(
    "pivot_unique",
    """
    select zip5, FDXHD_unpadded_edd_dea, FDXHD_act_package_count,
           ONTRGD_unpadded_edd_dea, ONTRGD_act_package_count from service_reason
    """,
)
def pivot_unique(w: World):
    return signals.reason_service(w.service, 0.5).drop("reason_code_dea")


@check(
    "agg_distinct_days",
    """
    select zip5, carrier_code, count(distinct unpadded_edd) as days from service
    group by all having count(distinct unpadded_edd) >= 3
    """,
)
def agg_distinct_days(w: World):
    return (
        signals.rates_over_days(w.service, 3)
        .select("zip5", "carrier_code", "days")
    )


@check(
    "agg_ratio",
    """
    select fc_name, carrier_code, sum(on_time_count) / sum(package_count) as rate
    from service group by all
    """,
)
def agg_ratio(w: World):
    return w.service.groupBy("fc_name", "carrier_code").agg(
        numbers.ratio(F.sum("on_time_count"), F.sum("package_count")).alias("rate")
    )


# --- backlog ----------------------------------------------------------------
BACKLOG_SQL = """
    select cast(date as varchar) as date, dest_facility_num, zip5, days_behind,
           carrier_code from backlog
"""


@check("zip_backlog", BACKLOG_SQL)
def zip_backlog(w: World):
    return w.backlog


@check(
    "join_coalesce_two_maps",
    """
    select carrier_code, dest_facility_num, zip5, count(*) as rows
    from backlog group by all
    """,
)
def join_coalesce_two_maps(w: World):
    return w.backlog.groupBy("carrier_code", "dest_facility_num", "zip5").agg(
        F.count(F.lit(1)).alias("rows")
    )


@check(
    "win_latest_row",
    """
    select cast(date as varchar) as date, carrier, dest_facility_num, days_behind
    from station_rows
    """,
)
def win_latest_row(w: World):
    return signals.latest_backlog(w.station_backlog, BACKLOG_START, BACKLOG_END)


@check("station_from_term", "select zip5, dest_facility_num from station_a")
def station_from_term(w: World):
    return signals.incumbent_stations(w.station_zip_a)


@check(
    "agg_latest_date_with_all",
    "select cast(date as varchar) as date from backlog_day",
)
def agg_latest_date_with_all(w: World):
    return signals.latest_date_with_all(w.backlog, "date", "carrier_code", P.CARRIERS)


@check("reason_backlog", "select * from backlog_reason")
def reason_backlog(w: World):
    return signals.reason_backlog(w.backlog, 0.25)


@check(
    "pivot_first",
    f"""
    select zip5, {', '.join(f'''arg_min(days_behind, dest_facility_num) filter
      (carrier_code = '{c}' and days_behind is not null) as {c}_days_behind'''
      for c in P.CARRIERS)}
    from (select zip5, carrier_code, dest_facility_num, max(days_behind) as days_behind
          from backlog where zip5 is not null group by all)
    group by zip5
    """,
)
def pivot_first(w: World):
    worst = w.backlog.groupBy("zip5", "carrier_code", "dest_facility_num").agg(
        F.max("days_behind").alias("days_behind")
    )
    station = F.when(F.col("days_behind").isNotNull(), F.col("dest_facility_num"))
    return signals.per_carrier(worst, {"days_behind": F.min_by("days_behind", station)})


# --- shutdown ---------------------------------------------------------------
@check(
    "filter_tomorrow",
    """
    select zip5, carrier_code, cast(end_date as varchar) as end_date
    from shutdowns where start_date = date '2025-11-15' + 1
    """,
)
def filter_tomorrow(w: World):
    return signals.starting_tomorrow(w.shutdowns, RUN_DATE).drop("start_date")


@check(
    "join_cross_carriers",
    """
    select s.zip5, c.carrier_code from (select distinct zip5 from shutdowns) s
    cross join (values ('FDXHD'), ('ONTRGD')) c(carrier_code)
    """,
)
def join_cross_carriers(w: World):
    return signals.zips_by_carrier(w.shutdowns)


SHUTDOWN_SQL = """
    select zip5, carrier_code, cast(end_date as varchar) as end_date,
           strftime(clear, '%Y-%m-%d %H:%M') as clear from shutdown_clear
"""


@check("join_left_shutdown", SHUTDOWN_SQL)
def join_left_shutdown(w: World):
    cleared = signals.shutdown_clear_dates(RUN_DATE, w.shutdowns, w.base, w.smap())
    return cleared.withColumn("clear", F.date_format("clear", "yyyy-MM-dd HH:mm"))


@check(
    "clear_date_max",
    f"select carrier_code, max(clear) as latest_clear from ({SHUTDOWN_SQL}) group by all",
)
def clear_date_max(w: World):
    cleared = signals.shutdown_clear_dates(RUN_DATE, w.shutdowns, w.base, w.smap())
    clear = F.date_format(F.max("clear"), "yyyy-MM-dd HH:mm")
    return cleared.groupBy("carrier_code").agg(clear.alias("latest_clear"))


@check(
    "reason_shutdown",
    """
    select zip5, cast(FDXHD_end_date as varchar) as FDXHD_end_date,
           cast(ONTRGD_end_date as varchar) as ONTRGD_end_date, reason_code_shutdown
    from shutdown_reason
    """,
)
def reason_shutdown(w: World):
    return signals.reason_shutdown(RUN_DATE, w.shutdowns, w.base, w.smap()).drop(
        "FDXHD_clear", "ONTRGD_clear"
    )


# --- volume, switch, transit ------------------------------------------------
@check("zip_daily_volume", "select * from volume")
def zip_daily_volume(w: World):
    return signals.zip_daily_volume(w.base)


@check("fc_carrier_switch", "select * from switch_remediation")
def fc_carrier_switch(w: World):
    return signals.fc_carrier_switch(w.base, w.routing("remediation"))


@check(
    "agg_conditional_switch",
    """
    select zip5, count(distinct case when act_fc_name <> base_fc_name
             then act_fc_name || base_fc_name || tracking_number end) as moved
    from base group by zip5
    """,
)
def agg_conditional_switch(w: World):
    moved = F.when(
        F.col("act_fc_name") != F.col("base_fc_name"),
        F.struct("act_fc_name", "base_fc_name", "tracking_number"),
    )
    return w.base.groupBy("zip5").agg(F.count_distinct(moved).alias("moved"))


@check("transit_by_carrier_dow", "select * from transit")
def transit_by_carrier_dow(w: World):
    return signals.transit_by_carrier_dow(w.base, w.smap())


@check(
    "agg_weighted_mean_fallback",
    """
    select zip5, carrier_code, round(sum(package_count * adjtnt_avg)
             / nullif(sum(package_count), 0), 6) as weighted,
           round(avg(adjtnt_avg), 6) as mean
    from transit group by all
    """,
)
def agg_weighted_mean_fallback(w: World):
    rows = signals.transit_by_carrier_dow(w.base, w.smap())
    packages = F.col("package_count")
    weighted = numbers.ratio(F.sum(packages * F.col("adjtnt_avg")), F.sum(packages))
    return rows.groupBy("zip5", "carrier_code").agg(
        F.round(weighted, 6).alias("weighted"),
        F.round(F.avg("adjtnt_avg"), 6).alias("mean"),
    )


@check(
    "join_left_transit",
    """
    select b.zip5, b.carrier_code, cast(b.date as varchar) as date, b.dest_facility_num,
           coalesce(t.weighted_adjtnt_avg, 2) as transit
    from backlog b left join transit t
      on t.day_of_week = isodow(b.date) - 1 and t.zip5 = b.zip5
     and t.carrier_code = b.carrier_code
    """,
)
def join_left_transit(w: World):
    keys = ["day_of_week", "zip5", "carrier_code"]
    average = signals.transit_by_carrier_dow(w.base, w.smap()).select(
        *keys, "weighted_adjtnt_avg"
    )
    return (
        w.backlog.withColumn("day_of_week", calendar.dow_monday0("date"))
        .join(average, keys, "left")
        .select(
            "zip5",
            "carrier_code",
            "date",
            "dest_facility_num",
            F.coalesce("weighted_adjtnt_avg", F.lit(2.0)).alias("transit"),
        )
    )


# --- history and status -----------------------------------------------------
@check("last_recommendation", "select * from last_decision")
def last_recommendation(w: World):
    return w.last


@check(
    "filter_history_window",
    """
    select zip5, cast(run_dttm as varchar) as run_dttm, run_name from recommendation_history
    where cast(run_dttm as date) >= date '2025-09-16'
      and cast(run_dttm as date) < date '2025-11-01' and zip_count_tag = 'all'
    """,
)
def filter_history_window(w: World):
    runs = signals.full_runs(w.recommendation_history, "2025-11-01", 46)
    return runs.select("zip5", "run_dttm", "run_name")


@check(
    "filter_run_name",
    """
    select source, run_name, count(*) as rows from recommendation_history
    where run_name = 'default' group by all
    """,
)
def filter_run_name(w: World):
    return (
        w.recommendation_history.where(F.col("run_name") == "default")
        .groupBy("source", "run_name")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@check(
    "agg_max_join",
    """
    select h.zip5, h.source, cast(h.run_dttm as varchar) as run_dttm
    from recommendation_history h
    join (select zip5, max(run_dttm) as run_dttm from recommendation_history group by zip5) m
      on m.zip5 = h.zip5 and m.run_dttm = h.run_dttm
    """,
)
def agg_max_join(w: World):
    newest = signals.latest_rows(w.recommendation_history, ["zip5"], "run_dttm")
    return newest.select("zip5", "source", "run_dttm")


@check("zip_status", "select * from status")
def zip_status(w: World):
    return zips.zip_status(w.smap(), w.smap("expansion"), END)


@check(
    "join_left_status",
    """
    select e.zip5, max(case when b.zip5 is null then 0 else 1 end) as active
    from smap_expansion e
    left join (select distinct zip5 from smap_baseline where mode = 'ONTRGD') b
      on b.zip5 = e.zip5
    where e.mode = 'ONTRGD' group by e.zip5
    """,
)
def join_left_status(w: World):
    return zips.zip_status(w.smap(), w.smap("expansion"))


@check(
    "filter_on_check_date",
    """
    select distinct zip5 from smap_baseline
    where mode = 'ONTRGD' and shipdate = date '2025-11-14'
    """,
)
def filter_on_check_date(w: World):
    return zips.open_zips(w.smap(), END)


# --- decisions --------------------------------------------------------------
MASTER_SQL = "select * from master"


@check("decision_master", MASTER_SQL)
def decision_master(w: World):
    return w.build_master()


@check(
    "join_left_signals",
    """
    select zip5, active, fc_switch_package_per, daily_package_count_avg, reason_code_dea,
           reason_code_backlog, last_recommendation from signals
    """,
)
def join_left_signals(w: World):
    return w.build_master().select(
        "zip5",
        "active",
        "fc_switch_package_per",
        "daily_package_count_avg",
        "reason_code_dea",
        "reason_code_backlog",
        "last_recommendation",
    )


@check(
    "current_decision",
    """
    select m.zip5,
      case when s.reason_code_shutdown in ('activate', 'deactivate')
           then s.reason_code_shutdown
           when m.reason_code_dea in ('activate', 'deactivate') then m.reason_code_dea
           when m.reason_code_backlog in ('activate', 'deactivate')
           then m.reason_code_backlog
           when 'ok' in (coalesce(m.reason_code_dea, ''),
                         coalesce(m.reason_code_backlog, ''),
                         coalesce(s.reason_code_shutdown, '')) then 'ok'
           else 'None' end as current_recommendation,
      case when coalesce(s.reason_code_shutdown, '') in ('activate', 'deactivate')
           then 'None'
           when m.reason_code_dea = 'deactivate' then 'deactivate'
           when coalesce(m.reason_code_backlog, '') in ('activate', 'deactivate')
           then 'None'
           else coalesce(m.reason_code_dea, 'None') end as current_reason_dea,
      case when s.reason_code_shutdown in ('activate', 'deactivate')
           then s.reason_code_shutdown
           when m.reason_code_dea is not null then 'None'
           when coalesce(m.reason_code_backlog, '') in ('activate', 'deactivate')
           then 'None'
           else coalesce(s.reason_code_shutdown, 'None') end as current_reason_shutdown
    from master m left join shutdown_reason s on s.zip5 = m.zip5
    """,
)
def current_decision(w: World):
    shutdown = signals.reason_shutdown(RUN_DATE, w.shutdowns, w.base, w.smap()).select(
        "zip5", "reason_code_shutdown"
    )
    reasons = w.master.select("zip5", "reason_code_dea", "reason_code_backlog")
    return (
        reasons.join(shutdown, "zip5", "left")
        .transform(decisions.add_current_decision)
        .select(
            "zip5",
            "current_recommendation",
            "current_reason_dea",
            "current_reason_shutdown",
        )
    )


FINAL = ["zip5", "active", "final_recommendation"] + [
    f"final_reason_{k}" for k in decisions.KINDS
]


@check("final_decision", f"select {', '.join(FINAL)} from master")
def final_decision(w: World):
    decided = [c for c in w.master.columns if not c.startswith("final_")]
    return decisions.add_final_decision(w.master.select(*decided)).select(*FINAL)


@check(
    "concat_columns",
    """
    select current_recommendation, last_recommendation, final_recommendation,
           count(*) as zips from master group by all
    """,
)
def concat_columns(w: World):
    return w.master.groupBy(
        "current_recommendation", "last_recommendation", "final_recommendation"
    ).agg(F.count(F.lit(1)).alias("zips"))


@check("filter_constraints", "select zip5, active, final_recommendation from allowed")
def filter_constraints(w: World):
    return execution.meet_constraints(w.master, 1, 0.9).select(
        "zip5", "active", "final_recommendation"
    )


@check("split_by_decision", "select side, zip5 from groups")
def split_by_decision(w: World):
    off, on = execution.split_by_decision(execution.meet_constraints(w.master, 1, 0.9))
    return (
        off.select(F.lit("remediation").alias("side"), "zip5")
        .unionByName(on.select(F.lit("expansion").alias("side"), "zip5"))
    )


@check(
    "zip_recommendation",
    """
    select s.side, m.zip5, m.active, m.current_recommendation, m.last_recommendation,
           m.final_recommendation, round(s.priority_score, 6) as priority_score,
           m.fc_switch_package_per, m.FDXHD_days_behind, m.ONTRGD_days_behind
    from scored s join master m on m.zip5 = s.zip5
    """,
)
def zip_recommendation(w: World):
    off, on = execution.zip_recommendation(w.master, EXECUTION)
    both = off.withColumn("side", F.lit("remediation")).unionByName(
        on.withColumn("side", F.lit("expansion"))
    )
    return rounded(both, priority_score=6).select(
        "side",
        "zip5",
        "active",
        "current_recommendation",
        "last_recommendation",
        "final_recommendation",
        "priority_score",
        "fc_switch_package_per",
        "FDXHD_days_behind",
        "ONTRGD_days_behind",
    )


# --- scores -----------------------------------------------------------------
def _measured(w: World):
    return w.master.select(
        "zip5",
        F.col("ONTRGD_act_package_count").alias("act_package_count"),
        F.col("ONTRGD_unpadded_edd_dea").alias("unpadded_edd_dea"),
        F.col("ONTRGD_days_behind").alias("days_behind"),
    )


FILLED_SQL = """
    select zip5, coalesce(ONTRGD_act_package_count, avg(ONTRGD_act_package_count) over ())
             as act_package_count,
           coalesce(ONTRGD_unpadded_edd_dea, avg(ONTRGD_unpadded_edd_dea) over ())
             as unpadded_edd_dea,
           coalesce(ONTRGD_days_behind, avg(ONTRGD_days_behind) over ()) as days_behind
    from master
"""


@check(
    "impute_mean",
    f"""
    select zip5, round(act_package_count, 6) as act_package_count,
           round(unpadded_edd_dea, 6) as unpadded_edd_dea,
           round(days_behind, 6) as days_behind
    from ({FILLED_SQL})
    """,
)
def impute_mean(w: World):
    fields = ("act_package_count", "unpadded_edd_dea", "days_behind")
    filled = numbers.impute_mean(_measured(w), *fields)
    return rounded(filled, **dict.fromkeys(fields, 6))


@check(
    "minmax_scale",
    """
    select zip5, round((daily_package_count_avg - min(daily_package_count_avg) over ())
             / (max(daily_package_count_avg) over () - min(daily_package_count_avg) over ()),
             6) as scaled
    from master
    """,
)
def minmax_scale(w: World):
    scaled = numbers.min_max_scale(w.master, {"daily_package_count_avg": "scaled"})
    return rounded(scaled.select("zip5", "scaled"), scaled=6)


def _scaled(c):
    return f"(({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()))"


PRIORITY_SQL = f"""
    select zip5, round(0.65 * {_scaled('act_package_count')}
             + 0.25 * (1 - {_scaled('unpadded_edd_dea')})
             + 0.10 * {_scaled('days_behind')}, 6) as priority_score
    from ({FILLED_SQL})
"""


@check("priority_score_exec", PRIORITY_SQL)
def priority_score_exec(w: World):
    scored = scoring.priority_score_exec(_measured(w))
    return rounded(scored.select("zip5", "priority_score"), priority_score=6)


@check(
    "weighted_score",
    """
    select zip5, round(0.7 * d + 0.2 * k + 0.1 * s, 6) as priority_score from removal_scaled
    """,
)
def weighted_score(w: World):
    scaled = numbers.min_max_scale(
        scoring.remediation_metrics(w.base),
        {"dea_per_change": "d", "cost_change": "k", "std_change": "s"},
        "null",
    )
    score = numbers.weighted({"d": 0.7, "k": 0.2, "s": 0.1})
    return scaled.select("zip5", F.round(score, 6).alias("priority_score"))


@check(
    "agg_mean_multi",
    """
    select zip5, act_carrier_code as carrier_code,
           count(distinct tracking_number) as packages,
           round(cast(sum(cast(act_transit_cost as decimal(18, 6))) as double)
                 / count(act_transit_cost), 3) as cost,
           avg(std) as std, cast(coalesce(sum(dea_flag), 0) as bigint) as on_time
    from base where std is not null and zip5 is not null group by all
    """,
)
def agg_mean_multi(w: World):
    return rounded(scoring.carrier_cells(w.base), cost=3)


SCORE_SQL = """
    select zip5, round(priority_score, 6) as priority_score, package_count,
           carrier_switch_package_count, carrier_switch_package_count_cumsum,
           round(package_count_cumsum_per, 6) as package_count_cumsum_per
    from {0}
"""
SCORE = [
    "zip5",
    "priority_score",
    "package_count",
    "carrier_switch_package_count",
    "carrier_switch_package_count_cumsum",
    "package_count_cumsum_per",
]


def _shown(scores):
    return rounded(
        scores.select(*SCORE), priority_score=6, package_count_cumsum_per=6
    )


@check("remediation_score", SCORE_SQL.format("remediation_scores"))
def remediation_score(w: World):
    return _shown(scoring.remediation_score(w.base))


@check("expansion_score", SCORE_SQL.format("expansion_scores"))
def expansion_score(w: World):
    return _shown(
        scoring.expansion_score(
            w.base, w.routing("expansion"), w.smap(), w.smap("expansion"), 0.9
        )
    )


@check(
    "join_score_parts",
    """
    select zip5, round(cost_change, 6) + 0 as cost_change, round(tnt_change, 6) + 0 as tnt_change,
           fc_switch_package_per, active
    from expansion_all
    """,
)
def join_score_parts(w: World):
    metrics = scoring.expansion_metrics(
        w.base, w.routing("expansion"), w.smap(), w.smap("expansion")
    )
    switch = signals.fc_carrier_switch(w.base, w.routing("expansion"))
    return rounded(
        metrics.join(switch, "zip5").select(
            "zip5", "cost_change", "tnt_change", "fc_switch_package_per", "active"
        ),
        cost_change=6,
        tnt_change=6,
    )


@check(
    "win_running_total",
    """
    select zip5, cast(sum(package_count) over (order by carrier_switch_package_count, zip5
             rows unbounded preceding) as bigint) as running
    from switch_remediation
    """,
)
def win_running_total(w: World):
    from lanewise.operators.skew import running_total

    switch = signals.fc_carrier_switch(w.base, w.routing("remediation"))
    return running_total(
        switch, "carrier_switch_package_count", "zip5", {"package_count": "running"}
    ).select("zip5", "running")


@check(
    "win_running_share",
    """
    select zip5, round(package_count_cumsum_per, 6) as package_count_cumsum_per
    from remediation_scores
    """,
)
def win_running_share(w: World):
    return rounded(
        w.remediation_scores.select("zip5", "package_count_cumsum_per"),
        package_count_cumsum_per=6,
    )


@check(
    "target_change",
    """
    select cast(round_even(abs(sum(n) * cast(0.18 as double)
             - sum(case when c = 'ONTRGD' then n else 0 end)), 0) as bigint)
             as package_change
    from (select base_carrier_code as c, count(distinct tracking_number) as n
          from base group by all)
    """,
)
def target_change(w: World):
    return scoring.target_change(w.base)


CUT = """
    (select cast(sum(carrier_switch_package_count) as bigint) // 2 from {0})
"""


@check(
    "cut_cumulative",
    f"""
    select zip5 from remediation_scores
    where carrier_switch_package_count_cumsum <= {CUT.format('remediation_scores')}
    """,
)
def cut_cumulative(w: World):
    scores = w.remediation_scores
    half = numbers.one_value(
        scores, F.floor(F.sum("carrier_switch_package_count") / 2)
    )
    return zips.cut_by_volume(scores, half).select("zip5")


@check(
    "select_zips_cumulative",
    f"""
    select order_id, tracking_number, zip5, sim_fc_name, sim_transit_cost
    from routing_remediation where zip5 in (
      select zip5 from remediation_scores
      where carrier_switch_package_count_cumsum <= {CUT.format('remediation_scores')})
    """,
)
def select_zips_cumulative(w: World):
    scores = w.remediation_scores
    half = numbers.one_value(
        scores, F.floor(F.sum("carrier_switch_package_count") / 2)
    )
    rows, _ = zips.select_zips_cumulative(w.routing("remediation"), scores, half)
    return rows.select(
        "order_id", "tracking_number", "zip5", "sim_fc_name", "sim_transit_cost"
    )


@check(
    "planned_zips",
    """
    select zip5 from expansion_scores
    where carrier_switch_package_count_cumsum <= (
      select round_even(abs(sum(n) * cast(0.9 as double)
               - sum(case when c = 'ONTRGD' then n else 0 end)), 0)
      from (select base_carrier_code as c, count(distinct tracking_number) as n
            from base group by all))
    """,
)
def planned_zips(w: World):
    return planning.planned_zips(w.expansion_scores, scoring.target_change(w.base, 0.9))


TOP_SQL = """
    select zip5, round(priority_score, 6) as priority_score from (
      select *, row_number() over (order by priority_score desc nulls last, zip5) as rn
      from remediation_scores)
    where rn <= 10
"""


@check("topk_zips", TOP_SQL)
def topk_zips(w: World):
    top = zips.top_zips(w.remediation_scores, 10)
    return rounded(top.select("zip5", "priority_score"), priority_score=6)


@check(
    "topk_zips_per_count",
    """
    select c.zip_count, r.zip5, r.rn as zip_rank
    from (select *, row_number() over (order by priority_score desc nulls last, zip5) as rn,
                 count(*) over () as n from remediation_scores) r
    cross join (values (5), (12), (100000), (999999)) c(zip_count)
    where r.rn <= c.zip_count and (c.zip_count <= r.n or c.zip_count = 999999)
    """,
)
def topk_zips_per_count(w: World):
    return zips.top_zips_per_count(w.remediation_scores, [5, 12, 100000]).select(
        "zip_count", "zip5", "zip_rank"
    )


@check(
    "select_zips_topn",
    f"""
    select order_id, tracking_number, zip5, sim_fc_name, sim_transit_cost
    from routing_remediation where zip5 in (select zip5 from ({TOP_SQL}))
    """,
)
def select_zips_topn(w: World):
    rows, _ = zips.select_zips_topn(w.routing("remediation"), w.remediation_scores, 10)
    return rows.select(
        "order_id", "tracking_number", "zip5", "sim_fc_name", "sim_transit_cost"
    )


@check(
    "sort_multi",
    """
    select zip5, round(priority_score, 6) as priority_score, package_count
    from remediation_scores order by package_count desc, zip5
    """,
)
def sort_multi(w: World):
    shown = w.remediation_scores.select("zip5", "priority_score", "package_count")
    return rounded(shown, priority_score=6).orderBy(F.desc("package_count"), "zip5")


@check(
    "intersect_both_carriers",
    """
    select zip5 from base where act_carrier_code = 'ONTRGD' and std is not null
    intersect
    select zip5 from base where act_carrier_code = 'FDXHD' and std is not null
    """,
)
def intersect_both_carriers(w: World):
    delivered = w.base.where(F.col("std").isNotNull())

    def of(carrier):
        return zips.distinct_zips(delivered.where(F.col("act_carrier_code") == carrier))

    return of(P.CHALLENGER).join(of(P.INCUMBENT), "zip5", "left_semi")


@check(
    "filter_not_null_delivered",
    "select act_carrier_code, count(*) as rows from base where std is not null group by all",
)
def filter_not_null_delivered(w: World):
    return (
        w.base.where(F.col("std").isNotNull())
        .groupBy("act_carrier_code")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@check(
    "flag_threshold",
    """
    select zip5, case when daily_package_count_avg < 25 then 1 else 0 end as low_volume,
           case when fc_switch_package_per > 0.15 then 1 else 0 end as many_switches,
           case when ONTRGD_unpadded_edd_dea >= 0.9 then 1 else 0 end as good_service
    from master
    """,
)
def flag_threshold(w: World):
    low, many, good = diagnostics.fail_flags().values()
    return w.master.select(
        "zip5",
        low.alias("low_volume"),
        many.alias("many_switches"),
        good.alias("good_service"),
    )


@check(
    "fill_null_literal",
    """
    select zip5, coalesce(reason_code_dea, 'None') as reason_code_dea,
           coalesce(reason_code_backlog, 'None') as reason_code_backlog,
           coalesce(ONTRGD_days_behind, 0) as ONTRGD_days_behind
    from master
    """,
)
def fill_null_literal(w: World):
    return (
        w.master.select(
            "zip5", "reason_code_dea", "reason_code_backlog", "ONTRGD_days_behind"
        )
        .fillna(P.NONE, ["reason_code_dea", "reason_code_backlog"])
        .fillna(0.0, ["ONTRGD_days_behind"])
    )


@check(
    "agg_share_of_total",
    """
    select base_fc_name, base_carrier_code, n as value,
           cast(sum(n) over (partition by base_fc_name) as bigint) as total,
           round_even(n / sum(n) over (partition by base_fc_name) * 100, 4) as percent
    from (select base_fc_name, base_carrier_code, count(distinct tracking_number) as n
          from base group by all)
    """,
)
def agg_share_of_total(w: World):
    return shares.share_of_total(
        w.base,
        ["base_fc_name", "base_carrier_code"],
        "tracking_number",
        "nunique",
        ["base_fc_name"],
    )


@check("zip3", "select substr(zip5, 1, 3) as zip3, count(*) as lanes from ship_map_raw group by all")
def zip3(w: World):
    return w.ship_map_raw.groupBy(codes.zip3("zip5").alias("zip3")).agg(
        F.count(F.lit(1)).alias("lanes")
    )

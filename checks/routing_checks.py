"""Checks of ship maps, stock, rates and lanes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks.registry import check
from checks.sql_steps import FCS
from checks.world import END, START, World
from lanewise.functions import calendar, codes, package
from lanewise.operators import lanes, rates, shipmap, stock
from lanewise.operators.signals import latest_rows

SMAP_SQL = """
    select cast(shipdate as varchar) as shipdate, fcname, zip5, mode, routeid, zone, cutoff,
           tnt, adjtnt, nextadjtnt
    from smap_{0}
"""
ROUTING_SQL = """
    select order_id, tracking_number, zip5, cast(order_placed_date as varchar) as
           order_placed_date, sim_fc_name, sim_carrier_code, sim_route, sim_transit_cost,
           sim_tnt_penalty, sim_zone, sim_tnt, cost_neutral_fc, act_fc_name,
           act_carrier_code, act_route, act_transit_cost,
           cast(ship_date as varchar) as ship_date, units, cast(ctd as int) as ctd,
           cast(std as int) as std, dea_flag
    from routing_{0}
"""


# --- ship maps --------------------------------------------------------------
@check("ship_map", SMAP_SQL.format("baseline"))
def ship_map(w: World):
    return w.build_smap("baseline")


@check("ship_map_single_carrier", SMAP_SQL.format("remediation"))
def ship_map_single_carrier(w: World):
    return w.build_smap("remediation")


@check("ship_map_expanded", SMAP_SQL.format("expansion"))
def ship_map_expanded(w: World):
    return w.build_smap("expansion")


@check("ship_map_custom", SMAP_SQL.format("custom"))
def ship_map_custom(w: World):
    return w.build_smap("custom")


@check(
    "win_latest_snapshot",
    """
    select cast(ship_date as varchar) as ship_date, fc, zip5, mode, routeid,
           cast(generate_date as varchar) as generate_date
    from (select *, max(generate_date) over (partition by ship_date, fc, zip5) as newest
          from ship_map_raw)
    where generate_date = newest
    """,
)
def win_latest_snapshot(w: World):
    columns = ["ship_date", "fc", "zip5", "mode", "routeid", "generate_date"]
    rows = w.ship_map_raw.select(*columns)
    return shipmap.latest_snapshot(rows, ["ship_date", "fc", "zip5"], "generate_date")


@check(
    "win_max_by_group",
    """
    select zip5, final_recommendation, cast(run_dttm as varchar) as run_dttm
    from (select *, max(run_dttm) over (partition by zip5) as newest
          from recommendation_history)
    where run_dttm = newest
    """,
)
def win_max_by_group(w: World):
    newest = latest_rows(w.recommendation_history, ["zip5"], "run_dttm")
    return newest.select("zip5", "final_recommendation", "run_dttm")


@check(
    "union_distinct",
    """
    select cast(shipdate as varchar) as shipdate, fcname, zip5, mode, routeid, zone
    from smap_baseline
    union
    select cast(shipdate as varchar), fcname, zip5, mode, routeid, zone from eligible_lanes
    """,
)
def union_distinct(w: World):
    columns = ["shipdate", "fcname", "zip5", "mode", "routeid", "zone"]
    return (
        w.smap().select(*columns).union(w.eligible_lanes.select(*columns)).distinct()
    )


@check(
    "join_left_anti_list",
    """
    select count(*) as lanes, count(distinct zip5) as zips from smap_baseline m
    where not exists (select 1 from removal_zips r
                      where lpad(cast(r.zip5 as varchar), 5, '0') = m.zip5)
    """,
)
def join_left_anti_list(w: World):
    gone = w.removal_zips.select(codes.zip_pad("zip5").alias("zip5"))
    return (
        w.smap()
        .join(gone, "zip5", "left_anti")
        .agg(F.count(F.lit(1)).alias("lanes"), F.count_distinct("zip5").alias("zips"))
    )


# --- stock ------------------------------------------------------------------
@check(
    "fulfillable_fcs",
    """
    select order_id, cast(order_placed_ts as varchar) as order_placed_ts, zip5,
           tracking_number, fc_name from candidates
    """,
)
def fulfillable_fcs(w: World):
    return w.build_candidates()


@check(
    "relational_division",
    "select distinct order_id, tracking_number, fc_name from candidates",
)
def relational_division(w: World):
    stocked = stock.stocked_lines(w.order_lines, w.inventory, START, END)
    packages = stock.shipped_packages(w.shipments, START, END)
    return stock.qualified_fcs(stocked).join(
        packages, stock.PACKAGE, "left_semi"
    )


@check(
    "win_distinct_count",
    """
    select order_id, tracking_number, fc_name, count(distinct order_line_id) as fc_lines,
           any_value(all_lines) as all_lines
    from stocked join (select order_id, tracking_number,
                              count(distinct order_line_id) as all_lines
                       from stocked group by all) using (order_id, tracking_number)
    group by order_id, tracking_number, fc_name
    """,
)
def win_distinct_count(w: World):
    packages = stock.shipped_packages(w.shipments, START, END)
    stocked = stock.stocked_lines(w.order_lines, w.inventory, START, END).join(
        packages, stock.PACKAGE, "left_semi"
    )
    line = F.col("order_line_id")
    by_fc = stocked.groupBy(*stock.PACKAGE, "fc_name").agg(
        F.count_distinct(line).alias("fc_lines")
    )
    by_package = stocked.groupBy(*stock.PACKAGE).agg(
        F.count_distinct(line).alias("all_lines")
    )
    return by_fc.join(by_package, stock.PACKAGE)


@check(
    "join_inner_multi",
    """
    select s.order_id, s.tracking_number, s.zip5, l.order_line_id, l.qty
    from shipments s join order_lines l
      on s.order_id = l.order_id and s.tracking_number = l.tracking_number
    """,
)
def join_inner_multi(w: World):
    return w.shipments.join(w.order_lines, stock.PACKAGE).select(
        *stock.PACKAGE, "zip5", "order_line_id", "qty"
    )


STOCK_SQL = """
    select l.order_id, l.tracking_number, l.order_line_id, i.fc_name
    from order_lines l join inventory i
      on i.order_id = l.order_id and i.order_line_id = l.order_line_id
     and i.quantity_available >= l.qty
"""


@check("join_inner_stock", STOCK_SQL)
def join_inner_stock(w: World):
    return stock.stocked_lines(w.order_lines, w.inventory, START, END)


@check(
    "filter_stock",
    f"select fc_name, count(*) as stocked_lines from ({STOCK_SQL}) group by fc_name",
)
def filter_stock(w: World):
    stocked = stock.stocked_lines(w.order_lines, w.inventory, START, END)
    return stocked.groupBy("fc_name").agg(F.count(F.lit(1)).alias("stocked_lines"))


@check(
    "join_package_facts",
    """
    select c.order_id, c.tracking_number, c.fc_name, p.weight, p.units,
           p.fc_name as act_fc_name
    from candidates c join shipments p
      on p.order_id = c.order_id and p.tracking_number = c.tracking_number
    """,
)
def join_package_facts(w: World):
    facts = w.shipments.select(
        *stock.PACKAGE, "weight", "units", F.col("fc_name").alias("act_fc_name")
    )
    return w.candidates.join(facts, stock.PACKAGE).select(
        *stock.PACKAGE, "fc_name", "weight", "units", "act_fc_name"
    )


LANE_JOIN_SQL = """
    select c.order_id, c.tracking_number, c.fc_name, m.mode, m.routeid, m.zone,
           cast(split_part(m.cutoff, ':', 1) as int) * 3600
             + cast(split_part(m.cutoff, ':', 2) as int) * 60
             + cast(split_part(m.cutoff, ':', 3) as int) as cutoff_seconds
    from candidates c join smap_baseline m
      on m.zip5 = c.zip5 and m.fcname = c.fc_name
     and m.shipdate = cast(c.order_placed_ts as date)
"""


def _open(w: World, routes):
    return lanes.package_lanes(w.lane_stage, routes)


@check("join_lane", LANE_JOIN_SQL)
def join_lane(w: World):
    open_lanes = _open(w, lanes.open_routes(w.smap()))
    return open_lanes.select(
        *stock.PACKAGE, "fc_name", "mode", "routeid", "zone", "cutoff_seconds"
    )


@check(
    "join_dedup_side",
    """
    select c.order_id, c.tracking_number, c.fc_name, m.mode, m.zone
    from candidates c
    join (select distinct shipdate, fcname, zip5, mode, zone from smap_baseline) m
      on m.zip5 = c.zip5 and m.fcname = c.fc_name
     and m.shipdate = cast(c.order_placed_ts as date)
    """,
)
def join_dedup_side(w: World):
    return _open(w, lanes.priced_zones(w.smap())).select(
        *stock.PACKAGE, "fc_name", "mode", F.col("cost_zone").alias("zone")
    )


# --- package columns --------------------------------------------------------
def _facts(w: World):
    return w.shipments.withColumn("ship_date", F.to_date("actual_ship_ts"))


@check(
    "package_dims",
    """
    select order_id, tracking_number, longest_side, second_side, third_side,
           length_plus_girth, cast(dim_weight as bigint) as dim_weight,
           cast(bill_weight as bigint) as bill_weight,
           cast(charged_weight as bigint) as charged_weight
    from dims
    """,
)
def package_dims(w: World):
    return rates.package_dims(_facts(w)).select(
        *stock.PACKAGE,
        "longest_side",
        "second_side",
        "third_side",
        "length_plus_girth",
        "dim_weight",
        "bill_weight",
        "charged_weight",
    )


SIDES = {
    "longest_side": (package.longest_side, "longest_side"),
    "middle_of_three": (package.second_side, "second_side"),
    "third_side": (package.third_side, "third_side"),
    "dim_weight": (package.dim_weight, "cast(dim_weight as bigint)"),
    "bill_weight": (package.bill_weight, "cast(bill_weight as bigint)"),
}


def _register_side(name, build, text):
    @check(name, f"select order_id, tracking_number, {text} as {name} from dims")
    def side(w: World):
        return _facts(w).select(*stock.PACKAGE, build().alias(name))


for _name, (_build, _text) in SIDES.items():
    _register_side(_name, _build, _text)


@check(
    "length_plus_girth",
    "select order_id, tracking_number, length_plus_girth from dims",
)
def length_plus_girth(w: World):
    girth = package.length_plus_girth(
        package.longest_side(), package.second_side(), package.third_side()
    )
    return _facts(w).select(*stock.PACKAGE, girth.alias("length_plus_girth"))


@check(
    "bill_weight_rules",
    """
    select cast(bill_weight as bigint) as bill_weight,
           cast(charged_weight as bigint) as charged_weight, count(*) as packages
    from dims group by all
    """,
)
def bill_weight_rules(w: World):
    return (
        rates.package_dims(_facts(w))
        .groupBy("bill_weight", "charged_weight")
        .agg(F.count(F.lit(1)).alias("packages"))
    )


# --- rates ------------------------------------------------------------------
COST_LANE = ["order_id", "tracking_number", "fc_name", "mode", "cost_zone"]


def _cost_lanes(w: World):
    """Lanes with what prices them, as the library makes them."""

    def build():
        measures = lanes.candidate_packages(w.candidates, w.shipments)
        measures = measures.select(*stock.PACKAGE, *lanes.PRICED_BY).distinct()
        open_lanes = lanes.package_lanes(w.lane_stage, lanes.priced_zones(w.smap()))
        open_lanes = open_lanes.select(*COST_LANE, *lanes.LANE_KEYS)
        return open_lanes.join(measures, stock.PACKAGE)

    return w.saved("cost_lanes", build)


def _register_card(name, join, card, column):
    @check(
        name,
        f"select order_id, tracking_number, fc_name, mode, zone as cost_zone, {column} "
        "from charges_baseline",
    )
    def attach(w: World):
        return join(_cost_lanes(w), w.cards.side(card)).select(*COST_LANE, column)


for _args in (
    ("join_base_rate", rates.join_base_rate, "base_rates", "base_rate"),
    ("join_resi", rates.join_resi, "resi", "resi_amount"),
    ("join_das", rates.join_das, "das", "das_amount"),
    ("join_weight_band", rates.join_weight_band, "weight_bands", "heavy_amount"),
    ("join_longest_band", rates.join_longest_band, "longest_bands", "long_amount"),
    ("join_second_band", rates.join_second_band, "second_bands", "second_amount"),
    ("join_girth_band", rates.join_girth_band, "girth_bands", "girth_amount"),
    ("join_peak", rates.join_peak, "peak", "peak_amount"),
    ("join_fuel", rates.join_fuel, "fuel", "fuel_amount"),
):
    _register_card(*_args)


@check(
    "handling_class",
    """
    select order_id, tracking_number, fc_name, mode, zone as cost_zone, handling_class,
           cast(case when handling_class is null then 0 else top_amount end as double)
             as handling_amount
    from classed_baseline
    """,
)
def handling_class(w: World):
    return rates.with_charges(_cost_lanes(w), w.cards).select(
        *COST_LANE, "handling_class", "handling_amount"
    )


COST_SQL = """
    select order_id, tracking_number, fc_name, mode, zone, total_amount
    from costs_baseline
"""


@check("lane_cost", COST_SQL)
def lane_cost(w: World):
    return lanes.lane_cost(w.lane_stage, w.smap())


@check(
    "total_amount",
    """
    select mode, zone, count(*) as lanes, count(total_amount) as priced,
           round(sum(total_amount), 6) as total_amount
    from costs_baseline group by all
    """,
)
def total_amount(w: World):
    return (
        lanes.lane_cost(w.lane_stage, w.smap())
        .groupBy("mode", "zone")
        .agg(
            F.count(F.lit(1)).alias("lanes"),
            F.count("total_amount").alias("priced"),
            F.round(F.sum("total_amount"), 6).alias("total_amount"),
        )
    )


# --- lanes ------------------------------------------------------------------
def _costs(w: World):
    return w.saved("costs", lambda: lanes.lane_cost(w.lane_stage, w.smap()))


def _options(w: World):
    return lanes.lane_options(w.lane_stage, w.smap(), w.fc_zip_distance)


def _ranked(w: World):
    return lanes.ranked_options(w.lane_stage, w.smap(), w.fc_zip_distance)


@check(
    "choose_lane",
    """
    select order_id, tracking_number, zip5, cast(order_placed_date as varchar) as
           order_placed_date, fc_name, mode as carrier_code, routeid, zone, total_amount,
           tnt_penalty, tnt, distance
    from ranked_baseline where row_n = 1
    """,
)
def choose_lane(w: World):
    return lanes.choose_lane(w.lane_stage, w.smap(), w.fc_zip_distance)


@check(
    "win_rank_lane",
    """
    select order_id, tracking_number, fc_name, mode, routeid, cast(row_n as int) as row_n
    from ranked_baseline
    """,
)
def win_rank_lane(w: World):
    return _ranked(w).select(
        *stock.PACKAGE, "fc_name", "mode", "routeid", "row_n"
    )


@check(
    "win_conditional_max",
    """
    select order_id, tracking_number, fc_name, mode, routeid, cost, selected_cost
    from ranked_baseline
    """,
)
def win_conditional_max(w: World):
    return _ranked(w).select(
        *stock.PACKAGE, "fc_name", "mode", "routeid", "cost", "selected_cost"
    )


@check("cost_neutral_fcs", "select * from neutral_baseline")
def cost_neutral_fcs(w: World):
    return lanes.cost_neutral_fcs(w.lane_stage, w.smap(), w.fc_zip_distance)


@check(
    "win_array_agg",
    """
    select zip5, string_agg(distinct fc_name, ',' order by fc_name) as fcs
    from candidates group by zip5
    """,
)
def win_array_agg(w: World):
    return w.candidates.groupBy("zip5").agg(
        F.array_sort(F.collect_set("fc_name")).alias("fcs")
    )


@check(
    "join_distance",
    """
    select cast(m.shipdate as varchar) as shipdate, m.fcname as fc_name, m.zip5, m.mode,
           coalesce(g.dist_miles, 10000) as distance
    from smap_baseline m left join fc_zip_distance g
      on g.postcode = m.zip5 and g.fc_name = m.fcname
    """,
)
def join_distance(w: World):
    rows = w.smap().select("shipdate", F.col("fcname").alias("fc_name"), "zip5", "mode")
    return lanes.attach_distance(rows, w.fc_zip_distance).select(
        "shipdate", "fc_name", "zip5", "mode", "distance"
    )


@check(
    "join_lane_cost",
    """
    select order_id, tracking_number, fc_name, mode, routeid, total_amount
    from options_baseline
    """,
)
def join_lane_cost(w: World):
    return _options(w).select(
        *stock.PACKAGE, "fc_name", "mode", "routeid", "total_amount"
    )


@check(
    "join_actual_cost",
    """
    select p.order_id, p.tracking_number, p.fc_name, p.carrier_code, k.total_amount
    from shipments p left join costs_baseline k
      on k.order_id = p.order_id and k.tracking_number = p.tracking_number
     and k.fc_name = p.fc_name and k.mode = p.carrier_code
    """,
)
def join_actual_cost(w: World):
    return lanes.actual_cost(w.shipments, _costs(w))


@check(
    "join_cost_neutral",
    """
    select w.order_id, w.tracking_number, w.fc_name, n.cost_neutral_fc
    from ranked_baseline w left join neutral_baseline n
      on n.order_id = w.order_id and n.tracking_number = w.tracking_number
    where w.row_n = 1
    """,
)
def join_cost_neutral(w: World):
    tables = w.lane_stage, w.smap(), w.fc_zip_distance
    winners = lanes.choose_lane(*tables).select(*stock.PACKAGE, "fc_name")
    return winners.join(lanes.cost_neutral_fcs(*tables), stock.PACKAGE, "left")


@check("routing_result", ROUTING_SQL.format("baseline"))
def routing_result(w: World):
    """With the package stage written anew each time."""
    return _routed(w, w.shipments, w.cards)


@check("routing_result_remediation", ROUTING_SQL.format("remediation"))
def routing_result_remediation(w: World):
    return w.build_routing("remediation")


@check("routing_result_expansion", ROUTING_SQL.format("expansion"))
def routing_result_expansion(w: World):
    return w.build_routing("expansion")


def _routed(w: World, shipments, cards):
    stage = w.build_routing_stage(shipments, cards)
    return lanes.routing_result(stage, w.smap(), w.fc_zip_distance)


@check("routing_result_two_shipments", ROUTING_SQL.format("baseline_again"))
def routing_result_two_shipments(w: World):
    """A third of the packages have a second shipment row from another FC."""
    return _routed(w, w.shipments_again, w.cards)


@check("routing_result_overlapping_cards", ROUTING_SQL.format("baseline_two"))
def routing_result_overlapping_cards(w: World):
    """Bands and residential rates that overlap on some days, and lack others."""
    cards = replace(w.cards, longest_bands=w.longest_bands_two, resi=w.resi_two)
    return _routed(w, w.shipments, cards)


@check(
    "lane_cost_two_shipments",
    """
    select order_id, tracking_number, fc_name, mode, zone, total_amount
    from costs_baseline_again
    """,
)
def lane_cost_two_shipments(w: World):
    packages = lanes.candidate_packages(w.candidates, w.shipments_again)
    stage = lanes.lane_stage(packages, w.shipments_again, w.cards, "again")
    return lanes.lane_cost(stage, w.smap())


# --- lane columns -----------------------------------------------------------
@check(
    "cutoff_normalize",
    """
    select distinct cutoff as raw_cutoff,
      substr(d, 1, 2) || ':' || substr(d, 3, 2) || ':' || substr(d, 5, 2) as cutoff
    from (select cutoff, lpad(cast(cutoff - case when cutoff >= 240000 then 240000 else 0
                 end as varchar), 6, '0') as d from ship_map_raw)
    """,
)
def cutoff_normalize(w: World):
    return w.ship_map_raw.select(
        F.col("cutoff").alias("raw_cutoff"),
        calendar.wrapped_clock("cutoff").alias("cutoff"),
    ).distinct()


@check(
    "cutoff_transit",
    "select order_id, tracking_number, fc_name, mode, routeid, tnt from options_baseline",
)
def cutoff_transit(w: World):
    return _options(w).select(*stock.PACKAGE, "fc_name", "mode", "routeid", "tnt")


@check(
    "step_penalty",
    """
    select tnt, any_value(tnt_penalty) as tnt_penalty, count(*) as lanes
    from ranked_baseline group by tnt
    """,
)
def step_penalty(w: World):
    return (
        _options(w)
        .groupBy("tnt", package.transit_penalty("tnt").alias("tnt_penalty"))
        .agg(F.count(F.lit(1)).alias("lanes"))
    )


@check(
    "transit_floor",
    """
    select cast(shipdate as varchar) as shipdate, fcname, zip5, mode, adjtnt,
           greatest(adjtnt, 2) as adjtnt_floor
    from smap_baseline where adjtnt >= 1
    """,
)
def transit_floor(w: World):
    return w.smap().select(
        "shipdate",
        "fcname",
        "zip5",
        "mode",
        "adjtnt",
        package.transit_floor("adjtnt").alias("adjtnt_floor"),
    )


@check(
    "fc_type",
    """
    select fc_name, case when fc_name in ('AVP2', 'BNA1', 'HOU1', 'MCI1', 'RNO1') then 1
           else 0 end as fc_type, count(*) as packages
    from shipments group by all
    """,
)
def fc_type(w: World):
    return w.shipments.groupBy(
        "fc_name", codes.fc_preference("fc_name").alias("fc_type")
    ).agg(F.count(F.lit(1)).alias("packages"))


@check(
    "dea_flag",
    """
    select order_id, tracking_number,
           case when first_attempt_ts is null then null
                when promised_date >= cast(first_attempt_ts as date) then 1 else 0
           end as dea_flag
    from shipments
    """,
)
def dea_flag(w: World):
    flag = package.on_time_flag("promised_date", "first_attempt_ts")
    return w.shipments.select(*stock.PACKAGE, flag.alias("dea_flag"))


@check(
    "filter_in_list",
    f"""
    select fc, mode, count(*) as lanes from ship_map_raw
    where fc in ({FCS}) and mode in ('FDXHD') and item_type = 'N' group by all
    """,
)
def filter_in_list(w: World):
    from lanewise import params as P

    return (
        shipmap.scoped(w.ship_map_raw, START, END, modes=[P.INCUMBENT])
        .groupBy("fc", "mode")
        .agg(F.count(F.lit(1)).alias("lanes"))
    )

"""Effect of switching chosen zips: spliced results, shares, flows and costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions import calendar, numbers
from lanewise.operators.shares import (
    alike,
    distinct_counts,
    relative_change,
    share_change,
    share_of_total,
)
from lanewise.operators.signals import matched
from lanewise.operators.zips import distinct_zips, rank_within

PROXY_RATES = {"FDXHD": "fdxhd_proxy", "ONTRGD": "ontrgd_proxy"}


def _renamed(df: DataFrame, old: str, new: str, more: dict[str, str]) -> DataFrame:
    names = {c: new + c[len(old) :] for c in df.columns if c.startswith(old)}
    return df.withColumnsRenamed({**names, **more})


def as_base(routing: DataFrame) -> DataFrame:
    """Routing result with its chosen lane named ``base_*``."""
    neutral = {"cost_neutral_fc": "base_cost_neutral_fc"}
    return _renamed(routing, "sim_", "base_", neutral)


def as_scenario(base: DataFrame) -> DataFrame:
    """The way back: the baseline lane named ``sim_*``."""
    neutral = {"base_cost_neutral_fc": "cost_neutral_fc"}
    return _renamed(base, "base_", "sim_", neutral)


def scenario_of(lists: list[DataFrame]) -> DataFrame:
    """``zip5, choices``: the numbers of the lists that have a zip, one row a zip."""
    named = [
        distinct_zips(zips).withColumn("choice", F.lit(k)) for k, zips in enumerate(lists)
    ]
    every = reduce(DataFrame.unionAll, named)
    return every.groupBy("zip5").agg(F.collect_set("choice").alias("choices"))


def splice_scenario(
    base: DataFrame, choices: list[tuple[DataFrame, DataFrame]]
) -> DataFrame:
    """Baseline with the rows of chosen zips replaced by a scenario's rows.

    ``choices`` pairs a scenario with its zips; a zip of several lists has the
    rows of each of their scenarios, and none of the baseline.  Each side is
    joined once with one table of all zips.
    """
    if not choices:
        return as_scenario(base)
    chosen = scenario_of([zips for _, zips in choices])
    out = as_scenario(base.join(chosen, "zip5", "left_anti"))
    out = out.select(*(c for c in choices[0][0].columns if c in out.columns))
    for k, (scenario, _) in enumerate(choices):
        own = chosen.where(F.array_contains("choices", k))
        out = out.unionByName(scenario.join(own, "zip5", "left_semi").select(*out.columns))
    return out


def with_proxy(counted: DataFrame, proxy: DataFrame) -> DataFrame:
    """Counted packages with the proxy rates of their weekday, FC and carrier."""
    day = calendar.dow_sunday0("order_placed_date")
    return counted.withColumn("dayofweek", day).join(proxy, ["dayofweek", "fc", "proxy_carrier"])


def moved_by_proxy(
    counted: DataFrame, rates: dict[str, str] = PROXY_RATES, by: tuple[str, ...] = ()
) -> DataFrame:
    """Packages by day, FC and carrier after the move, from counted ones with rates."""
    moved = {
        carrier: numbers.half_even(F.col("packages") * F.col(rate))
        for carrier, rate in rates.items()
    }
    keys = [*by, "order_placed_date", "fc"]
    return (
        counted.groupBy(*keys)
        .agg(*(numbers.total(v).alias(c) for c, v in moved.items()))
        .unpivot(keys, list(rates), "carrier", "package_count")
    )


def counted_with_proxy(routing: DataFrame, proxy: DataFrame) -> DataFrame:
    """Packages by day, FC and carrier with the proxy rates of the weekday.

    Packages are counted before they meet the proxy table.
    """
    known = F.col("sim_fc_name").isNotNull() & F.col("sim_carrier_code").isNotNull()
    keys = [
        F.col("order_placed_date"),
        F.col("sim_fc_name").alias("fc"),
        F.col("sim_carrier_code").alias("proxy_carrier"),
    ]
    counted = distinct_counts(routing.where(known), keys, "tracking_number", "packages")
    return with_proxy(counted, proxy)


def wms_proxy(
    routing: DataFrame, proxy: DataFrame, rates: dict[str, str] = PROXY_RATES
) -> DataFrame:
    """Packages by day, FC and carrier after the warehouse has moved its usual part."""
    return moved_by_proxy(counted_with_proxy(routing, proxy), rates)


def lanes_alike(result: DataFrame) -> DataFrame:
    """Day, FC and carrier of the packages of a result, tracking numbers alike as one.

    What the operators here count by any of the three comes out the same from it.
    """
    fact = ("order_placed_date", "sim_fc_name", "sim_carrier_code")
    return alike(as_scenario(result), "tracking_number", [F.col(c) for c in fact])


def carrier_change(base: DataFrame, iteration: DataFrame) -> DataFrame:
    """Network share of the carriers before the proxy."""
    return share_change(
        as_scenario(base), iteration, ["sim_carrier_code"], "tracking_number", "nunique"
    )


def fc_carrier_change(base: DataFrame, iteration: DataFrame) -> DataFrame:
    """Share of the carriers within each FC before the proxy."""
    return share_change(
        as_scenario(base),
        iteration,
        ["sim_fc_name", "sim_carrier_code"],
        "tracking_number",
        "nunique",
        ["sim_fc_name"],
    )


def carrier_change_proxy(
    base: DataFrame, iteration: DataFrame, proxy: DataFrame
) -> DataFrame:
    """Network share of the carriers after the proxy."""
    return share_change(
        wms_proxy(as_scenario(base), proxy),
        wms_proxy(iteration, proxy),
        ["carrier"],
        "package_count",
        "sum",
    )


def fc_carrier_change_proxy(
    base: DataFrame, iteration: DataFrame, proxy: DataFrame
) -> DataFrame:
    """Share of the carriers within each FC after the proxy."""
    return share_change(
        wms_proxy(as_scenario(base), proxy),
        wms_proxy(iteration, proxy),
        ["fc", "carrier"],
        "package_count",
        "sum",
        ["fc"],
    )


def cost_by_zip(base: DataFrame, iteration: DataFrame) -> DataFrame:
    """Transit cost of each zip in both results and the difference."""
    change = share_change(
        as_scenario(base), iteration, ["zip5"], "sim_transit_cost", "sum"
    )
    return change.select(
        "zip5",
        "base_value",
        "iter_value",
        (F.col("iter_value") - F.col("base_value")).alias("cost_change"),
    )


def cost_saving(by_zip: DataFrame) -> DataFrame:
    """Sum of the cost changes over the zips of both results."""
    return by_zip.agg(numbers.total("cost_change").alias("cost_saving"))


def cost_totals(base: DataFrame, iteration: DataFrame) -> DataFrame:
    """Grand totals of the transit cost of both results and their difference, one row."""
    before = numbers.one_value(base, numbers.total("base_transit_cost"))
    totals = iteration.agg(numbers.total("sim_transit_cost").alias("iteration_cost"))
    return totals.withColumn("base_cost", before).select(
        "base_cost",
        "iteration_cost",
        (F.col("iteration_cost") - F.col("base_cost")).alias("cost_change"),
    )


def cost_change(base: DataFrame, iteration: DataFrame) -> DataFrame:
    """Difference of the grand totals, one row."""
    change = cost_totals(base, iteration)
    return change.select(F.col("cost_change").alias("cost_saving"))


def fc_charge_change(
    base: DataFrame,
    iteration: DataFrame,
    value_col: str = "tracking_number",
    how: str = "nunique",
) -> DataFrame:
    """Share of the FCs with absolute and relative change."""
    change = share_change(
        as_scenario(base), iteration, ["sim_fc_name"], value_col, how
    )
    return relative_change(change)


def tnt_change(base: DataFrame, iteration: DataFrame) -> DataFrame:
    """Distribution of the transit days in both results."""
    return share_change(
        as_scenario(base), iteration, ["sim_tnt"], "tracking_number", "nunique"
    )


def _flow(
    base: DataFrame,
    iteration: DataFrame,
    attributes: list[str],
    value_col: str,
    how: str,
    targets: int,
) -> DataFrame:
    more_keys = ["units"] if value_col == "units" else []
    sources = [f"base_{a}" for a in attributes]
    goals = [f"sim_{a}" for a in attributes]
    flow = share_of_total(
        matched(base, iteration, *more_keys), sources + goals, value_col, how, sources
    )
    return rank_within(flow, sources, "value", goals, targets).select(
        *sources, *goals, "value", "percent"
    )


def fc_flow(
    base: DataFrame,
    iteration: DataFrame,
    value_col: str = "tracking_number",
    how: str = "nunique",
    targets: int = P.FLOW_TARGETS,
) -> DataFrame:
    """Where the packages of each FC go, the largest targets only."""
    return _flow(base, iteration, ["fc_name"], value_col, how, targets)


def fc_carrier_flow(
    base: DataFrame,
    iteration: DataFrame,
    value_col: str = "tracking_number",
    how: str = "nunique",
    targets: int = P.FLOW_TARGETS,
) -> DataFrame:
    """Where the packages of each FC and carrier go, the largest targets only."""
    return _flow(
        base, iteration, ["fc_name", "carrier_code"], value_col, how, targets
    )


def switched_packages(
    routing: DataFrame, zips: DataFrame, carrier_col: str, carrier=P.CHALLENGER
) -> DataFrame:
    """Packages a carrier has in the chosen zips, one row."""
    chosen = routing.where(F.col(carrier_col) == carrier)
    return chosen.join(distinct_zips(zips), "zip5", "left_semi").agg(
        F.count_distinct("tracking_number").alias("carrier_switch_package_count")
    )



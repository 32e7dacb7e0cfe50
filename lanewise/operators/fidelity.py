"""How close the counterfactual comes to what really happened, week by week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions import calendar, codes, numbers
from lanewise.operators.shares import share_of_total
from lanewise.operators.whatif import wms_proxy

WEEK = "week_start_date"


def ors_daily(routed: DataFrame, start, end, fcs=P.FCS) -> DataFrame:
    """Packages the router sent, by business day, FC and carrier.

    The range compares moments with dates, so of the end day only midnight
    itself is inside.
    """
    moment = F.col("batch_ts")
    inside = (moment >= F.lit(calendar.as_date(start))) & (
        moment <= F.lit(calendar.as_date(end))
    )
    package = codes.joined_key(
        "order_id", F.col("cartonization_id").cast("int"), "fc_name", "ship_method"
    )
    return (
        routed.where(
            (F.col("itemtype") == P.ROUTED_ITEM) & F.col("fc_name").isin(*fcs) & inside
        )
        .groupBy(
            calendar.business_day("batch_ts").alias("date"),
            F.col("fc_name").alias("ors_fc_name"),
            F.col("ship_method").alias("ors_carrier_code"),
        )
        .agg(F.count_distinct(package).alias("packages"))
    )


def with_week(df: DataFrame, date_col: str) -> DataFrame:
    return df.withColumn(WEEK, calendar.week_label(date_col))


def latest_week(df: DataFrame, date_col: str) -> DataFrame:
    """Rows of the latest week, with its label."""
    labelled = with_week(df, date_col)
    newest = numbers.one_value(labelled, F.max(WEEK))
    return labelled.where(F.col(WEEK) == newest)


def named_share(
    df: DataFrame,
    group_cols: list[str],
    value_col: str,
    how: str,
    denom_cols: list[str],
    name_col: str,
    prefix: str,
    target: str,
) -> DataFrame:
    """Share with the key renamed to ``target`` and trimmed."""
    columns = [
        codes.trimmed(c).alias(target) if c == name_col else F.col(c)
        for c in group_cols
    ]
    return share_of_total(df, group_cols, value_col, how, denom_cols).select(
        *columns,
        F.col("value").alias(f"{prefix}_package_count"),
        F.col("percent").alias(f"{prefix}_package_percent"),
    )


def carrier_coverage(
    df, group_cols, value_col, how, denom_cols, carrier_col, prefix=""
) -> DataFrame:
    """Share of the carriers under the name ``carrier``."""
    return named_share(
        df, group_cols, value_col, how, denom_cols, carrier_col, prefix, "carrier"
    )


def fc_charges(
    df, group_cols, value_col, how, denom_cols, fc_col, prefix="", target="fc_name"
) -> DataFrame:
    """Share of the FCs or regions under the name ``target``."""
    return named_share(
        df, group_cols, value_col, how, denom_cols, fc_col, prefix, target
    )


def _compared(ours: DataFrame, other: DataFrame, key: str, prefix: str) -> DataFrame:
    difference = F.col("sim_package_percent") - F.col(f"{prefix}_package_percent")
    return ours.join(other, [WEEK, key], "left").withColumn("abs_per_diff", difference)


def fidelity_carrier_before(routing: DataFrame, routed_daily: DataFrame) -> DataFrame:
    """Counterfactual against the router by carrier, before the proxy."""
    sim = latest_week(routing, "order_placed_date")
    ors = latest_week(routed_daily, "date")
    ours = carrier_coverage(
        sim,
        [WEEK, "sim_carrier_code"],
        "tracking_number",
        "nunique",
        [WEEK],
        "sim_carrier_code",
        "sim",
    )
    router = carrier_coverage(
        ors, [WEEK, "ors_carrier_code"], "packages", "sum", [WEEK], "ors_carrier_code", "ors"
    )
    return _compared(ours, router, "carrier", "ors")


def fidelity_carrier_after(routing: DataFrame, proxy: DataFrame) -> DataFrame:
    """Counterfactual after the proxy against the actual carrier."""
    sim = latest_week(routing, "order_placed_date")
    proxied = with_week(wms_proxy(sim, proxy), "order_placed_date")
    ours = carrier_coverage(
        proxied, [WEEK, "carrier"], "package_count", "sum", [WEEK], "carrier", "sim"
    )
    actual = carrier_coverage(
        sim,
        [WEEK, "act_carrier_code"],
        "tracking_number",
        "nunique",
        [WEEK],
        "act_carrier_code",
        "act",
    )
    return _compared(ours, actual, "carrier", "act")


def _sim_against_actual(sim: DataFrame, sim_col: str, act_col: str, target: str):
    sides = [
        fc_charges(
            sim, [WEEK, c], "tracking_number", "nunique", [WEEK], c, prefix, target
        )
        for c, prefix in ((sim_col, "sim"), (act_col, "act"))
    ]
    return _compared(*sides, target, "act")


def fidelity_region(routing: DataFrame) -> DataFrame:
    """Counterfactual against actual by FC region."""
    sim = latest_week(routing, "order_placed_date").withColumns(
        {
            "sim_fc_region": codes.fc_region("sim_fc_name"),
            "act_fc_region": codes.fc_region("act_fc_name"),
        }
    )
    return _sim_against_actual(sim, "sim_fc_region", "act_fc_region", "fc_region")


def fidelity_fc(routing: DataFrame) -> DataFrame:
    """Counterfactual against actual by FC."""
    sim = latest_week(routing, "order_placed_date")
    return _sim_against_actual(sim, "sim_fc_name", "act_fc_name", "fc_name")

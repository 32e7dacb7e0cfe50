"""Checks of scalar columns and plain filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.world import RUN_DATE, World
from checks.whatif_checks import region
from lanewise import params as P
from lanewise.functions import calendar, codes, numbers
from lanewise.operators import shipmap


@check(
    "zip_pad",
    """
    select zip5 as raw, lpad(cast(zip5 as varchar), 5, '0') as zip5 from removal_zips
    union all select zipcode, lpad(zipcode, 5, '0') from station_zip_a
    """.replace("zip5 as raw,", "cast(zip5 as varchar) as raw,"),
)
def zip_pad(w: World):
    raw = w.removal_zips.select(F.col("zip5").cast("string").alias("raw")).unionAll(
        w.station_zip_a.select("zipcode")
    )
    return raw.withColumn("zip5", codes.zip_pad("raw"))


@check(
    "str_trim",
    """
    select ship_method, trim(ship_method) as carrier, count(*) as rows
    from routed_packages group by all
    """,
)
def str_trim(w: World):
    return w.routed_packages.groupBy(
        "ship_method", codes.trimmed("ship_method").alias("carrier")
    ).agg(F.count(F.lit(1)).alias("rows"))


@check(
    "str_concat_key",
    """
    select order_id, cast(order_id as varchar) || '-'
             || cast(cast(cartonization_id as int) as varchar) || '-' || fc_name || '-'
             || ship_method as package_key
    from routed_packages
    """,
)
def str_concat_key(w: World):
    key = codes.joined_key(
        "order_id", F.col("cartonization_id").cast("int"), "fc_name", "ship_method"
    )
    return w.routed_packages.select("order_id", key.alias("package_key"))


@check("names_lower", "select fc as fc, mode, count(*) as lanes from ship_map_raw group by all")
def names_lower(w: World):
    counted = w.ship_map_raw.groupBy("fc", "mode").agg(F.count(F.lit(1)).alias("lanes"))
    return codes.lower_names(codes.upper_names(counted))


@check(
    "names_upper",
    'select fc as "FC", mode as "MODE", count(*) as "LANES" from ship_map_raw group by all',
)
def names_upper(w: World):
    counted = w.ship_map_raw.groupBy("fc", "mode").agg(F.count(F.lit(1)).alias("lanes"))
    return codes.upper_names(counted)


@check(
    "date_of",
    """
    select order_id, tracking_number, cast(cast(order_placed_ts as date) as varchar) as day
    from shipments
    """,
)
def date_of(w: World):
    return w.shipments.select(
        "order_id", "tracking_number", F.to_date("order_placed_ts").alias("day")
    )


@check(
    "date_shift",
    """
    select order_id, order_line_id, cast(order_placed_date + 3 as varchar) as later
    from order_lines
    """,
)
def date_shift(w: World):
    return w.order_lines.select(
        "order_id", "order_line_id", F.date_add("order_placed_date", 3).alias("later")
    )


@check(
    "days_between",
    """
    select order_id, tracking_number,
           cast(date_diff('day', cast(order_placed_ts as date),
                          cast(first_attempt_ts as date)) as int) as ctd,
           cast(date_diff('day', cast(actual_ship_ts as date),
                          cast(first_attempt_ts as date)) as int) as std
    from shipments
    """,
)
def days_between(w: World):
    return w.shipments.select(
        "order_id",
        "tracking_number",
        calendar.days_between("first_attempt_ts", "order_placed_ts").alias("ctd"),
        calendar.days_between("first_attempt_ts", "actual_ship_ts").alias("std"),
    )


WEEK_SQL = {
    "week_trunc": "cast(cast(date_trunc('week', {d}) as date) as varchar)",
    "week_label": "cast(cast(date_trunc('week', {d}) as date) - 1 as varchar)",
    "dow_monday0": "cast(isodow({d}) - 1 as int)",
    "dow_sunday0": "cast(dayofweek({d}) as int)",
}
WEEK = {
    "week_trunc": calendar.week_monday,
    "week_label": calendar.week_label,
    "dow_monday0": calendar.dow_monday0,
    "dow_sunday0": calendar.dow_sunday0,
}


def _register_week(name):
    @check(
        name,
        f"select event_id, {WEEK_SQL[name].format(d='cast(ts as date)')} as {name} "
        "from events",
    )
    def week(w: World):
        events = w.spark.read.parquet(f"{w.sf_dir}/events.parquet")
        day = F.to_date("ts")
        return events.select("event_id", WEEK[name](day).alias(name))


for _name in WEEK:
    _register_week(_name)


@check(
    "business_day",
    """
    select order_id, cast(cast(batch_ts - interval '4' hour as date) as varchar) as day
    from routed_packages
    """,
)
def business_day(w: World):
    return w.routed_packages.select(
        "order_id", calendar.business_day("batch_ts").alias("day")
    )


@check(
    "lookback_window",
    """
    select count(*) as rows, cast(min(order_placed_ts) as varchar) as first_ts
    from shipments
    where cast(order_placed_ts as date) between date '2025-11-07' and date '2025-11-14'
    """,
)
def lookback_window(w: World):
    start, end = calendar.lookback_window(RUN_DATE, P.RoutingParams().lookback_days)
    return w.shipments.where(
        calendar.within_days("order_placed_ts", start, end)
    ).agg(F.count(F.lit(1)).alias("rows"), F.min("order_placed_ts").alias("first_ts"))


@check(
    "filter_date_window",
    """
    select cast(shipdate as varchar) as shipdate, count(*) as lanes from (
      select ship_date as shipdate from ship_map_raw
      where ship_date between date '2025-11-03' and date '2025-11-05' + 3)
    group by all
    """,
)
def filter_date_window(w: World):
    return (
        shipmap.scoped(w.ship_map_raw, "2025-11-03", "2025-11-05")
        .groupBy(F.col("ship_date").alias("shipdate"))
        .agg(F.count(F.lit(1)).alias("lanes"))
    )


@check(
    "select_distinct",
    "select distinct fc_name, carrier_code, zip5 from shipments",
)
def select_distinct(w: World):
    return w.shipments.select("fc_name", "carrier_code", "zip5").distinct()


@check(
    "agg_count_distinct",
    """
    select zip5, count(distinct tracking_number) as packages,
           count(distinct cast(order_placed_ts as date)) as days
    from shipments group by all
    """,
)
def agg_count_distinct(w: World):
    return w.shipments.groupBy("zip5").agg(
        F.count_distinct("tracking_number").alias("packages"),
        F.count_distinct(F.to_date("order_placed_ts")).alias("days"),
    )


@check(
    "zero_if_null",
    """
    select order_id, tracking_number, coalesce(weight, 0) as weight,
           coalesce(date_diff('day', promised_date, cast(first_attempt_ts as date)), 0)
             as days_late
    from shipments
    """.replace("coalesce(date_diff", "cast(coalesce(date_diff").replace(
        "as date)), 0)\n", "as date)), 0) as int)\n"
    ),
)
def zero_if_null(w: World):
    late = calendar.days_between("first_attempt_ts", "promised_date")
    return w.shipments.select(
        "order_id",
        "tracking_number",
        numbers.zero_if_null("weight").alias("weight"),
        numbers.zero_if_null(late).alias("days_late"),
    )


@check(
    "round_half_even",
    """
    select order_id, tracking_number, round_even(weight / 2, 0) as half_weight,
           round_even(length * 0.125, 2) as length_part
    from shipments
    """.replace("0.125", "cast(0.125 as double)"),
)
def round_half_even(w: World):
    return w.shipments.select(
        "order_id",
        "tracking_number",
        numbers.half_even(F.col("weight") / 2).alias("half_weight"),
        numbers.half_even(F.col("length") * 0.125, 2).alias("length_part"),
    )


@check(
    "fc_region",
    f"""
    select fc_name, {region('fc_name')} as fc_region, count(*) as packages
    from shipments group by all
    """,
)
def fc_region(w: World):
    return w.shipments.groupBy(
        "fc_name", codes.fc_region("fc_name").alias("fc_region")
    ).agg(F.count(F.lit(1)).alias("packages"))


@check(
    "carrier_code_map",
    """
    select carrier, case carrier when 'FedEx' then 'FDXHD' when 'OnTrac' then 'ONTRGD' end
             as carrier_code, count(*) as rows
    from station_backlog group by all
    """,
)
def carrier_code_map(w: World):
    return w.station_backlog.groupBy(
        "carrier", codes.carrier_from_name("carrier").alias("carrier_code")
    ).agg(F.count(F.lit(1)).alias("rows"))

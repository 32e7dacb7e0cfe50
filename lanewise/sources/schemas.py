"""Declared schemas of the tables that runs read.

A reader never infers: a file with another type of a column fails, one without a
required column is told by :func:`required`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAND = (
    "carrier_code string, zone int, {0}_lower double, {0}_upper double, amount double, "
    "charge_type string, start_date date, end_date date"
)
SHIP_MAP = (
    "shipdate date, fcname string, zip5 string, mode string, routeid string, zone int, "
    "cutoff string, tnt int, adjtnt int, nextadjtnt int"
)

#: Columns and types of each table.
TABLES = {
    "shipments": (
        "order_id long, tracking_number string, zip5 string, fc_name string, "
        "carrier_code string, route string, order_placed_ts timestamp, release_ts timestamp, "
        "actual_ship_ts timestamp, first_attempt_ts timestamp, promised_date date, "
        "length double, width double, height double, weight double, units long"
    ),
    "order_lines": (
        "order_id long, tracking_number string, order_line_id int, qty int, "
        "order_placed_date date"
    ),
    "inventory": "order_id long, order_line_id int, fc_name string, quantity_available int",
    "ship_map_raw": (
        "ship_date date, fc string, zip5 string, mode string, routeid string, zone int, "
        "cutoff int, tnt int, adjtnt int, nextadjtnt int, generate_date date, item_type string"
    ),
    "ship_map": SHIP_MAP,
    "eligible_lanes": SHIP_MAP,
    "removal_zips": "zip5 string",
    "base_rates": (
        "carrier_code string, zone int, bill_weight int, base_charge double, "
        "start_date date, end_date date"
    ),
    "resi": "carrier_code string, resi_amount double, start_date date, end_date date",
    "das": "carrier_code string, zipcode string, amount double, start_date date, end_date date",
    "weight_bands": BAND.format("weight"),
    "longest_bands": BAND.format("longest_side"),
    "second_bands": BAND.format("second_longest_side"),
    "girth_bands": BAND.format("length_plus_girth"),
    "peak": "shipmode string, peak_surcharge_application_week date, peak_surcharge double",
    "fuel": "carrier_code string, fsc_per double, start_dt date, end_dt date",
    "fc_zip_distance": "fc_name string, postcode string, dist_miles double",
    "routing_result": (
        "order_id long, tracking_number string, zip5 string, sim_fc_name string, "
        "sim_carrier_code string, sim_route string, sim_transit_cost double, "
        "sim_tnt_penalty double, sim_zone int, sim_tnt int, cost_neutral_fc array<string>, "
        "act_fc_name string, act_carrier_code string, act_route string, "
        "act_transit_cost double, ship_date date, units long, ctd int, std int, "
        "dea_flag int, order_placed_date date"
    ),
    "recommendation_history": (
        "zip5 string, final_recommendation string, final_reason_dea string, "
        "final_reason_shutdown string, final_reason_backlog string, run_dttm timestamp, "
        "run_date date, run_name string, zip_count_tag string"
    ),
}

#: Columns without which a row means nothing.
KEYS = {
    "shipments": ("order_id", "zip5", "order_placed_ts"),
    "order_lines": ("order_id", "order_line_id", "qty"),
    "inventory": ("order_id", "order_line_id", "fc_name"),
    "ship_map": ("fcname", "zip5", "mode"),
    "routing_result": ("order_id", "zip5"),
    "recommendation_history": ("zip5", "final_recommendation"),
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def required(df: DataFrame, name: str) -> DataFrame:
    """Fail on a row without one of the table's keys, as files without them give.

    Checked as rows are read: no pass of its own, and filters on partitions and
    other columns still reach the files.
    """

    def known(column: str) -> Column:
        said = F.lit(f"{name}: a row without {column}")
        return F.when(F.col(column).isNull(), F.raise_error(said)).otherwise(F.col(column))

    kinds = {f.name: f.dataType for f in df.schema}
    checked = {c: known(c).cast(kinds[c]) for c in KEYS.get(name, ()) if c in kinds}
    return df.withColumns(checked)

"""Lane maps of the network scenarios: which FC may ship to which zip, how, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions import calendar, codes
from lanewise.operators.skew import hot_keys, salted_join

LANE = ["shipdate", "fcname", "zip5", "mode"]
COLUMNS = [*LANE, "routeid", "zone", "cutoff", "tnt", "adjtnt", "nextadjtnt"]


def latest_snapshot(
    df: DataFrame, keys: list[str], stamp: str, **slicing
) -> DataFrame:
    """Rows carrying the greatest ``stamp`` of their key; ties and copies all stay.

    Copies are counted first, so a key full of copies shuffles as few rows.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    per_stamp = [*keys, stamp]
    latest = df.groupBy(*keys).agg(F.max(stamp).alias(stamp))
    kept = salted_join(
        counted,
        latest,
        per_stamp,
        "left_semi",
        salt_on=[c for c in df.columns if c not in per_stamp],
        hot=hot_keys(df, per_stamp, **slicing),
    )
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(
        *df.columns
    )


def scoped(raw: DataFrame, start, end, fcs=P.FCS, modes=P.CARRIERS) -> DataFrame:
    """Standard lanes of the listed FCs and carriers over the days of a ship map."""
    last = F.date_add(F.lit(calendar.as_date(end)), P.SHIP_MAP_DAYS_AHEAD)
    return raw.where(
        F.col("fc").isin(*fcs)
        & F.col("mode").isin(*modes)
        & (F.col("item_type") == P.STANDARD_ITEM)
        & F.col("ship_date").between(F.lit(calendar.as_date(start)), last)
    ).select(
        "ship_date",
        "fc",
        "zip5",
        "mode",
        "routeid",
        "zone",
        "cutoff",
        "tnt",
        "adjtnt",
        "nextadjtnt",
        "generate_date",
    )


def ship_map(raw: DataFrame, start, end, fcs=P.FCS, modes=P.CARRIERS) -> DataFrame:
    """Lanes in force: the latest snapshot of each (day, FC, zip)."""
    rows = scoped(raw, start, end, fcs, modes)
    current = latest_snapshot(rows, ["ship_date", "fc", "zip5"], "generate_date")
    return current.select(
        F.col("ship_date").alias("shipdate"),
        F.col("fc").alias("fcname"),
        "zip5",
        "mode",
        "routeid",
        "zone",
        calendar.wrapped_clock("cutoff").alias("cutoff"),
        "tnt",
        "adjtnt",
        "nextadjtnt",
    )


def ship_map_single_carrier(
    raw: DataFrame, start, end, fcs=P.FCS, carrier=P.INCUMBENT
) -> DataFrame:
    """Lanes when only one carrier is in use."""
    return ship_map(raw, start, end, fcs, (carrier,))


def ship_map_expanded(
    raw: DataFrame,
    eligible: DataFrame,
    start,
    end,
    fcs=P.FCS,
    modes=P.CARRIERS,
    excluded_fcs=P.EXPANSION_EXCLUDED_FCS,
) -> DataFrame:
    """Lanes in force together with all lanes that could be opened."""
    last = F.date_add(F.lit(calendar.as_date(end)), P.SHIP_MAP_DAYS_AHEAD)
    opened = eligible.where(
        ~F.col("fcname").isin(*excluded_fcs)
        & F.col("shipdate").between(F.lit(calendar.as_date(start)), last)
    ).withColumn("cutoff", calendar.plain_clock("cutoff"))
    current = ship_map(raw, start, end, fcs, modes)
    return current.unionByName(opened.select(*COLUMNS)).distinct()


def ship_map_custom(
    raw: DataFrame,
    removal: DataFrame,
    start,
    end,
    fcs=P.FCS,
    modes=P.CARRIERS,
    removed_carrier=P.CHALLENGER,
) -> DataFrame:
    """Lanes in force without the removed carrier in the zips of a list."""
    gone = removal.select(
        codes.zip_pad("zip5").alias("zip5"), F.lit(removed_carrier).alias("mode")
    ).distinct()
    current = ship_map(raw, start, end, fcs, modes)
    return current.join(gone, ["zip5", "mode"], "left_anti").select(*COLUMNS).distinct()


def ship_map_for(scenario: str, raw: DataFrame, start, end, **tables) -> DataFrame:
    """Ship map by scenario name; an unknown name means the custom map."""
    if scenario == "baseline":
        return ship_map(raw, start, end)
    if scenario == "remediation":
        return ship_map_single_carrier(raw, start, end)
    if scenario == "expansion":
        return ship_map_expanded(raw, tables["eligible"], start, end)
    return ship_map_custom(raw, tables["removal"], start, end)

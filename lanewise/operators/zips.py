"""Zip lists: who is eligible, who is chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions import calendar
from lanewise.operators.skew import running_total


def distinct_zips(df: DataFrame) -> DataFrame:
    return df.select("zip5").distinct()


def open_zips(ship_map: DataFrame, check_date=None, carrier=P.CHALLENGER) -> DataFrame:
    """Zips a carrier serves, on one day or on any."""
    lanes = ship_map.where(F.col("mode") == carrier)
    if check_date is not None:
        lanes = lanes.where(F.col("shipdate") == F.lit(calendar.as_date(check_date)))
    return distinct_zips(lanes)


def zip_status(
    ship_map_base: DataFrame,
    ship_map_eligible: DataFrame,
    check_date=None,
    carrier=P.CHALLENGER,
) -> DataFrame:
    """Eligible zips, active 1 if the current map already serves them."""
    current = open_zips(ship_map_base, check_date, carrier).withColumn(
        "active", F.lit(1)
    )
    return (
        open_zips(ship_map_eligible, check_date, carrier)
        .join(current, "zip5", "left")
        .fillna({"active": 0})
    )


def top_zips(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` zips of the highest priority; the sentinel keeps all."""
    if n >= P.ALL_ZIPS:
        return scored
    return scored.orderBy(F.col("priority_score").desc_nulls_last(), "zip5").limit(n)


def ranked_zips(scored: DataFrame) -> DataFrame:
    """Add ``zip_rank``, from 1 on, in the order of :func:`top_zips`."""
    low = -F.col("priority_score").cast("double")
    return running_total(
        scored.withColumns({"_one": F.lit(1), "_low": low}),
        "_low",
        "zip5",
        {"_one": "zip_rank"},
    ).drop("_one", "_low")


def zips_of_counts(ranked: DataFrame, counts) -> DataFrame:
    """The ranked zips of each count, tagged with ``zip_count``."""
    wanted = F.array(*(F.lit(int(c)) for c in counts))
    return ranked.withColumn("zip_count", F.explode(wanted)).where(
        F.col("zip_rank") <= F.col("zip_count")
    )


def top_zips_per_count(scored: DataFrame, counts) -> DataFrame:
    """Selections for several counts at once, tagged with ``zip_count``.

    Counts above the number of zips are left out; the sentinel for all zips is
    always added.  One ranking of the zips serves every count.
    """
    ranked = ranked_zips(scored)
    size = F.count(F.lit(1))
    total = ranked.agg(size.alias("n")).scalar()
    return (
        zips_of_counts(ranked.withColumn("_zips", total), [*counts, P.ALL_ZIPS])
        .where((F.col("zip_count") <= F.col("_zips")) | (F.col("zip_count") == P.ALL_ZIPS))
        .drop("_zips")
    )


def cut_by_volume(scored: DataFrame, volume: float) -> DataFrame:
    """Zips whose running switch volume stays within the target."""
    return scored.where(F.col("carrier_switch_package_count_cumsum") <= volume)


SCENARIO_COLUMNS = [
    "order_id",
    "order_placed_date",
    "tracking_number",
    "zip5",
    "sim_fc_name",
    "sim_carrier_code",
    "sim_route",
    "sim_tnt",
    "sim_transit_cost",
]


def scenario_of_zips(scenario: DataFrame, zips: DataFrame) -> DataFrame:
    columns = [c for c in SCENARIO_COLUMNS if c in scenario.columns]
    return scenario.join(distinct_zips(zips), "zip5", "left_semi").select(*columns)


def select_zips_topn(scenario: DataFrame, scored: DataFrame, n: int):
    """Scenario rows of the top ``n`` zips, and these zips."""
    chosen = top_zips(scored, n)
    return scenario_of_zips(scenario, chosen), chosen.withColumn("selected", F.lit(1))


def select_zips_cumulative(scenario: DataFrame, scored: DataFrame, volume: float):
    """Scenario rows of the zips within the target volume, and these zips."""
    chosen = distinct_zips(cut_by_volume(scored, volume))
    return scenario_of_zips(scenario, chosen), chosen.withColumn("selected", F.lit(1))


def runs_per_zip(recommendations: DataFrame) -> DataFrame:
    """Recommendations with the number of runs their zip appears in."""
    runs = recommendations.groupBy("zip5").agg(
        F.count_distinct("run_date").alias("run_count")
    )
    return recommendations.join(runs, "zip5")


def rank_within(
    df: DataFrame, keys: list[str], value: str, ties: list[str], k: int
) -> DataFrame:
    """The ``k`` greatest values of each key, named columns deciding ties."""
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), *ties)
    return (
        df.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k)
        .drop("_rank")
    )

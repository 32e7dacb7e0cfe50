"""Priority scores of zips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions import numbers
from lanewise.operators.signals import fc_carrier_switch, matched, per_carrier
from lanewise.operators.skew import running_total
from lanewise.operators.zips import distinct_zips, open_zips
from lanewise.sources.shared import stored


def priority_score_exec(df: DataFrame, weights: dict | None = None) -> DataFrame:
    """Score within the given zips: volume, poor service and backlog, each scaled.

    Unknown values take the mean of the zips; a constant measure counts zero.
    """
    weights = weights or P.ExecutionParams().weights
    fields = ("act_package_count", "unpadded_edd_dea", "days_behind")
    scaled = {f: f"{f}_scaled" for f in fields}
    return (
        numbers.impute_mean(df, *fields)
        .transform(numbers.min_max_scale, scaled, "zero")
        .withColumn("inverted_dea", 1 - F.col("unpadded_edd_dea_scaled"))
        .withColumn(
            "priority_score",
            numbers.weighted(
                {
                    "act_package_count_scaled": weights["volume"],
                    "inverted_dea": weights["service"],
                    "days_behind_scaled": weights["backlog"],
                }
            ),
        )
    )


def _with_running_volume(scored: DataFrame) -> DataFrame:
    """Add the running switch volume and the running share of packages."""
    running = running_total(
        scored,
        "priority_score",
        "zip5",
        {
            "carrier_switch_package_count": "carrier_switch_package_count_cumsum",
            "package_count": "_running",
        },
    )
    packages = numbers.one_value(scored, F.sum("package_count"))
    return running.withColumn(
        "package_count_cumsum_per", numbers.ratio("_running", packages)
    ).drop("_running")


def carrier_cells(base: DataFrame) -> DataFrame:
    """Packages, mean cost, mean transit and on-time count per zip and carrier.

    Of delivered packages with a known zip.
    """
    return (
        base.where(F.col("std").isNotNull() & F.col("zip5").isNotNull())
        .groupBy("zip5", F.col("act_carrier_code").alias("carrier_code"))
        .agg(
            F.count_distinct("tracking_number").alias("packages"),
            numbers.exact_mean("act_transit_cost").alias("cost"),
            F.avg("std").alias("std"),
            numbers.total("dea_flag").alias("on_time"),
        )
    )


def remediation_metrics(
    base: DataFrame, challenger=P.CHALLENGER, incumbent=P.INCUMBENT
) -> DataFrame:
    """Differences between the carriers per zip, from delivered packages.

    Zips without both carriers are left out.  Negative means the challenger is
    worse.
    """
    both = (incumbent, challenger)
    cells = carrier_cells(base).withColumn(
        "dea_per", numbers.half_even(numbers.ratio("on_time", "packages"), 4)
    )
    wide = per_carrier(
        cells,
        {
            "dea_per": F.max("dea_per"),
            "cost": F.max("cost"),
            "std": F.max("std"),
            "there": F.count(F.lit(1)),
        },
        both,
    ).where(
        (F.col(f"{challenger}_there") > 0) & (F.col(f"{incumbent}_there") > 0)
    )

    def gap(measure: str, first: str, second: str):
        return F.col(f"{first}_{measure}") - F.col(f"{second}_{measure}")

    return wide.select(
        "zip5",
        gap("dea_per", challenger, incumbent).alias("dea_per_change"),
        gap("cost", incumbent, challenger).alias("cost_change"),
        gap("std", incumbent, challenger).alias("std_change"),
    )


def remediation_score(
    base: DataFrame,
    weights: dict | None = None,
    challenger=P.CHALLENGER,
    incumbent=P.INCUMBENT,
) -> DataFrame:
    """Zips in the order to switch off: the lowest score first.

    Zips where the routing gives the challenger no package are left out.  The
    measures of the zips are written once; scaling and totals read that table.
    """
    weights = weights or P.PlanningParams().remediation_weights
    zips = remediation_metrics(base, challenger, incumbent)
    zips = stored(zips.join(switch_volume(base, challenger), "zip5", "left"), "remediation")
    scaled = numbers.min_max_scale(
        zips,
        {
            "dea_per_change": "normalized_dea_per_change",
            "cost_change": "normalized_cost_change",
            "std_change": "normalized_std_change",
        },
        "null",
    ).withColumn(
        "priority_score",
        numbers.weighted(
            {
                "normalized_dea_per_change": weights["service"],
                "normalized_cost_change": weights["cost"],
                "normalized_std_change": weights["transit"],
            }
        ),
    )
    return _with_running_volume(scaled.where("carrier_switch_package_count > 0"))


def switch_volume(base: DataFrame, challenger=P.CHALLENGER) -> DataFrame:
    """Delivered packages of each zip, and those the routing gives the challenger."""
    ours = F.when(
        F.col("base_carrier_code") == challenger, F.col("tracking_number")
    )
    return (
        base.where(F.col("std").isNotNull())
        .groupBy("zip5")
        .agg(
            F.count_distinct("tracking_number").alias("package_count"),
            F.count_distinct(ours).alias("carrier_switch_package_count"),
        )
    )


def expansion_metrics(
    base: DataFrame, expand: DataFrame, ship_map_base: DataFrame, ship_map_expanded: DataFrame
) -> DataFrame:
    """Cost and transit change per zip when every eligible zip is opened."""
    current = open_zips(ship_map_base)
    active = distinct_zips(open_zips(ship_map_expanded).join(current, "zip5", "left_semi"))
    changes = (
        matched(base, expand)
        .where(F.col("zip5").isNotNull())
        .groupBy("zip5")
        .agg(
            numbers.total("base_transit_cost").alias("base_transit_cost"),
            numbers.total("sim_transit_cost").alias("sim_transit_cost"),
            F.avg("base_tnt").alias("base_tnt"),
            F.avg("sim_tnt").alias("sim_tnt"),
        )
        .withColumns(
            {
                "cost_change": F.col("sim_transit_cost") - F.col("base_transit_cost"),
                "tnt_change": F.col("sim_tnt") - F.col("base_tnt"),
            }
        )
    )
    return changes.join(
        active.withColumn("active", F.lit(1)), "zip5", "left"
    ).fillna({"active": 0})


def expansion_score(
    base: DataFrame,
    expand: DataFrame,
    ship_map_base: DataFrame,
    ship_map_expanded: DataFrame,
    fc_switch_threshold: float = 0.1,
    weights: dict | None = None,
) -> DataFrame:
    """Zips in the order to switch on: the lowest score first.

    The scores are scaled over all zips; inactive zips with few FC switches
    remain.  The measures of the zips are written once.
    """
    weights = weights or P.PlanningParams().expansion_weights
    zips = expansion_metrics(base, expand, ship_map_base, ship_map_expanded).join(
        fc_carrier_switch(base, expand), "zip5", "left"
    )
    scored = (
        stored(zips, "expansion")
        .fillna({"carrier_switch_package_count": 0, "fc_switch_package_per": 0.0})
        .transform(
            numbers.min_max_scale,
            {
                "cost_change": "normalized_cost_change",
                "tnt_change": "normalized_tnt_change",
            },
            "null",
        )
        .withColumn(
            "priority_score",
            numbers.weighted(
                {
                    "normalized_cost_change": weights["cost"],
                    "normalized_tnt_change": weights["transit"],
                }
            ),
        )
    )
    kept = scored.where(
        (F.col("fc_switch_package_per") <= fc_switch_threshold)
        & (F.col("active") == 0)
    )
    return _with_running_volume(kept)


def target_change(
    base: DataFrame, target_share: float = 0.18, challenger=P.CHALLENGER
) -> DataFrame:
    """Packages to move so that the challenger reaches its target share; one row."""
    counts = (
        base.where(F.col("base_carrier_code").isNotNull())
        .groupBy("base_carrier_code")
        .agg(F.count_distinct("tracking_number").alias("packages"))
    )
    ours = numbers.total(
        F.when(F.col("base_carrier_code") == challenger, F.col("packages"))
    )
    gap = F.abs(F.sum("packages") * F.lit(target_share) - ours)
    return counts.agg(numbers.half_even(gap).cast("bigint").alias("package_change"))

"""Choosing the lane of a package and comparing it with what happened."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions import calendar, codes, package
from lanewise.operators.rates import (
    RateCards,
    band_edges,
    flat_amounts,
    handling_card,
    package_dims,
    priced,
    sized,
)
from lanewise.operators.skew import SALT, salt, salted_copies, slices_of, within_rows
from lanewise.operators.stock import PACKAGE, served_sets
from lanewise.sources.shared import bucketed, stored

LANE_KEYS = ["zip5", "order_placed_date"]
# What the price of a lane depends on, from a shipment row.
PRICED_BY = [
    "ship_date",
    "weight",
    "longest_side",
    "second_side",
    "length_plus_girth",
    "charged_weight",
]
# Zip, day and slice are functions of the package: grouped by all of them, lanes
# keep the partitioning of the ship map join.  The package comes first: a task holds
# few zips, and sorts decide most comparisons by the first column.
LANE_GROUP = [*PACKAGE, *LANE_KEYS, SALT]
SLICE = [*LANE_KEYS, SALT]

# Packages of one zip and day that one task fans out into lanes, about; each has
# as many lanes as routes, some dozens.
PACKAGES_PER_SLICE = 5_000
# Packages of one bucket of the stage, about: a task sorts all their lanes, some
# hundred bytes each, and is to do so in memory.
PACKAGES_PER_BUCKET = 50_000


def attach_distance(lanes: DataFrame, distances: DataFrame) -> DataFrame:
    """Miles between FC and zip, the unknown ones far away."""
    miles = distances.select(
        F.col("postcode").alias("zip5"), "fc_name", F.col("dist_miles").alias("distance")
    )
    known = F.coalesce("distance", F.lit(P.UNKNOWN_DISTANCE))
    return lanes.join(miles, ["zip5", "fc_name"], "left").withColumn("distance", known)


def release_seconds() -> Column:
    """When the package was released, in seconds after midnight of the order day."""
    return calendar.seconds_into_day("release_ts", "order_placed_date")


def with_transit(lanes: DataFrame) -> DataFrame:
    """Transit days by the cutoff rule.

    Release, cutoff and both transit times give way to the result, which keeps
    the rows of the pricing joins narrow.
    """
    days = calendar.transit_days(
        "cutoff_seconds", "release_seconds", F.col("adjtnt"), F.col("nextadjtnt")
    )
    return lanes.withColumn("tnt", days).drop(
        "cutoff_seconds", "release_seconds", "adjtnt", "nextadjtnt"
    )


def lane_order() -> list[Column]:
    """Cheapest first, unknown costs last; then preferred FCs, transit and distance.

    FC and route close the order so that it has no ties.
    """
    return [
        F.col("total_amount").asc_nulls_last(),
        F.col("preferred").desc(),
        package.transit_floor("tnt").asc_nulls_last(),
        F.col("tnt").desc_nulls_last(),
        F.col("distance").asc_nulls_last(),
        F.col("mode").asc_nulls_last(),
        F.col("fc_name").asc_nulls_last(),
        F.col("routeid").asc_nulls_last(),
    ]


def rank_lanes(
    lanes: DataFrame, keys: list[str], also: dict[str, Column] | None = None
) -> DataFrame:
    """Add the rank of each lane in its package and the winner's cost with penalty.

    The penalty does not enter the ranking.  ``also`` names aggregates over all
    lanes of a package, which every lane gets.
    """
    ordered = Window.partitionBy(*keys).orderBy(*lane_order())
    # Both frames have one order, so one pass over a package serves them.
    group = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = {
        "row_n": F.row_number().over(ordered),
        "_won": F.first("cost").over(group),
        "_lanes": F.count(F.lit(1)).over(group),
        **{name: value.over(group) for name, value in (also or {}).items()},
    }
    # Where there are other lanes, a winner of unknown cost counts as 0.
    selected = F.when(F.col("_lanes") == 1, F.col("_won")).otherwise(
        F.greatest("_won", F.lit(0.0))
    )
    return (
        lanes.withColumn("tnt_penalty", package.transit_penalty("tnt"))
        .withColumn("cost", F.col("total_amount") + F.col("tnt_penalty"))
        .withColumns(found)
        .withColumn("selected_cost", selected)
        .drop("_won", "_lanes")
    )


def open_routes(ship_map: DataFrame) -> DataFrame:
    """Route columns of the ship map under the names the lanes use."""
    return ship_map.select(
        "zip5",
        F.col("shipdate").alias("order_placed_date"),
        F.col("fcname").alias("fc_name"),
        "mode",
        "routeid",
        "zone",
        calendar.clock_seconds("cutoff").alias("cutoff_seconds"),
        "adjtnt",
        "nextadjtnt",
        codes.fc_preference("fcname").alias("preferred"),
    )


def priced_routes(ship_map: DataFrame, distances: DataFrame) -> DataFrame:
    """Routes with distance, one row per zone the same lane is priced at.

    A route takes the cost of its (FC, carrier) lane, so a lane listed under
    two zones is priced at both.
    """
    lane = Window.partitionBy(*LANE_KEYS, "fc_name", "mode")
    zones = F.collect_set(F.struct("zone")).over(lane)
    routes = open_routes(ship_map).withColumn("_zones", zones)
    routes = routes.withColumn("_zone", F.explode("_zones"))
    routes = routes.withColumn("cost_zone", F.col("_zone.zone")).drop("_zone", "_zones")
    return attach_distance(routes, distances)


def priced_zones(ship_map: DataFrame) -> DataFrame:
    """The zones at which the lanes of the map are priced."""
    return (
        open_routes(ship_map)
        .select(*LANE_KEYS, "fc_name", "mode", F.col("zone").alias("cost_zone"))
        .distinct()
    )


def package_facts(shipments: DataFrame, start=None, end=None, fcs=None) -> DataFrame:
    """One row per package with the distinct facts of all its shipment rows.

    ``scopes`` has zip and order moment of the rows of the days shipped by the
    listed FCs, ``prices`` what lane costs depend on, of the rows of the days,
    ``releases`` and ``outcomes`` those of every row.  Nearly always each holds
    one entry.
    """
    placed = F.lit(True)
    if start is not None:
        placed = calendar.within_days("order_placed_ts", start, end)
    listed = F.lit(True) if fcs is None else F.col("fc_name").isin(*fcs)
    outcome = F.struct(
        F.col("fc_name").alias("fc"),
        F.col("carrier_code").alias("carrier"),
        "route",
        "ship_date",
        F.col("units").cast("bigint").alias("units"),
        calendar.days_between("first_attempt_ts", "order_placed_ts").alias("ctd"),
        calendar.days_between("first_attempt_ts", "actual_ship_ts").alias("std"),
        package.on_time_flag("promised_date", "first_attempt_ts").alias("dea"),
    )
    day = F.col("actual_ship_ts").cast("date")
    rows = package_dims(shipments.dropna(subset=PACKAGE).withColumn("ship_date", day))
    # One set a package, whose parts are told apart when it is complete.  Packages have
    # one row as a rule, so nothing is gained by sets before the shuffle; a window over
    # sorted rows has no map of sets that would fall back to sorting, and it leaves the
    # packages in the order in which they are joined.
    fact = F.struct(
        F.when(placed & listed, F.struct("zip5", "order_placed_ts")).alias("scope"),
        F.when(placed, F.struct(*PRICED_BY)).alias("price"),
        F.struct("release_ts").alias("release"),
        outcome.alias("outcome"),
    )
    ordered = Window.partitionBy(*PACKAGE).orderBy(F.lit(0))
    group = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    facts = (
        rows.select(*PACKAGE, fact.alias("_fact"))
        .withColumns(
            {
                "_facts": F.collect_set("_fact").over(group),
                "_row": F.row_number().over(ordered),
            }
        )
        .where(F.col("_row") == 1)
    )

    def parts(name: str) -> Column:
        return F.array_compact(F.array_distinct(F.col("_facts")[name])).alias(f"{name}s")

    return facts.select(*PACKAGE, *map(parts, ("scope", "price", "release", "outcome")))


def shipped_packages_with(facts: DataFrame) -> DataFrame:
    """Packages with zip and order day, once for each release and price basis."""
    outcomes = F.col("outcomes")
    return (
        facts.withColumn("_price", F.explode_outer("prices"))
        .withColumn("_release", F.explode("releases"))
        .withColumn("release_ts", F.col("_release.release_ts"))
        .withColumn("order_placed_date", F.col("order_placed_ts").cast("date"))
        .select(
            *PACKAGE,
            *LANE_KEYS,
            "fcs",
            release_seconds().alias("release_seconds"),
            *(F.col(f"_price.{c}").alias(c) for c in PRICED_BY),
            F.transform(outcomes, lambda o: F.struct(o["fc"], o["carrier"])).alias("used"),
            "outcomes",
        )
    )


def served_packages(
    shipments: DataFrame,
    order_lines: DataFrame,
    inventory: DataFrame,
    start,
    end,
    fcs=P.FCS,
) -> DataFrame:
    """Packages of the days with the set of FCs that could have served them.

    Facts and FC sets are both made by package, so their join shuffles neither.
    """
    served = served_sets(order_lines, inventory, start, end, fcs)
    facts = package_facts(shipments, start, end, fcs)
    scoped = facts.withColumn("_scope", F.explode("scopes")).select(
        "*", F.col("_scope.zip5"), F.col("_scope.order_placed_ts")
    )
    return shipped_packages_with(scoped.join(served, PACKAGE))


def candidate_packages(candidates: DataFrame, shipments: DataFrame) -> DataFrame:
    """The same from (package, FC) rows."""
    served = candidates.groupBy(*PACKAGE, "zip5", "order_placed_ts").agg(
        F.collect_set("fc_name").alias("fcs")
    )
    return shipped_packages_with(served.join(package_facts(shipments), PACKAGE))


@dataclass(frozen=True)
class LaneStage:
    """What all lane operators read, written once for any number of scenarios.

    ``packages`` is bucketed by zip, order day and slice, so no scenario shuffles
    it again; ``hot`` lists the zips and days with several slices, if there are
    any; ``handling`` and ``flat`` are the rate cards that it took work to make.
    """

    packages: DataFrame
    hot: DataFrame | None
    handling: DataFrame
    flat: DataFrame
    cards: RateCards


def lane_stage(
    packages: DataFrame, shipments: DataFrame, cards: RateCards, name: str = "lanes"
) -> LaneStage:
    """Write the package stage below the shared folder and read it back.

    Slices come from the shipment rows by zip and day, before the packages are
    known, so stock and order lines are read once.
    """
    # Cards and keys need nothing of each other: their small jobs run side by side.
    with ThreadPoolExecutor() as pool:
        edges = pool.submit(band_edges, cards)
        flat = pool.submit(lambda: stored(flat_amounts(cards), f"{name}-flat"))
        hot, rows = _slices(shipments, name)
        edges, flat = edges.result(), flat.result()
    least = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-rows // PACKAGES_PER_BUCKET))
    sliced = salt(sized(packages, edges), LANE_KEYS, PACKAGE, hot)
    sliced = bucketed(sliced, f"{name}-packages", buckets, LANE_KEYS if hot is None else SLICE)
    handling = stored(handling_card(sliced, cards, edges), f"{name}-handling")
    # A row is a few numbers and two short names; larger cards are merge-joined.
    made = {"handling": handling, "flat": flat}
    fits = within_rows(made)
    made = {card: F.broadcast(df) if fits[card] else df for card, df in made.items()}
    return LaneStage(sliced, hot, **made, cards=cards)


def _slices(shipments: DataFrame, name: str) -> tuple[DataFrame | None, int]:
    """Zips and days with several slices, null if there is none, and all rows."""
    day = F.col("order_placed_ts").cast("date").alias("order_placed_date")
    keys = shipments.select("zip5", day).groupBy(*LANE_KEYS)
    keys = stored(keys.agg(F.count(F.lit(1)).alias("_rows")), f"{name}-keys")
    rows, most = keys.agg(F.sum("_rows"), F.max("_rows")).first()
    if (most or 0) <= PACKAGES_PER_SLICE:
        return None, rows or 0
    hot = slices_of(keys, LANE_KEYS, F.col("_rows"), PACKAGES_PER_SLICE)
    return stored(hot, f"{name}-hot"), rows


def package_lanes(stage: LaneStage, routes: DataFrame) -> DataFrame:
    """Every lane of ``routes`` open to a package, with what prices it.

    Only the routes move: they are copied to the slices of hot keys and meet the
    buckets of the stage, whose partitioning the lanes keep.  A merge join at any
    size, as broadcasting the packages would lose it.  Packages carry their FC set
    (at most one entry per FC), and what the result needs of them is computed
    before the lanes fan out.
    """
    packages = stage.packages.hint("merge")
    if stage.hot is None:
        lanes = packages.join(routes, LANE_KEYS)
    else:
        lanes = packages.join(salted_copies(routes, LANE_KEYS, stage.hot), SLICE)
    return lanes.where(F.array_contains("fcs", F.col("fc_name"))).drop("fcs")


def charged(lanes: DataFrame, stage: LaneStage) -> DataFrame:
    return priced(lanes, stage.cards, stage.handling, stage.flat)


def lane_cost(stage: LaneStage, ship_map: DataFrame) -> DataFrame:
    """Cost of every (package, FC, carrier, zone) lane open on the order day."""
    lanes = package_lanes(stage, priced_zones(ship_map)).drop(
        "release_seconds", "used", "outcomes"
    )
    columns = [
        *PACKAGE,
        "fc_name",
        "mode",
        F.col("cost_zone").alias("zone"),
        "total_amount",
    ]
    costs = charged(lanes, stage).select(*SLICE, *columns)
    return costs.distinct().drop(*SLICE)


def priced_options(
    stage: LaneStage, ship_map: DataFrame, distances: DataFrame
) -> DataFrame:
    """Every route of a package with its cost, one row for each price found."""
    lanes = package_lanes(stage, priced_routes(ship_map, distances))
    return charged(with_transit(lanes.drop("used", "outcomes")), stage).select(
        *LANE_GROUP,
        "fc_name",
        "mode",
        "routeid",
        "zone",
        "cost_zone",
        "preferred",
        "tnt",
        "distance",
        "total_amount",
    )


def lane_options(stage: LaneStage, ship_map: DataFrame, distances: DataFrame) -> DataFrame:
    """Every route a candidate FC could have used, with cost; lanes without cost stay.

    Prices that several entries of a card agree on are one option.
    """
    return priced_options(stage, ship_map, distances).distinct()


def ranked_options(
    stage: LaneStage, ship_map: DataFrame, distances: DataFrame
) -> DataFrame:
    """The options of each package in their order."""
    return rank_lanes(lane_options(stage, ship_map, distances), LANE_GROUP)


def choose_lane(stage: LaneStage, ship_map: DataFrame, distances: DataFrame) -> DataFrame:
    """The winning lane of each package; equal options need not be told apart."""
    ordered = Window.partitionBy(*LANE_GROUP).orderBy(*lane_order())
    options = priced_options(stage, ship_map, distances)
    return (
        options.withColumn("row_n", F.row_number().over(ordered))
        .where(F.col("row_n") == 1)
        .select(
            *PACKAGE,
            *LANE_KEYS,
            "fc_name",
            F.col("mode").alias("carrier_code"),
            "routeid",
            "zone",
            "total_amount",
            package.transit_penalty("tnt").alias("tnt_penalty"),
            "tnt",
            "distance",
        )
    )


def cost_neutral_fcs(
    stage: LaneStage, ship_map: DataFrame, distances: DataFrame
) -> DataFrame:
    """Per package the sorted FCs that cost the same as the winner, penalty included."""
    ranked = rank_lanes(priced_options(stage, ship_map, distances), LANE_GROUP)
    return (
        ranked.where(F.col("cost") == F.col("selected_cost"))
        .groupBy(*LANE_GROUP)
        .agg(F.array_sort(F.collect_set("fc_name")).alias("cost_neutral_fc"))
        .drop(*SLICE)
    )


def actual_cost(shipments: DataFrame, costs: DataFrame) -> DataFrame:
    """Cost of the lane each shipment row really used, where it was open."""
    used = shipments.select(*PACKAGE, "fc_name", "carrier_code")
    priced = costs.withColumnRenamed("mode", "carrier_code").drop("zone")
    return used.join(priced, [*PACKAGE, "fc_name", "carrier_code"], "left")


def routing_stage(
    shipments: DataFrame,
    order_lines: DataFrame,
    inventory: DataFrame,
    cards: RateCards,
    start,
    end,
    fcs=P.FCS,
) -> LaneStage:
    """The stage of the packages of the days, for all scenarios."""
    packages = served_packages(shipments, order_lines, inventory, start, end, fcs)
    return lane_stage(packages, shipments, cards, "routing")


def routing_result(
    stage: LaneStage, ship_map: DataFrame, distances: DataFrame
) -> DataFrame:
    """Chosen lane of every package next to what actually happened.

    A package has one chosen lane and as many rows as distinct shipment rows,
    whichever FC shipped them, times the costs of the lane really used.
    """
    lanes = package_lanes(stage, priced_routes(ship_map, distances)).drop("used")
    lane = F.struct(
        F.col("fc_name").alias("fc"),
        F.col("mode").alias("carrier"),
        F.col("total_amount").alias("amount"),
        "cost",
    )
    # The lanes go along with the ranks, so a package is passed through once; the
    # winner's row then finds the equally cheap and the really used ones in them.
    ranked = rank_lanes(
        charged(with_transit(lanes), stage), LANE_GROUP, {"lanes": F.collect_set(lane)}
    )
    as_cheap = F.filter("lanes", lambda p: p["cost"] == F.col("selected_cost"))
    neutral = F.array_sort(F.array_distinct(as_cheap["fc"]))
    really = F.filter(
        "lanes",
        lambda p: (p["fc"] == F.col("act.fc")) & (p["carrier"] == F.col("act.carrier")),
    )
    paid = F.explode_outer(F.array_distinct(really["amount"]))

    return (
        ranked.where(F.col("row_n") == 1)
        .withColumn("neutral", neutral)
        .withColumn("act", F.explode("outcomes"))
        .withColumn("paid", paid)
        .select(
            *PACKAGE,
            "zip5",
            "order_placed_date",
            F.col("fc_name").alias("sim_fc_name"),
            F.col("mode").alias("sim_carrier_code"),
            F.col("routeid").alias("sim_route"),
            F.col("total_amount").alias("sim_transit_cost"),
            F.col("tnt_penalty").alias("sim_tnt_penalty"),
            F.col("zone").alias("sim_zone"),
            F.col("tnt").alias("sim_tnt"),
            F.when(F.size("neutral") > 0, F.col("neutral")).alias("cost_neutral_fc"),
            F.col("act.fc").alias("act_fc_name"),
            F.col("act.carrier").alias("act_carrier_code"),
            F.col("act.route").alias("act_route"),
            F.col("paid").alias("act_transit_cost"),
            F.col("act.ship_date").alias("ship_date"),
            F.col("act.units").alias("units"),
            F.col("act.ctd").cast("int").alias("ctd"),
            F.col("act.std").cast("int").alias("std"),
            F.col("act.dea").cast("int").alias("dea_flag"),
        )
    )

"""Stage one and two: ship map of a scenario, then its counterfactual routing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lanewise import params as P
from lanewise.operators.lanes import LaneStage, routing_result, routing_stage
from lanewise.operators.rates import RateCards
from lanewise.operators.shipmap import ship_map_for
from lanewise.sources.writers import sink_partition_replace


@dataclass(frozen=True)
class RoutingTables:
    """Source tables of the routing stage."""

    shipments: DataFrame
    order_lines: DataFrame
    inventory: DataFrame
    ship_map_raw: DataFrame
    eligible_lanes: DataFrame
    removal_zips: DataFrame
    cards: RateCards
    distances: DataFrame


def scenario_ship_map(tables: RoutingTables, scenario: str, start, end) -> DataFrame:
    return ship_map_for(
        scenario,
        tables.ship_map_raw,
        start,
        end,
        eligible=tables.eligible_lanes,
        removal=tables.removal_zips,
    )


def package_stage(tables: RoutingTables, start, end, fcs=P.FCS) -> LaneStage:
    return routing_stage(
        tables.shipments,
        tables.order_lines,
        tables.inventory,
        tables.cards,
        start,
        end,
        fcs,
    )


def run_scenarios(
    tables: RoutingTables,
    path: str,
    start,
    end,
    params: P.RoutingParams = P.RoutingParams(),
) -> None:
    """Write ship map and routing of every scenario by day.

    The packages are staged once for all scenarios.  The ship map is read back
    from what was written, so the routing does not compute it again.
    """
    spark = tables.shipments.sparkSession
    stage = package_stage(tables, start, end, params.fcs)
    for scenario in params.scenarios:
        lanes = f"{path}/smf/{scenario}"
        sink_partition_replace(
            scenario_ship_map(tables, scenario, start, end), lanes, "shipdate"
        )
        routed = routing_result(stage, spark.read.parquet(lanes), tables.distances)
        sink_partition_replace(
            routed, f"{path}/simulations/{scenario}", "order_placed_date"
        )

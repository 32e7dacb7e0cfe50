"""Target share to zips: score, cut by volume, splice, measure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions import numbers
from lanewise.operators import whatif
from lanewise.operators.scoring import expansion_score, remediation_score, target_change
from lanewise.operators.zips import cut_by_volume, distinct_zips
from lanewise.sources.shared import stored
from lanewise.sources.writers import replaced


def planned_zips(scored: DataFrame, target: DataFrame) -> DataFrame:
    """Zips within the volume of the one-row target frame."""
    return distinct_zips(cut_by_volume(scored, target.scalar()))


def planned_result(
    base: DataFrame,
    choices: list[tuple[DataFrame, DataFrame]],
    target: DataFrame,
) -> DataFrame:
    """Baseline spliced with each scenario for its zips within the target."""
    return whatif.splice_scenario(
        base, [(scenario, planned_zips(scored, target)) for scenario, scored in choices]
    )


def planning_metrics(base: DataFrame, final: DataFrame, proxy: DataFrame) -> dict:
    """The five metrics, from one pass over the packages of each result.

    All count packages by day, FC and carrier, so these are written first, tracking
    numbers that have the same of them as one.
    """
    base = stored(whatif.lanes_alike(base), "planning-base")
    final = stored(whatif.lanes_alike(final), "planning-final")
    return {
        "carrier_change": whatif.carrier_change(base, final),
        "fc_carrier_change": whatif.fc_carrier_change(base, final),
        "carrier_change_proxy": whatif.carrier_change_proxy(base, final, proxy),
        "fc_carrier_change_proxy": whatif.fc_carrier_change_proxy(base, final, proxy),
        "fc_charge_change": whatif.fc_charge_change(base, final),
    }


def date_span(base: DataFrame) -> DataFrame:
    """First and last order day, one row."""
    return base.agg(
        F.min("order_placed_date").alias("first_date"),
        F.max("order_placed_date").alias("last_date"),
    )


def realised_share(change: DataFrame, challenger=P.CHALLENGER) -> DataFrame:
    """Share the challenger reaches, to one decimal, one row."""
    return change.where(F.col("sim_carrier_code") == challenger).select(
        numbers.half_even("iter_percent", 1).alias("realised_share")
    )


@dataclass(frozen=True)
class PlanningTables:
    """What a planning run reads, limited to its days."""

    base: DataFrame
    remediate: DataFrame
    expand: DataFrame
    ship_map_base: DataFrame
    ship_map_expanded: DataFrame
    proxy: DataFrame


def run_planning(
    tables: PlanningTables,
    path: str,
    run_name: str,
    params: P.PlanningParams = P.PlanningParams(),
) -> list[int]:
    """Cut the scored zips at each package change, and write what it does.

    Without ``package_changes`` the one change is what the challenger lacks to
    its ``target_share``.  Scores, chosen zips, spliced results and the five
    metrics stand below ``path`` by run and package change; days, target and
    realised share are columns of them.  Returns the package changes.
    """
    scored = {}
    if params.remediation:
        scores = remediation_score(tables.base, params.remediation_weights)
        scored["remediation"] = (tables.remediate, scores)
    if params.expansion:
        scores = expansion_score(
            tables.base,
            tables.expand,
            tables.ship_map_base,
            tables.ship_map_expanded,
            params.fc_switch_threshold,
            params.expansion_weights,
        )
        scored["expansion"] = (tables.expand, scores)

    def kept(df: DataFrame, name: str, *by: str, gather: bool = True) -> DataFrame:
        """Write the partitions of the run and read them back."""
        named = df.withColumn("run_name", F.lit(run_name))
        back = replaced(named, f"{path}/{name}", "run_name", *by, gather=gather)
        return back.where(F.col("run_name") == run_name)

    scored = {
        side: (scenario, kept(df, f"scores_{side}")) for side, (scenario, df) in scored.items()
    }
    changes = list(params.package_changes)
    if not changes:
        changes = [int(target_change(tables.base, params.target_share).first()[0])]
    span = date_span(tables.base).first()
    for change in changes:

        def tagged(df: DataFrame, realised=None, change=change) -> DataFrame:
            return df.withColumns(
                {
                    "package_change": F.lit(change).cast("bigint"),
                    "first_date": F.lit(span["first_date"]).cast("date"),
                    "last_date": F.lit(span["last_date"]).cast("date"),
                    "target_share": F.lit(float(params.target_share)),
                    "realised_share": F.lit(realised).cast("double"),
                }
            )

        def mine(df: DataFrame, change=change) -> DataFrame:
            return df.where(F.col("package_change") == change)

        choices = []
        for side, (scenario, scores) in scored.items():
            zips = kept(tagged(cut_by_volume(scores, change)), f"zips_{side}", "package_change")
            choices.append((scenario, mine(zips)))
        spliced = whatif.splice_scenario(tables.base, choices)
        final = kept(tagged(spliced), "simulation_output", "package_change", gather=False)
        final = mine(final)
        final = final.select(*spliced.columns)
        metrics = planning_metrics(tables.base, final, tables.proxy)
        share = realised_share(metrics["carrier_change"]).first()
        realised = share["realised_share"] if share else None
        for name, df in metrics.items():
            kept(tagged(df, realised), f"metrics/{name}", "package_change")
    return changes

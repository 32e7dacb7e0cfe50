"""The weekly check of the counterfactual against what really happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.operators import fidelity
from lanewise.sources.writers import sink_replace_by_week

TABLES = ("carrier_before", "carrier_after", "region", "fc")


def fidelity_frames(
    routing: DataFrame, routed_daily: DataFrame, proxy: DataFrame
) -> dict[str, DataFrame]:
    """The four comparisons of the latest week, by name."""
    frames = (
        fidelity.fidelity_carrier_before(routing, routed_daily),
        fidelity.fidelity_carrier_after(routing, proxy),
        fidelity.fidelity_region(routing),
        fidelity.fidelity_fc(routing),
    )
    return dict(zip(TABLES, frames))


def run_fidelity(
    routing: DataFrame, routed_daily: DataFrame, proxy: DataFrame, path: str, run_at
) -> None:
    """Write the four comparisons; a week already there is replaced."""
    moment = F.lit(run_at).cast("timestamp")
    for name, df in fidelity_frames(routing, routed_daily, proxy).items():
        sink_replace_by_week(df.withColumn("run_dttm", moment), f"{path}/{name}")

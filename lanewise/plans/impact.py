"""Effect of switching the zips of an outside list; values are units."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lanewise.operators import whatif
from lanewise.sources.shared import stored


def impact_metrics(
    base: DataFrame, choices: list[tuple[DataFrame, DataFrame]], proxy: DataFrame
) -> dict[str, DataFrame]:
    """Metric frames when each scenario replaces the baseline in its zips.

    A zip listed twice counts once.  The spliced result is written first and
    read back by the metrics.
    """
    custom = stored(whatif.splice_scenario(base, choices), "impact")
    return {
        "carrier_change": whatif.carrier_change(base, custom),
        "carrier_change_proxy": whatif.carrier_change_proxy(base, custom, proxy),
        "cost_change": whatif.cost_change(base, custom),
        "fc_charge_change": whatif.fc_charge_change(base, custom, "units", "sum"),
        "fc_flow": whatif.fc_flow(base, custom, "units", "sum"),
        "fc_carrier_flow": whatif.fc_carrier_flow(base, custom, "units", "sum"),
        "tnt_change": whatif.tnt_change(base, custom),
    }

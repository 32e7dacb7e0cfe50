"""The daily signals of the execution run, as day partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lanewise import params as P
from lanewise.functions import calendar
from lanewise.operators import signals
from lanewise.sources.writers import sink_partition_replace


def run_signals(
    service_failures: DataFrame,
    station_backlog: DataFrame,
    station_zip_a: DataFrame,
    station_zip_b: DataFrame,
    path: str,
    run_date,
    params: P.SignalParams = P.SignalParams(),
) -> None:
    """Write service rates and backlog of the days up to the run day, it included."""
    start, end = calendar.lookback_window(run_date, params.lookback_days, end_offset=0)
    service = signals.service_rate(service_failures, start, end, params.fcs)
    sink_partition_replace(service, f"{path}/unpadded_dea", "unpadded_edd")
    backlog = signals.zip_backlog(station_backlog, station_zip_a, station_zip_b, start, end)
    sink_partition_replace(backlog, f"{path}/backlog", "date")

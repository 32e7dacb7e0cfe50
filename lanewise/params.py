"""Fixed values and default parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values -----------------------------------------------------------
INCUMBENT = "FDXHD"
CHALLENGER = "ONTRGD"
CARRIERS = ("FDXHD", "ONTRGD")

# Carrier names in the station feed, by carrier code.
CARRIER_NAMES = {"FedEx": "FDXHD", "OnTrac": "ONTRGD"}
INCUMBENT_NAME = "FedEx"
CHALLENGER_NAME = "OnTrac"

FC_REGIONS = {
    "NorthEast": ("AVP1", "AVP2", "MDT1"),
    "Central": ("CFC1", "DAY1", "DFW1", "HOU1", "MCI1"),
    "SouthEast": ("BNA1", "CLT1", "MCO1"),
    "West": ("PHX1", "RNO1"),
}
FCS = tuple(sorted(fc for group in FC_REGIONS.values() for fc in group))

# FCs preferred when two lanes cost the same.
PREFERRED_FCS = ("AVP2", "BNA1", "HOU1", "MCI1", "RNO1")

# FC whose eligible lanes are left out of the expanded ship map.
EXPANSION_EXCLUDED_FCS = ("HOU1",)

# Penalty per transit time in days; more days than listed cost the last value.
TRANSIT_PENALTY = {2: 2.1, 3: 2.4, 4: 2.8, 5: 3.6, 6: 35.1, 7: 36.1, 8: 37.1, 9: 38.1}

SHIP_MAP_DAYS_AHEAD = 3
STANDARD_ITEM = "N"
ROUTED_ITEM = "NORMAL"
DIM_DIVISOR = 166
ADDRESS_CORRECTION = 0.01
UNKNOWN_DISTANCE = 10000.0
ADDITIONAL_HANDLING_MINIMUM_FROM = "2025-01-13"
BUSINESS_DAY_SHIFT_HOURS = 4
OPEN_END = "9999-12-31"
NONE = "None"
ALL_ZIPS = 999999
FLOW_TARGETS = 4


# --- Defaults ---------------------------------------------------------------
@dataclass(frozen=True)
class RoutingParams:
    fcs: tuple = FCS
    carriers: tuple = CARRIERS
    scenarios: tuple = ("baseline", "remediation")
    lookback_days: int = 7


@dataclass(frozen=True)
class SignalParams:
    fcs: tuple = FCS
    lookback_days: int = 14
    backlog_lookback_days: int = 3


@dataclass(frozen=True)
class ExecutionParams:
    run_name: str = "default"
    expansion: bool = False
    remediation: bool = True
    lookback_days: int = 7
    zip_counts: tuple = ()
    zip_volume_floor: float | None = 25
    fc_switch_threshold: float | None = 0.15
    service_threshold: float = 0.9
    service_lookback_days: int = 7
    minimum_service_days: int = 3
    backlog_threshold: float = 0.5
    clear_date_threshold: float = 1
    default_transit_days: float = 2
    history_days: int = 60
    switch_for_inactive: bool = False
    weights: dict = field(
        default_factory=lambda: {"volume": 0.65, "service": 0.25, "backlog": 0.1}
    )


@dataclass(frozen=True)
class PlanningParams:
    expansion: bool = True
    remediation: bool = False
    fc_switch_threshold: float = 0.1
    target_share: float = 0.18
    package_changes: tuple = ()
    remediation_weights: dict = field(
        default_factory=lambda: {"service": 0.7, "cost": 0.2, "transit": 0.1}
    )
    expansion_weights: dict = field(
        default_factory=lambda: {"cost": 0.7, "transit": 0.3}
    )

"""Test inputs, registered queries and their SQL checks."""

from __future__ import annotations

import importlib

MODULES = (
    "routing_checks",
    "signal_checks",
    "whatif_checks",
    "scalar_checks",
    "source_checks",
    "run_checks",
)


def load():
    """Import every module of checks; returns the registry."""
    for name in MODULES:
        importlib.import_module(f"checks.{name}")
    return importlib.import_module("checks.registry")

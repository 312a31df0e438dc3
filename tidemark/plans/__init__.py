"""Modules that register queries."""

import importlib

MODULES: list[str] = ["state", "profiles", "reports", "matching", "network", "forecast", "ingest", "streams", "labels", "canonical", "reconcile", "priors", "tuning", "inheritance", "texts", "regimes", "months"]


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"tidemark.plans.{name}")

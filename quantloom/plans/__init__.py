"""Registered queries over the driver's tables, with their oracles."""

from quantloom.plans.registry import ORACLES, QUERIES

MODULES = ("tape_queries", "feature_queries", "signal_queries", "evaluation_queries", "cross_queries", "stateful_queries", "source_queries", "search_queries")


def _load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"quantloom.plans.{name}")


def queries() -> dict:
    _load()
    return QUERIES


def oracle_sql() -> dict:
    _load()
    return ORACLES

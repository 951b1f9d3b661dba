"""Registered queries over the driver tables."""

from importlib import import_module

MODULES = ["offer_queries", "alert_queries", "source_queries", "text_queries", "calendar_queries", "stored_queries", "state_queries"]


def load():
    for name in MODULES:
        import_module(f"offerloom.queries.{name}")
    from offerloom.queries.base import REGISTRY

    return REGISTRY

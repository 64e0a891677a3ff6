"""Registered queries."""

import importlib
import os

FAMILIES = ("scalar", "signal_queries", "trigger_queries", "cache_queries", "join_queries", "aggregate_queries",
            "ranking_queries", "source_queries", "stream_queries")


def load():
    """Import every family and return the registry."""
    here = os.path.dirname(__file__)
    for name in FAMILIES:
        if os.path.exists(os.path.join(here, name + ".py")):
            importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")

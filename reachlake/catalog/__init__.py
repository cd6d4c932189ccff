"""Registered queries over the input tables."""

import importlib

MODULES = ["transit_queries", "feed_queries", "geo_queries", "graph_queries", "bike_queries"]


def all_queries():
    from reachlake.catalog import registry

    for name in MODULES:
        importlib.import_module(f"reachlake.catalog.{name}")
    return registry.QUERIES, registry.ORACLES

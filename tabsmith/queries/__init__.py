"""Registered queries, one module per family."""

import importlib

FAMILIES = [
    "sources",
    "cleaning",
    "dates",
    "imputation",
    "features",
    "profiling",
    "charts",
    "series",
    "forecasts",
    "learning",
    "streams",
]


def load_all():
    for family in FAMILIES:
        importlib.import_module(f"tabsmith.queries.{family}")
    return importlib.import_module("tabsmith.queries.registry")

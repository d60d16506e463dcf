"""Queries over the given tables, grouped by subject."""

import importlib

GROUPS = ["fits", "linework", "network", "imagery", "documents", "raster", "streams"]


def load_queries() -> None:
    for name in GROUPS:
        importlib.import_module(f"cairnfield.plans.{name}")

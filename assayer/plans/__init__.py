"""Queries over the given tables, one module per family; each registers a Spark callable and its SQL."""

import importlib

from assayer.plans.registry import ORACLE, QUERIES

FAMILIES = ("forecasting", "identity", "quality", "profiles", "association", "target", "structure", "splits", "evaluation", "smoothing", "models",
            "stateless_streams", "stateful_streams", "lattice", "asof", "jsonprofile", "sketches")
for _family in FAMILIES:
    importlib.import_module(f"assayer.plans.{_family}")

from assayer.plans.forecasting import flagship  # noqa: E402

__all__ = ["ORACLE", "QUERIES", "flagship"]

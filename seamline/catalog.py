"""Every query by name, with its SQL: importing this loads all modules that register some."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

#: Modules that register queries.
PLANS = ("relational", "text", "guard", "extraction", "similarity", "validation", "routing", "retrieval", "graph", "memory", "federation", "streams", "stores")


def _load() -> None:
    for name in PLANS:
        importlib.import_module(f"{__package__}.plans.{name}")


_load()

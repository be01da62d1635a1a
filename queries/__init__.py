"""Queries over the driver tables, one per operator, each with the same result stated as DuckDB SQL where SQL can."""

from __future__ import annotations

import importlib

from queries.base import ORACLES, QUERIES

MODULES = ("planning", "sources", "scalars", "resolving", "library", "text", "rasters", "reports", "streams")


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"queries.{name}")
    return QUERIES, ORACLES

"""Names of all queries of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib

MODULES: list[str] = ["sampling", "statistics", "quality", "text", "matching", "geometry", "graph", "streams", "stages", "listings", "outlines"]


def _modules():
    return [importlib.import_module(f"tessella.plans.{name}") for name in MODULES]


def queries() -> dict:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}

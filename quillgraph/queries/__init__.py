"""Registered queries for the graph engine's operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

MODULES = ["graphs", "texts", "resolution", "artifacts", "statistics", "evaluations", "projects"]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").ORACLES.items()}

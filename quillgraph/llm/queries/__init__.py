"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = [f"op{n}" for n in range(1, 11)]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").ORACLES.items()}

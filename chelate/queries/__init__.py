"""Queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("analytics", "strings", "structures", "evaluation", "molecules", "models")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"chelate.queries.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"chelate.queries.{m}").ORACLES.items()}

"""The queries of the engine, bound to the driver's tables, each with SQL that has its rows where SQL can."""

from __future__ import annotations

from importlib import import_module

from . import bind

MODULES = ("temporal", "rules", "summary", "catalog", "archive")


def _load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def queries() -> dict:
    _load()
    return bind.QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return bind.ORACLES

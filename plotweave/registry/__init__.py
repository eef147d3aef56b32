"""Registered queries: each one a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from plotweave.registry import base


def _load() -> None:
    from importlib import import_module
    from pkgutil import iter_modules

    for module in sorted(m.name for m in iter_modules(__path__) if m.name != "base"):
        import_module(f"{__name__}.{module}")


def spark_queries() -> dict:
    _load()
    return {name: base.runner(entry) for name, entry in base.ENTRIES.items()}


def sql_queries() -> dict[str, str]:
    _load()
    return {name: entry.sql for name, entry in base.ENTRIES.items() if entry.sql}

"""Registered queries: test-table bindings, Spark callables and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("feeds", "linkdata", "geo", "tables", "graph", "model", "files", "streams")


def load():
    """All queries and SQL twins by name."""
    from . import registry
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLES

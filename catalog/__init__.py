"""Registered queries and their SQL counterparts, one module per operator family."""

from importlib import import_module

MODULES = ["scans", "sinks", "filters", "joins", "neighbours", "aggregates", "windows",
           "sets", "compare", "vectors", "scalars", "graphs", "scoring", "synthesis", "streams"]


def _load(attr):
    out = {}
    for name in MODULES:
        part = getattr(import_module(f"catalog.{name}"), attr)
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries():
    return _load("QUERIES")


def oracle_sql():
    return _load("ORACLE")

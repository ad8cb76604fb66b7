"""Registered queries: each catalog module pairs Spark queries with DuckDB oracles."""
from __future__ import annotations

import importlib

MODULES = ["profiling", "evaluation", "privacy", "exploration", "cleaning", "monitoring", "balance", "featuring", "workspace", "sources", "streams", "advice", "modeling"]


def all_queries() -> dict:
    out = {}
    for m in MODULES:
        out.update(importlib.import_module(f"{__name__}.{m}").QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"{__name__}.{m}"), "ORACLE", {}))
    return out

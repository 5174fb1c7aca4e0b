"""All registered queries: name → (spark query, optional DuckDB SQL)."""

from __future__ import annotations

import importlib

MODULES = ["profiles", "columns", "rows", "features", "models", "logs", "misc"]


def _registries():
    for m in MODULES:
        yield importlib.import_module(f"cirrus.registry.{m}").reg


def all_queries():
    out = {}
    for r in _registries():
        for k, v in r.queries.items():
            if k in out:
                raise ValueError(f"duplicate query {k}")
            out[k] = v
    return out


def all_sql():
    out = {}
    for r in _registries():
        out.update(r.sql)
    return out

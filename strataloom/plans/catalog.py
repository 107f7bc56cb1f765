"""All queries of the core library and their SQL, gathered from the query modules."""

from __future__ import annotations

import importlib
import pkgutil

from strataloom import plans


def _modules():
    for info in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        if info.name.startswith("q_"):
            yield importlib.import_module(f"{plans.__name__}.{info.name}")


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.SQL)
    return out

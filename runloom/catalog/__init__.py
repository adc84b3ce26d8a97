"""The queries bound to the test tables, with their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import QUERIES, SQL


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(SQL)

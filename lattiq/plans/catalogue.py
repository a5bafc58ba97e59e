"""The catalogue of queries over the driver's tables, with their SQL."""

from __future__ import annotations

import importlib

MODULES = ("cube_queries", "peak_queries", "polar_queries", "composed_queries", "kernel_queries")


def _all() -> dict:
    found: dict = {}
    for name in MODULES:
        part = importlib.import_module(f"lattiq.plans.{name}").QUERIES
        if twice := found.keys() & part.keys():
            raise ValueError(f"two queries are named {twice}")
        found |= part
    return found


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql is not None}

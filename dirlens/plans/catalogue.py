"""Registered queries and their SQL twins, collected from the modules beside this one."""

from __future__ import annotations

import importlib

MODULES = ("tree_queries", "usage_queries", "event_queries")


def _all():
    return [importlib.import_module(f"dirlens.plans.{m}") for m in MODULES]


def queries():
    return {name: f for m in _all() for name, (f, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _all() for name, (_, sql) in m.QUERIES.items() if sql}

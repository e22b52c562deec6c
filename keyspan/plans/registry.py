"""Collects the registered queries of every catalog module."""

from __future__ import annotations

import importlib

CATALOG_MODULES = (
    "keyspan.plans.catalog",
    "keyspan.plans.catalog_capacity",
    "keyspan.plans.catalog_reports",
    "keyspan.plans.catalog_jobs",
    "keyspan.plans.catalog_moves",
    "keyspan.plans.catalog_state",
)


def _load():
    for m in CATALOG_MODULES:
        importlib.import_module(m)
    from keyspan.plans.catalog import ORACLE, QUERIES
    return QUERIES, ORACLE


def all_queries():
    return dict(_load()[0])


def all_oracle_sql():
    return dict(_load()[1])

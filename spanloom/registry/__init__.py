"""Every registered query with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

from spanloom.session import prepare

MODULES = ("core", "platforms", "jobs", "scalars", "reconcile", "live", "logs", "trees")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"spanloom.registry.{module}"), name)
    return out


def all_queries() -> dict:
    def prepared(query):
        return lambda spark, sf_dir: query(prepare(spark), sf_dir)

    return {name: prepared(query) for name, query in _merged("QUERIES").items()}


def all_oracles() -> dict:
    return _merged("ORACLE")

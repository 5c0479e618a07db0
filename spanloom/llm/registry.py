"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("bpe", "chaining", "decontam", "importance", "langid", "lines", "merkle", "minhash", "pii", "quality", "rollup", "sharding", "suffixes")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"spanloom.llm.{module}"), name, {})
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLE")

"""Registered queries: each module holds QUERIES (name -> callable(spark, sf_dir)) and SQL (name -> DuckDB text)."""

from importlib import import_module
from types import ModuleType

NAMES = ("numbered", "retrieval", "tables", "triage", "quality", "sources")


def modules() -> list[ModuleType]:
    return [import_module(f"lodestrata.plans.{name}") for name in NAMES]

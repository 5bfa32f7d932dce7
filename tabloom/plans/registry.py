"""Name -> (Spark query, oracle SQL) table."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = ("fidelity", "cleaning", "profiling", "encoding", "scaling", "splitting", "augmenting",
           "scoring", "ranking", "noise", "private", "generation", "training", "storage", "streams")


@dataclass(frozen=True)
class Entry:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register a query that covers the inventory rows `ids`."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, ids, fn, sql)
        return fn

    return add


def load_all() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"tabloom.plans.{module}")
    return REGISTRY

"""Registered queries, each with the DuckDB statement that must give the same rows."""

from tabloom.plans.registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]

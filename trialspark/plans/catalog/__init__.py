"""Registered queries with their SQL oracles, one module per operator family."""

from trialspark.plans.catalog import (  # noqa: F401
    checks,
    derivations,
    joins,
    models,
    sequences,
    sources,
    survival,
    tables,
)
from trialspark.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Predicates that never evaluate to null.

A missing value is itself a finding in trial data, so every conformance predicate says
explicitly what a null means instead of letting three-valued logic drop the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

__all__ = ["holds", "not_in_set", "outside", "not_before", "differs", "indicator", "yn_flag"]


def holds(predicate: Column) -> Column:
    """True where the predicate is true; false where it is false or unknown."""
    return F.coalesce(predicate, F.lit(False))


def indicator(predicate: Column) -> Column:
    """1 where the predicate holds, else 0 (also for unknown)."""
    return F.when(predicate, 1).otherwise(0)


def yn_flag(predicate: Column) -> Column:
    """'Y' where the predicate holds, else 'N' (also for unknown)."""
    return F.when(predicate, "Y").otherwise("N")


def not_in_set(value: Column, allowed: Sequence) -> Column:
    """True where the value is missing or not in the allowed list."""
    return ~holds(value.isin(*allowed))


def outside(value: Column, low, high) -> Column:
    """True where the value is missing or lies outside [low, high]."""
    return ~holds(value.between(low, high))


def not_before(start: Column, end: Column) -> Column:
    """True where start >= end; a missing end always counts, a missing start alone never."""
    return F.when(end.isNull(), True).when(start.isNull(), False).otherwise(start >= end)


def differs(value: Column, other) -> Column:
    """True where the value is not the other one; a missing value differs."""
    return ~value.eqNullSafe(F.lit(other))

"""Exact order statistics without collecting a group.

The built-in exact median keeps all distinct values of a group in one buffer. Here the values
of a group are counted (partially before the shuffle), running counts are formed in ranges,
and the value at a rank is the one whose running count first reaches it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trialspark.operators.numbering import running
from trialspark.sources.workspace import settle


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Rows per group and distinct non-null value (columns VALUE and N), computed once."""
    return settle(
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("VALUE"))
        .agg(F.count(F.lit(1)).alias("N"))
    )


def median_of_counts(
    counts: DataFrame, group: Sequence[str], name: str = "MEDIAN", **limits
) -> DataFrame:
    """Median per group (mean of the two middle values) from value counts."""
    group = list(group)
    ranked = running(
        counts, group, "VALUE", {"__upto": F.col("N")}, group_totals={"__size": "__upto"},
        **limits,
    )
    below, upto, size = F.col("__upto") - F.col("N"), F.col("__upto"), F.col("__size")
    lower, upper = F.floor((size + 1) / 2), F.floor(size / 2) + 1
    holds_lower, holds_upper = ((below < r) & (r <= upto) for r in (lower, upper))
    return (
        ranked.filter(holds_lower | holds_upper)
        .groupBy(*group)
        .agg(
            F.max(F.when(holds_lower, F.col("VALUE"))).alias("__lo"),
            F.max(F.when(holds_upper, F.col("VALUE"))).alias("__hi"),
        )
        .select(*group, ((F.col("__lo") + F.col("__hi")) / 2).alias(name))
    )


def exact_median(
    df: DataFrame, group: Sequence[str], value: str, name: str = "MEDIAN", **limits
) -> DataFrame:
    """Median per group; nulls are ignored."""
    return median_of_counts(value_counts(df, group, value), group, name, **limits)


def most_frequent(
    df: DataFrame, group: Sequence[str], value: str, name: str = "MODE"
) -> DataFrame:
    """Most frequent value per group, the smallest on a tie; nulls are ignored."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    best = F.min(F.struct((-F.col("__n")).alias("__n"), F.col(value).alias("__value")))
    return counts.groupBy(*group).agg(best["__value"].alias(name))

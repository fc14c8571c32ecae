"""Keys that hold more than their share of the rows of a window.

Whether any key is over-full is found by counting rows per key before the plan is built. The
usual answer is "none", and then the plan is an ordinary window. Otherwise the list of over-full
keys, whose length is bounded, becomes a small table in the plan. Joins need none of this:
adaptive execution splits their skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# A key is split when it has more rows than both limits: MIN_SPLIT_ROWS and 1/SLICES of all
# rows. So at most SLICES keys are split, into at most 2 * SLICES parts in total: tables of
# split keys or of their parts are small enough to broadcast at any data size.
SLICES = 16384
MIN_SPLIT_ROWS = 1_000_000

ROWS, PARTS = "__grp_rows", "__grp_parts"


@dataclass(frozen=True)
class LargeGroups:
    """Over-full groups: their key columns, rows and number of parts; at most SLICES of them."""

    group: tuple[str, ...]
    table: DataFrame

    def attach(self, df: DataFrame) -> DataFrame:
        """Add the group's numbers to the rows of over-full groups, nulls to all others."""
        twins = self.table.withColumnsRenamed({c: "__h_" + c for c in self.group})
        return df.join(F.broadcast(twins), same(self.group, "__h_"), "left").drop(
            *["__h_" + c for c in self.group]
        )


def same(columns: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of columns with their prefixed twins."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(prefix + c))
    return out


def large_groups(
    df: DataFrame,
    group: Sequence[str],
    min_rows: int = MIN_SPLIT_ROWS,
    slices: int = SLICES,
) -> LargeGroups | None:
    """Groups to split, or None. Counts rows per group, with partial counts before the shuffle."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias(ROWS))
    whole = sizes.agg(F.max(ROWS).alias("most"), F.sum(ROWS).alias("all")).first()
    if whole["most"] is None or whole["most"] <= min_rows:
        return None
    unit = max(float(min_rows), whole["all"] / slices)
    split = sizes.filter(F.col(ROWS) > unit).withColumn(
        PARTS, F.ceil(F.col(ROWS) / unit).cast("int")
    )
    found = split.collect()
    if not found:
        return None
    return LargeGroups(tuple(group), df.sparkSession.createDataFrame(found, split.schema))

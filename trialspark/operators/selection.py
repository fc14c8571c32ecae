"""Weighted selection inside groups without sorting a group.

The place in an ordering at which a running total reaches a wanted amount is found digit by digit: sums per leading
digit of the key, the digit in which the amount is reached, then the same inside that digit. Only sums are shuffled,
at most 2^16 of them for each group and step; rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.operators.skew import same

DIGIT_BITS = 16
CUT, REST = "__cut", "__rest"


def cut_points(
    rows: DataFrame, group: Sequence[str], key: str, wanted: DataFrame, amount: str, weight: Column | None = None,
    bits: int = 63, few: bool = True,
) -> DataFrame:
    """group, CUT and REST of the groups whose total exceeds the wanted amount.

    CUT is the smallest key at which the running total, in the order of ``key``, exceeds the amount; REST is what is
    left of the amount before the rows with that key. ``key`` is a whole number from 0 to 2^bits - 1 and ``weight``
    (1 if not given) is not negative. ``wanted`` has one row (group, amount) per group; ``few`` says that it is known to
    be small, and then it is broadcast. ``rows`` is read once per step of 16 bits.
    """
    group = list(group)
    sent = F.broadcast if few else (lambda df: df)
    held = rows.select(*group, F.col(key).cast("long").alias("__key"), (F.lit(1) if weight is None else weight).alias("__weight"))
    open_ = wanted.select(*[F.col(c).alias("__w_" + c) for c in group], F.lit(0).cast("long").alias("__lead"), F.col(amount).alias(REST))
    shift = bits
    while shift > 0:
        above, shift = shift, max(0, shift - DIGIT_BITS)
        inside = held.join(
            sent(open_), same(group, "__w_") & (F.shiftright("__key", above) == F.col("__lead") if above < 63 else F.lit(True)))
        sums = inside.groupBy(*group, F.shiftright("__key", shift).alias("__digit")).agg(
            F.sum("__weight").alias("__n"), F.first(REST).alias(REST))
        upto = F.sum("__n").over(Window.partitionBy(*group).orderBy("__digit").rowsBetween(Window.unboundedPreceding, 0))
        reached = sums.withColumn("__upto", upto).filter(F.col("__upto") > F.col(REST))
        first = F.min(F.struct("__digit", (F.col(REST) - F.col("__upto") + F.col("__n")).alias(REST)))
        open_ = reached.groupBy(*group).agg(first.alias("__first")).select(
            *[F.col(c).alias("__w_" + c) for c in group], F.col("__first.__digit").alias("__lead"), F.col(f"__first.{REST}").alias(REST))
    return open_.select(*[F.col("__w_" + c).alias(c) for c in group], F.col("__lead").alias(CUT), REST)

"""Set operations, reshaping, ordering, top rows and sampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def pivot_wide(
    df: DataFrame, ids: Sequence[str], name: str, value: str, values: Sequence, fill=None
) -> DataFrame:
    """Long to wide. The new columns are given, so no job is needed to find them."""
    wide = df.groupBy(*ids).pivot(name, list(values)).agg(F.first(value, ignorenulls=True))
    return wide if fill is None else wide.fillna(fill, [str(v) for v in values])


def pivot_long(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    name: str = "FEATURE",
    value: str = "VALUE",
    dtype: str = "double",
) -> DataFrame:
    """Wide to long, with the values cast to one type."""
    cast = df.select(*ids, *[F.col(c).cast(dtype).alias(c) for c in columns])
    return cast.unpivot(list(ids), list(columns), name, value)


def ordered(df: DataFrame, keys: Sequence) -> DataFrame:
    """Total order by range partitions."""
    return df.orderBy(*keys)


def head_rows(df: DataFrame, order: Sequence, n: int = 20) -> DataFrame:
    """First n rows in an order; each task keeps only n rows."""
    return df.orderBy(*order).limit(n)


def best_model(metrics: DataFrame, metric: str = "ROC_AUC", name: str = "MODEL") -> DataFrame:
    """Row with the largest metric; the first name on a tie."""
    return metrics.orderBy(F.desc_nulls_last(metric), F.asc(name)).limit(1)


def hash_text(key: str, seed: int):
    """Hex digest of seed and key: the same in any partitioning and on any run."""
    return F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))


def hash_number(key: str, seed: int):
    """First 32 bits of the digest as a number in [0, 2^32)."""
    return F.conv(F.substring(hash_text(key, seed), 1, 8), 16, 10).cast("long")


def sample_subjects(df: DataFrame, n: int = 80, key: str = "USUBJID", seed: int = 42) -> DataFrame:
    """Reproducible random sample of n rows."""
    digest = hash_text(key, seed)
    return df.orderBy(digest, key).limit(n)

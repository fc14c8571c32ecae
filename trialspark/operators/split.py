"""Reproducible train/test split and cross-validation folds.

Membership depends only on a hash of the subject key, never on row order or partitioning, so
a retried task or another cluster size gives the same parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from trialspark.operators.numbering import numbered
from trialspark.operators.reshape import hash_number
from trialspark.operators.selection import CUT, REST, cut_points
from trialspark.sources.workspace import settle


def stratified_split(
    df: DataFrame,
    target: str = "DPTN",
    share: float = 0.70,
    seed: int = 42,
    key: str = "USUBJID",
    exact: bool = True,
    part: str = "PART",
) -> DataFrame:
    """Add 'train' or 'test'.

    The first ``share`` of each class by hash is taken, so both parts hold the same mix of classes; where it ends
    is found from counts per leading bits of the hash, so no class is sorted and no row is moved. ``key`` identifies a
    row. Without ``exact`` a row is in training when its hash lies in the first share of the hash range: one pass,
    but the classes keep the share only up to random variation.
    """
    if not exact:
        limit = int(share * 2**32)
        return df.withColumn(
            part, F.when(hash_number(key, seed) < limit, "train").otherwise("test")
        )
    rows = settle(df.withColumn("__h", hash_number(key, seed)))
    quota = rows.groupBy(target).agg(F.floor(F.count(F.lit(1)) * share).alias("__quota"))
    cut = settle(cut_points(rows, [target], "__h", quota, "__quota", bits=32).withColumnRenamed(target, "__c_class"))
    cut = F.broadcast(cut)  # a row per class
    own = F.col(target).eqNullSafe(F.col("__c_class"))
    ties = rows.join(cut, own & (F.col("__h") == F.col(CUT)))  # rows with the hash of the cut: one, seldom more
    place = F.row_number().over(Window.partitionBy("__c_class").orderBy(key))
    last = F.broadcast(
        ties.select("__c_class", key, REST, place.alias("__i")).filter(F.col("__i") <= F.col(REST))
        .groupBy(F.col("__c_class").alias("__l_class")).agg(F.max(key).alias("__last")))
    before = F.col(CUT).isNull() | (F.col("__h") < F.col(CUT)) | ((F.col("__h") == F.col(CUT)) & (F.col(key) <= F.col("__last")))
    marked = rows.join(cut, own, "left").join(last, F.col("__c_class").eqNullSafe(F.col("__l_class")), "left")
    return marked.select(*df.columns, F.when(F.coalesce(before, F.lit(False)), "train").otherwise("test").alias(part))


def stratified_folds(
    df: DataFrame,
    target: str = "DPTN",
    folds: int = 5,
    seed: int = 42,
    key: str = "USUBJID",
    exact: bool = True,
    fold: str = "FOLD",
    **limits,
) -> DataFrame:
    """Add a fold number 0..folds-1, balanced within each class, or by hash only without ``exact``."""
    h = hash_number(key, seed + 1)
    if not exact:
        return df.withColumn(fold, (h % folds).cast("int"))
    ranked = numbered(
        df.withColumn("__h", h), [target], ["__h", key], "__i", **limits
    )
    return ranked.withColumn(fold, ((F.col("__i") - 1) % folds).cast("int")).drop("__h", "__i")


def split_summary(df: DataFrame, part: str = "PART", target: str = "DPTN") -> DataFrame:
    return df.groupBy(part).agg(
        F.count(F.lit(1)).alias("N"), F.avg(target).alias("DROPOUT_RATE")
    )

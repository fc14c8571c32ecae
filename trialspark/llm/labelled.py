"""Labelled training rows: a bounded, seeded sample of documents joined to their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import settle

MAX_TRAIN = 20_000  # about so many labelled documents fit a model; more are sampled by a hash of the id
BUCKETS = 1_000_000


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column, key: str = "doc_id", text: str = "text",
    max_train: int = MAX_TRAIN,
) -> DataFrame:
    """key, text, label of documents that have a label and are not held out.

    A key labelled more than once counts as 1 if any of its labels is. The sample is taken from the labels,
    so at most about max_train small rows meet the documents and the documents are not moved.
    """
    known = (
        labels.select(F.col(key), F.col(label).cast("int").alias("label"))
        .where(F.col(key).isNotNull() & F.col("label").isNotNull() & ~F.coalesce(held_out, F.lit(False)))
        .groupBy(key).agg(F.max("label").alias("label"))
    )
    known = settle(known, "labels")
    share = min(1.0, max_train / max(1, known.count()))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(key), F.lit(BUCKETS)) < int(share * BUCKETS))
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(known), key)
    return settle(rows, "training")

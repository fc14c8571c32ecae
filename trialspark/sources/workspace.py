"""Folders that all executors share, and intermediate tables that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """New folder name under the cluster's shared checkpoint folder.

    A session on one machine (master local[...]) without ``spark.checkpoint.dir`` gets a temporary folder.
    On a cluster such a folder would be another one on every machine, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="trialspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Keep an aggregated table that several branches of a plan read.

    Spark computes it when it is first read, holds it in memory or on the executors' disks, and makes lost
    parts anew from the plan; nothing is written to a shared folder and no job runs here.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)

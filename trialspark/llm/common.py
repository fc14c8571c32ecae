"""Helpers shared by the training-data operators: shared tables, exact text digests, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: spark.checkpoint.dir.

    Only a session on one machine may leave that unset, and gets a temporary folder; on a cluster every machine
    would see another one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="trialspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns_free_of(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, so that extra columns of the caller cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df is called so, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node of every connected component: (node, root) for each node of edges (a, b).

    Rounds of large-star and small-star contraction; every round is two aggregations and two joins,
    is written to the shared folder, and no neighbourhood is ever collected. The number of rounds
    grows with the logarithm of the component size; max_rounds only guards against a fault and raises.
    """
    edges = settle(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )  # every larger neighbour is hung on the smallest node of the star
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.explode(F.array(
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        )  # every smaller neighbour, and the node itself, is hung on the smallest of them
        edges = settle(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Shards by a k-d tree over the metadata of documents, in built-in expressions only.

A cell is cut along its widest dimension at the weighted median of the bytes of its documents, until the leaves have
the wanted size. The medians are found from sums of bytes per leading digits of the coordinate, so documents are neither
sorted nor moved; rows with equal coordinates are told apart by a hash, rows that are equal in all by their place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import settle
from trialspark.operators.selection import CUT, REST, cut_points

SHARDS = 8
DIMENSIONS = ("lang", "source", "n_chars")
STEPS, HASH_BITS = 20, 40  # bits of a coordinate and of the hash after it
FEW_CELLS = 10_000  # tables of so many cells are broadcast; longer ones are joined as they are
STRING_BYTES = 6  # leading bytes of a text that make its coordinate


def coordinate(df: DataFrame, column: str) -> Column:
    """A column as a number: dates and numbers as they are, other types by the first bytes of their text; null without a finite one."""
    kind = df.schema[column].dataType.simpleString()
    value = F.col(f"`{column}`")
    if kind in ("timestamp", "date", "boolean"):
        return value.cast("timestamp").cast("double") if kind != "boolean" else value.cast("double")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        number = value.cast("double")
        return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)
    lead = F.rpad(F.hex(F.encode(F.substring(value.cast("string"), 1, STRING_BYTES), "UTF-8")), 2 * STRING_BYTES, "0")
    return F.conv(lead, 16, 10).cast("double")


def _measured(docs: DataFrame, key: str, text: str, dimensions: Sequence[str], version: Column) -> DataFrame:
    """One narrow row per document: key, version, size, crc, hash, place, and a whole coordinate c0, c1, ... per dimension."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("key"), version.alias("version"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("crc"), *[coordinate(docs, c).alias(f"x{i}") for i, c in enumerate(dimensions)])
    digest = F.md5(F.concat_ws(":", F.col("key").cast("string"), F.col("crc").cast("string")))
    rows = settle(rows.withColumn("place", F.monotonically_increasing_id()).withColumn(
        "hash", F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")), "sizes")
    ends = rows.agg(*[f(f"x{i}").alias(f"{f.__name__}{i}") for i in range(len(dimensions)) for f in (F.min, F.max)]).first()
    cells = []
    for i in range(len(dimensions)):
        low, high = ends[f"min{i}"], ends[f"max{i}"]
        span = (high - low) if low is not None and high > low else 1.0
        step = F.floor((F.col(f"x{i}") - F.lit(low)) / F.lit(span) * ((1 << STEPS) - 2)) + 1  # nulls come first
        cells.append(F.coalesce(step, F.lit(0)).cast("long").alias(f"c{i}"))
    return rows.select("key", "version", "size", "crc", "hash", "place", *cells)


def _split(rows: DataFrame, cells: DataFrame, dimensions: int, few: bool) -> tuple[DataFrame, DataFrame]:
    """Rows and cells one level down. cells: node, first (shard), leaves; a cell of one leaf stays as it is."""
    sent = F.broadcast if few else (lambda df: df)
    widths = [(F.max(f"c{i}") - F.min(f"c{i}")).alias(f"w{i}") for i in range(dimensions)]
    found = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *widths)
    widest = F.greatest(*[F.struct(F.col(f"w{i}").alias("w"), F.lit(-i).alias("i")) for i in range(dimensions)])["i"]
    left = F.floor(F.col("leaves") / 2)
    plan = settle(cells.where("leaves > 1").join(sent(found), "node").select(
        "node", "first", "leaves", (-widest).alias("dim"), left.alias("left"),
        F.floor(F.col("bytes").cast("decimal(20,0)") * left / F.col("leaves")).cast("long").alias("wanted")), "plan")
    at = F.element_at(F.array(*[F.col(f"c{i}") for i in range(dimensions)]), F.col("dim") + 1)
    placed = rows.join(sent(plan.select("node", "dim")), "node").select(
        "node", "size", "place", (F.shiftleft(at, HASH_BITS) + F.col("hash")).alias("spot"))
    cut = cut_points(placed, ["node"], "spot", plan, "wanted", F.col("size"), STEPS + HASH_BITS, few)
    cut = settle(cut.select("node", F.col(CUT).alias("cut"), F.col(REST).alias("rest")), "cuts")
    ties = settle(placed.join(sent(cut), "node").where("spot = cut"), "ties")
    if ties.count() == cut.count():  # no two rows share the place of a cut
        last = ties.select("node", F.col("place").alias("last"), F.col("rest").alias("last_rest"))
    else:
        last = cut_points(ties, ["node"], "place", cut, "rest", F.col("size"), few=few).select(
            "node", F.col(CUT).alias("last"), F.col(REST).alias("last_rest"))
    plan = settle(plan.join(sent(cut.select("node", "cut")), "node", "left").join(sent(last), "node", "left"), "cuts")
    spot = F.shiftleft(at, HASH_BITS) + F.col("hash")
    before = F.col("cut").isNull() | (spot < F.col("cut")) | ((spot == F.col("cut")) & F.when(
        F.col("place") == F.col("last"), 2 * F.col("last_rest") >= F.col("size")).otherwise(F.col("place") < F.col("last")))
    child = F.when(F.col("leaves").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(before, 0).otherwise(1))
    moved = rows.join(sent(plan.drop("first", "wanted")), "node", "left").select(
        child.alias("node"), *[c for c in rows.columns if c != "node"])
    halves = F.array(
        F.struct((2 * F.col("node")).alias("node"), F.col("first"), F.col("left").cast("long").alias("leaves")),
        F.struct((2 * F.col("node") + 1).alias("node"), (F.col("first") + F.col("left")).cast("long").alias("first"),
                 (F.col("leaves") - F.col("left")).cast("long").alias("leaves")))
    done = cells.join(sent(plan.select("node")), "node", "left_anti").select("node", "first", "leaves")
    return settle(moved, "rows"), settle(done.union(plan.select(F.explode(halves).alias("h")).select("h.*")), "cells")


def kd_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", dimensions: Sequence[str] = DIMENSIONS,
    target_bytes: int | None = None, shards: int | None = None, version: Column | None = None,
) -> DataFrame:
    """key, version, size, text_crc32, shard, slot: one row for each document, with its place in a shard.

    size is the bytes of the text in UTF-8 and one; shards have near-equal sizes. Give their number or, with target_bytes,
    the size that none is to exceed much; the default is 8. version (xxhash64 of the text if not given) tells apart rows with one
    key. slot counts from 0 without gaps, in the order of a hash. Null texts count as empty; null keys and coordinates that are
    missing or not finite come first; equal rows are spread like any others, and a group of them may be cut. An empty table gives
    an empty result; other columns are not read.
    """
    rows = _measured(docs, key, text, dimensions, F.xxhash64(F.col(text)) if version is None else version)
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    leaves = shards or (max(1, -(-whole // target_bytes)) if target_bytes else SHARDS)
    few = leaves <= FEW_CELLS
    cells = rows.sparkSession.range(1).select(F.lit(1).cast("long").alias("node"), F.lit(0).cast("long").alias("first"),
                                              F.lit(leaves).cast("long").alias("leaves"))
    for _ in range((leaves - 1).bit_length()):
        rows, cells = _split(rows, cells, len(dimensions), few)
    named = rows.join(F.broadcast(cells) if few else cells, "node").select(
        "key", "version", "size", "crc", F.col("first").cast("int").alias("shard"), "hash", "place")
    ranged = settle(named.repartitionByRange("shard", "hash", "place").withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))  # at most shards + partitions rows
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("hash", "place"))
    return ranged.withColumn("row", inside).join(starts, ["shard", "part"]).select(
        F.col("key").alias(key), "version", "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("start") + F.col("row") - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", **options) -> None:
    """Write the documents with all their columns as Parquet, one folder for each shard, with their slot.

    Rows equal in all columns stand for each other. The columns must be of types that xxhash64 takes, and none may be
    called shard or slot.
    """
    told = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    places = kd_shards(docs, key, text, version=told, **options).select(F.col("version").alias("__row"), "shard", "slot")
    texts = docs.withColumn("__row", told).dropDuplicates(["__row"])
    texts.join(places, "__row").drop("__row").write.partitionBy("shard").parquet(path)

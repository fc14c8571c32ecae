"""CSV files whose texts may hold line breaks, read in pieces by many tasks.

A line break ends a record only where an even number of quotes stands before it in the file. Spark cuts files into
blocks of whole lines. A first pass counts the quotes of each block; running sums per file tell which blocks begin
inside a text. With that known every task puts the lines of its blocks together to records by itself. Only records that
cross the end of a block need lines of several blocks; their pieces, two a block at most, are joined by file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

WHOLE, HEAD, TAIL, MIDDLE = range(4)  # a piece is a record, its end, its begin, or a block without any end of a record
_PIECE = "file long, block long, kind int, first boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file (a hash of its path), block (where it begins), other (a second hash), value (a line without its line feed)."""
    name, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return spark.read.text(path, lineSep="\n").select(
        F.xxhash64(name).alias("file"), block.alias("block"), F.xxhash64(F.lit(1), name).alias("other"), "value")


def _blocks(lines: DataFrame) -> DataFrame:
    """Blocks, whether each begins inside a text (open), and whether it holds pieces of records (cut)."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "block").agg(
        F.sum(quotes).alias("quotes"), F.min("other").alias("a"), F.max("other").alias("b"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sure = F.when(F.col("a") == F.col("b"), F.coalesce(before, F.lit(0))).otherwise(
        F.raise_error(F.lit("two files have paths with the same hash; rename one")).cast("long"))
    opened = counted.withColumn("before", sure).select("file", "block", "quotes", (F.col("before") % 2).alias("open"))
    return opened.withColumn("cut", (F.col("open") == 1) | ((F.col("open") + F.col("quotes")) % 2 == 1)).drop("quotes")


def _pieces(lines: DataFrame, whole: bool) -> DataFrame:
    """Records (whole) or pieces of records from lines (file, block, open, value), which stand in the order of the file."""
    names = ["file", "block", "kind", "first", "record"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]

    def piece(at: tuple[int, int], kind: int, first: bool, lines: list[str]) -> pa.RecordBatch:
        row = (*at, kind, first, "\n".join(lines))
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    def records(at: tuple[int, int], first: bool, lines: pa.Array, bounds: np.ndarray) -> pa.RecordBatch:
        """Whole records, each from one bound to the next."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lines), "\n")
        n = len(joined)
        head = np.zeros(n, bool)
        head[:1] = first
        columns = [np.full(n, at[0], "i8"), np.full(n, at[1], "i8"), np.full(n, WHOLE, "i4"), head]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), joined], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, odd, held, begun, first = None, 0, [], True, False
        for batch in batches:
            file, block, open_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            values = batch.column(3).cast(pa.string())
            quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
            change = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
            cuts = np.unique(np.r_[0, change, len(file)]).tolist()
            for a, b in zip(cuts, cuts[1:]):
                if at != (file[a], block[a]):
                    if held and not whole:
                        yield piece(at, TAIL if begun else MIDDLE, first, held)
                    at, odd, held = (int(file[a]), int(block[a])), int(open_[a]), []
                    begun, first = odd == 0, block[a] == 0
                after = (odd + np.cumsum(quotes[a:b])) & 1
                odd = int(after[-1])
                bounds = np.r_[0, np.flatnonzero(after == 0) + 1]
                lines_ = values.slice(a, b - a)
                if len(bounds) > 1 and (held or not begun):  # the first record began earlier
                    if begun == whole:
                        yield piece(at, WHOLE if begun else HEAD, first, held + lines_[:int(bounds[1])].to_pylist())
                    held, begun, first, bounds = [], True, False, bounds[1:]
                if len(bounds) > 1:
                    if whole:
                        yield records(at, first, lines_, bounds)
                    first = False
                held += lines_[int(bounds[-1]):].to_pylist()
        if held and not whole:
            yield piece(at, TAIL if begun else MIDDLE, first, held)

    return lines.select("file", "block", "open", "value").mapInArrow(run, _PIECE)


def _joined(pieces: DataFrame) -> DataFrame:
    """first, record of the records that cross blocks: a begin and all pieces up to the next end."""
    place = Window.partitionBy("file").orderBy("block", F.col("kind") == TAIL)
    marked = pieces.withColumn("nth", F.sum((F.col("kind") == TAIL).cast("int")).over(place))
    parts = F.array_sort(F.collect_list(F.struct("block", "record")))
    return marked.groupBy("file", "nth").agg(F.max("first").alias("first"), parts.alias("parts")).select(
        "first", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """first (true for a file's first record), record: the text of each record of the files, line breaks kept.

    Records end by a line feed, with or without a carriage return before it. Empty lines between records are no records.
    The table of blocks is sent to all tasks: one row per block, so 24 bytes for every 128 MB of input.
    """
    lines = _lines(spark, path)
    blocks = _blocks(lines)
    lines, keys = lines.drop("other"), ["file", "block"]
    # A block that the first pass did not see would mean that the files were cut in another way.
    known = F.coalesce("open", F.raise_error(F.lit("the files were cut into other blocks; read them again")).cast("long"))
    opened = lines.join(F.broadcast(blocks.select(*keys, "open")), keys, "left").withColumn("open", known)
    crossing = lines.join(F.broadcast(blocks.filter("cut").select(*keys, "open")), keys)
    records = _pieces(opened, True).select("first", "record").unionByName(_joined(_pieces(crossing, False)))
    return records.withColumn("record", F.rtrim("record", F.lit("\r"))).filter("record != ''")


def _header_fits(spark: SparkSession, schema: T.StructType, options: dict[str, str]) -> Column:
    """False for a header with the declared names, an error for any other."""
    plain = spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    names = [n if plain else n.lower() for n in schema.names]
    slots = [f"c{i}" for i in range(len(names))]
    told = F.from_csv(F.col("record") if plain else F.lower("record"), ", ".join(f"{s} string" for s in slots), options)
    wanted = F.struct(*[F.lit(n).alias(s) for n, s in zip(names, slots)])
    wrong = F.concat(F.lit("the header of a CSV file does not fit the schema: "), F.col("record"))
    return F.when(F.coalesce(told == wanted, F.lit(False)), False).otherwise(F.raise_error(wrong).cast("boolean"))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, options: dict) -> DataFrame:
    """Rows of CSV files with a header. A value that does not fit its type, or another header, is an error."""
    text = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "header"}
    text |= {"mode": "FAILFAST", "multiLine": "true"}
    body = csv_records(spark, path).filter(F.when(F.col("first"), _header_fits(spark, schema, text)).otherwise(True))
    return body.select(F.from_csv("record", _ddl(schema), text).alias("row")).select("row.*")

"""Exact top-k search by inner product over a bit-sliced index.

Rows are kept in blocks. Of each quantised component, shifted to be non-negative, every binary digit is one
bitmap over the rows of a block. A query's scores are never computed row by row: its weights say which bitmaps
are added at which place, and adders on bitmaps give the digits of all scores of the block at once. From the
highest digit down, rows are then kept or dropped in whole bitmaps until k are left; rows equal in all digits
at the border are chosen by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import settle

BLOCK_ROWS = 8_192  # rows of one block of the index
CHUNK_ROWS = 256  # queries sent to a block together
SCALE = 256
MAX_TASKS = 10_000  # tasks of a search; more blocks share them
FIELDS = ["ids", "values", "width", "kind"]


def quantise(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold no null, not-a-number or infinite component."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


class BitSlices:
    """Bit-sliced index of a block: bits[component][digit] are bitmaps over the rows, low the shift of each component."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.rows = len(ids)
        self.low = values.min(axis=0)
        shifted = (values - self.low).astype("u8")
        self.bits = []
        for column in shifted.T:
            digits = int(column.max()).bit_length()
            planes = (column[None, :] >> np.arange(digits, dtype="u8")[:, None]) & np.uint64(1)
            self.bits.append(_pack(planes.astype("u1")))

    def top(self, query: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
        """(id, score) of the k rows with the highest scores, ties to the smaller id, without rows with the id `own`."""
        digits, base = self._scores(query)
        wide = -(-self.rows // 64)
        open_ = _pack(np.ones((1, self.rows), "u1"))[0]
        for row in range(*np.searchsorted(self.ids, [own, own + 1])):
            open_[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        sure = np.zeros(wide, "u8")
        need = k
        for digit in reversed(digits):
            high = open_ & digit
            n = int(np.bitwise_count(high).sum())
            if n >= need:
                open_ = high
            else:
                sure |= high
                open_ &= ~digit
                need -= n
        rows = list(_rows(sure)) + list(_rows(open_))[:need]  # rows are sorted by id, so the border goes to small ids
        scores = [base + sum(int(d[r // 64] >> np.uint64(r % 64) & np.uint64(1)) << i for i, d in enumerate(digits)) for r in rows]
        return sorted(zip(self.ids[rows].tolist(), scores), key=lambda x: (-x[1], x[0]))

    def _scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Digits of all scores, lowest first, and the number to be added to them.

        A negative weight adds the complement of a component's digits instead, so that all terms are non-negative.
        """
        places: list[list[np.ndarray]] = []
        base = 0
        for weight, low, bits in zip(query.tolist(), self.low.tolist(), self.bits):
            base += weight * low
            if not weight or not len(bits):
                continue
            if weight < 0:
                base += weight * ((1 << len(bits)) - 1)
                bits = ~bits
                weight = -weight
            for shift in range(weight.bit_length()):
                if weight >> shift & 1:
                    while len(places) < shift + len(bits):
                        places.append([])
                    for i in range(len(bits)):
                        places[shift + i].append(bits[i:i + 1])
        digits, carried = [], np.empty((0, -(-self.rows // 64)), "u8")
        at = 0
        while at < len(places) or len(carried):
            terms = np.concatenate([carried, *(places[at] if at < len(places) else [])])
            more = []
            while len(terms) > 2:  # three bitmaps become a sum here and a carry at the next place
                third = len(terms) // 3
                a, b, c = terms[:third], terms[third:2 * third], terms[2 * third:3 * third]
                odd = a ^ b
                more.append((a & b) | (odd & c))
                terms = np.concatenate([odd ^ c, terms[3 * third:]])
            if len(terms) == 2:
                more.append((terms[0] & terms[1])[None])
                terms = (terms[0] ^ terms[1])[None]
            digits.append(terms[0] if len(terms) else np.zeros(-(-self.rows // 64), "u8"))
            carried = np.concatenate(more) if more else np.empty((0, -(-self.rows // 64)), "u8")
            if at >= len(places) and not carried.any():
                break
            at += 1
        return digits, base


def _pack(planes: np.ndarray) -> np.ndarray:
    """Rows of zeros and ones as 64-bit words, row i at bit i % 64 of word i // 64."""
    wide = -(-planes.shape[1] // 64) * 64
    padded = np.zeros((planes.shape[0], wide), "u1")
    padded[:, :planes.shape[1]] = planes
    return np.packbits(padded, axis=1, bitorder="little").view("u8")


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view("u1"), bitorder="little"))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
    block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """query_id, rank, key, score: for each query its k highest integer inner products over all other rows.

    Both frames have key and vector. Ties go to the smaller key; fewer rows than k give fewer results. Rows with a
    null key, or a vector that is null or holds null or non-finite components, take no part. Vectors of another
    length meet with zeros at their end. A key that stands more than once is one query, with its first vector in
    the order of vectors; each of its rows is a candidate, but not for itself. Empty tables give an empty result.
    Every block of rows meets every chunk of queries: an exact search has no less to do. What is shuffled grows with
    rows and with queries times blocks; nothing but counts reaches the driver.
    """
    def ready(df: DataFrame) -> DataFrame:
        return df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
            F.col(key).cast("long").alias("id"), quantise(F.col(vector), scale).alias("v"))

    rows = settle(ready(vectors), "vectors")
    asked = settle(ready(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, q = rows.count(), asked.count()
    blocks, chunks = -(-n // block_rows), -(-q // chunk_rows)
    # A block stands in as many groups as keep four tasks a core busy, and each chunk of queries meets it in one of them.
    groups = max(1, min(chunks, -(-4 * rows.sparkSession.sparkContext.defaultParallelism // max(1, blocks))))
    packed = "part long, ids binary, values binary, width int, kind string"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a part, sorted by part, as one row: ids and vectors as bytes, in the smallest type that holds them."""
        part, held = None, []

        def out() -> pa.RecordBatch:
            ids = np.array([i for i, _ in held], "i8")
            width = max((len(v) for _, v in held), default=0)
            values = np.zeros((len(held), width), "i8")
            for r, (_, v) in enumerate(held):
                values[r, :len(v)] = v
            low, high = int(values.min(initial=0)), int(values.max(initial=0))
            kind = next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
            return pa.RecordBatch.from_pydict({
                "part": [part], "ids": [ids.tobytes()], "values": [values.astype(kind).tobytes()],
                "width": pa.array([width], pa.int32()), "kind": [kind]})

        for batch in batches:
            for p, i, v in zip(*(batch.column(c) for c in range(3))):
                if p.as_py() != part and held:
                    yield out()
                    held = []
                part = p.as_py()
                held.append((i.as_py(), np.asarray(v.values)))
        if held:
            yield out()

    def parts(df: DataFrame, n: int) -> DataFrame:
        spread = df.select(F.pmod(F.xxhash64("id", "v"), F.lit(max(1, n))).alias("part"), "id", "v")
        return spread.repartition("part").sortWithinPartitions("part").mapInArrow(pack, packed)

    def numbers(upto: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, upto - 1)).cast("long")))

    # Blocks and chunks meet by one shuffle of both and the order of a sort, not by a join: a join would copy a block for
    # each chunk, and as explode hides how many rows it makes, Spark would send all copies of the queries by way of the driver.
    index = parts(rows, blocks).select("part", numbers(groups).alias("slice"), F.lit(-1).cast("long").alias("chunk"), *FIELDS)
    sent = parts(asked, chunks).select(
        numbers(blocks).alias("block"), F.pmod("part", F.lit(groups)).alias("slice"), F.col("part").alias("chunk"), *FIELDS)
    tasks = index.union(sent).repartition(max(1, min(blocks * groups, MAX_TASKS)), "part", "slice").sortWithinPartitions(
        "part", "slice", "chunk")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block comes before its chunks, so a task holds one block and one batch."""
        held, slices = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                part, group, chunk, ids, values, width, kind = (batch.column(c)[r] for c in range(7))
                ids = np.frombuffer(ids.as_buffer(), "i8")
                values = np.frombuffer(values.as_buffer(), kind.as_py()).reshape(len(ids), width.as_py()).astype("i8")
                if chunk.as_py() < 0:
                    held, slices = (part.as_py(), group.as_py()), BitSlices(ids, values)
                    continue
                if held != (part.as_py(), group.as_py()):  # no row has this block's number
                    continue
                found = [(own, i, s) for own, weight in zip(ids.tolist(), values) for i, s in slices.top(weight[:len(slices.low)], k, own)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[c] for f in found], pa.int64()) for c in range(3)], names=["query_id", "id", "score"])

    best = tasks.mapInArrow(search, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(key), "score")

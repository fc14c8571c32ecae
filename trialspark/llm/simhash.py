"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints have 64 bits. Two fingerprints within `max_bits` differing bits agree in at least one of
max_bits + 1 blocks of bits, so every fingerprint is dealt to max_bits + 1 tries, each with one block
turned to the front. Below an equal leading block, pairs of trie nodes are walked together: the bits in
which the two paths differ are added up, and a pair is dropped as soon as they exceed max_bits. Tries
that hold more than `trie_rows` fingerprints are cut into pairs of subtries, which are walked apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import columns_free_of, connected_components, free_name, settle

SEED = 42  # of XXH64
SHINGLE = 3
MAX_BITS = 3
TRIE_ROWS = 20_000  # larger tries are cut into subtries
CHUNK_ROWS = 200_000  # fingerprints walked together in one pass
LEAF_PAIRS = 16  # node pairs with at most so many fingerprint pairs are compared directly


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text in UTF-8; words end at ASCII white space, only A-Z are lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    parts = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[w] for w in words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*parts)), ">u8")
    ones = np.zeros(64, "i8")
    for start in range(0, len(hashes), 4096):  # long texts in steps, so that the bits never fill the memory
        ones += np.unpackbits(hashes[start:start + 4096].view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def with_fingerprint(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """keys and `fp`, the fingerprint as a signed long, one row per row of docs."""
    frame = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(len(keys))), "u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view("i8"))], names=[*keys, "fp"])

    return frame.mapInArrow(run, schema)


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of every node, after adding links a-b to earlier labels."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def linked_roots(
    values: np.ndarray, side: np.ndarray, group: np.ndarray, cross: np.ndarray, depth: int, max_bits: int
) -> np.ndarray:
    """Root index of every fingerprint in forests of tries.

    values are sorted within (group, side); `cross` tells for each row whether its group joins side 0 with
    side 1 (else side 0 with itself); `depth` leading bits are not walked. Error budgets of 1 to max_bits
    are walked in turn, and node pairs whose fingerprints are already in one component are pruned, so
    that a dense cluster costs no walk over all its pairs.
    """
    n = len(values)
    labels = np.arange(n)
    forest = group * 2 + side
    starts = np.flatnonzero(np.r_[True, forest[1:] != forest[:-1]])
    ends = np.r_[starts[1:], n]
    own = ~cross[starts]
    first = starts[own], ends[own], starts[own], ends[own]
    left, right = np.flatnonzero(~own & (side[starts] == 0)), np.flatnonzero(~own & (side[starts] == 1))
    _, li, ri = np.intersect1d(group[starts[left]], group[starts[right]], return_indices=True)
    roots = [np.concatenate([f, s]) for f, s in zip(
        first, (starts[left[li]], ends[left[li]], starts[right[ri]], ends[right[ri]]))]
    for budget in range(1, max_bits + 1):
        pairs, found = list(roots), []
        mixed = np.cumsum(np.r_[0, labels[1:] != labels[:-1]])
        for bit in range(63 - depth, -2, -1):
            alo, ahi, blo, bhi = pairs
            one = (labels[alo] == labels[blo]) & (mixed[ahi - 1] == mixed[alo]) & (mixed[bhi - 1] == mixed[blo])
            alo, ahi, blo, bhi = (x[~one] for x in (alo, ahi, blo, bhi))
            few = (ahi - alo) * (bhi - blo) <= LEAF_PAIRS
            la, lb = _expand(*(x[few] for x in (alo, ahi, blo, bhi)))
            near = np.bitwise_count(values[la] ^ values[lb]) <= budget
            found.append((la[near], lb[near]))
            pairs = [x[~few] for x in (alo, ahi, blo, bhi)]
            if bit < 0 or not len(pairs[0]):
                break
            pairs = _descend(values, pairs, np.uint64(bit), budget)
        labels = _join_labels(labels, *(np.concatenate(x) for x in zip(*found)))
    return labels


def _expand(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of small node pairs, each unordered pair once."""
    size = (ahi - alo) * (bhi - blo)
    at = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    width = (bhi - blo)[at]
    a, b = alo[at] + k // width, blo[at] + k % width
    keep = (a < b) | (ahi[at] <= blo[at])
    return a[keep], b[keep]


def _descend(values: np.ndarray, pairs: list[np.ndarray], bit: np.uint64, budget: int) -> list[np.ndarray]:
    """Child node pairs one bit below whose paths differ in at most `budget` bits."""
    def cut(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        low, high = lo.copy(), hi.copy()  # first row of each node whose bit is set
        while (open_ := low < high).any():
            mid = (low + high) // 2
            is_set = (values[np.minimum(mid, len(values) - 1)] >> bit) & np.uint64(1) == 1
            high = np.where(open_ & is_set, mid, high)
            low = np.where(open_ & ~is_set, mid + 1, low)
        return low

    alo, ahi, blo, bhi = pairs
    acut, bcut = cut(alo, ahi), cut(blo, bhi)
    same = (alo == blo) & (ahi == bhi)
    parts = [(alo, acut, blo, bcut, None), (acut, ahi, bcut, bhi, None),
             (alo, acut, bcut, bhi, None), (acut, ahi, blo, bcut, ~same)]  # (0,1) and (1,0) of one node are alike
    out: list[list[np.ndarray]] = [[], [], [], []]
    for a0, a1, b0, b1, also in parts:
        keep = (a0 < a1) & (b0 < b1)
        if also is not None:
            keep &= also
        at = np.flatnonzero(keep)
        differ = np.bitwise_count((values[a0[at]] ^ values[b0[at]]) >> bit)
        at = at[differ <= budget]
        for o, x in zip(out, (a0, a1, b0, b1)):
            o.append(x[at])
    return [np.concatenate(o) for o in out]


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that join everything within max_bits of each other.

    Within each trie every fingerprint is linked to one root of its component, so that no group emits
    more links than it has rows.
    """
    blocks, width = max_bits + 1, 64 // (max_bits + 1)
    mask = (1 << width) - 1

    def front(value: Column, shift: int) -> Column:
        return F.shiftrightunsigned(value, 64 - shift).bitwiseAND((1 << shift) - 1) if shift else F.lit(0).cast("long")

    turned = prints.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"),
                 (F.shiftleft("fp", k * width).bitwiseOR(front(F.col("fp"), k * width)) if k else F.col("fp")).alias("v"))
        for k in range(blocks)
    ])).alias("t")).select("t.k", "t.v", front(F.col("t.v"), width).bitwiseAND(mask).alias("block"))
    size = turned.groupBy("k", "block").agg(F.count("*").alias("n"))
    heavy = size.where(F.col("n") > trie_rows).select(
        "k", "block", F.least(F.lit(12), F.ceil(F.log2(F.col("n") / trie_rows)) + 2).cast("int").alias("cut"))
    sub = F.expr(f"shiftrightunsigned(shiftleft(v, {width}), 64 - cut)")
    turned = (
        turned.join(heavy, ["k", "block"], "left")
        .withColumn("u", F.when(F.col("cut").isNull(), F.lit(0).cast("long")).otherwise(sub))
        .withColumn("w", F.when(F.col("cut").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.expr(
            f"filter(sequence(0L, shiftleft(1L, cut) - 1), x -> bit_count(x ^ u) <= {max_bits})")))
        .select("k", "block", "v", "u", F.explode("w").alias("w"))
        .select("k", "block", F.least("u", "w").alias("p"), F.greatest("u", "w").alias("q"),
                (F.col("u") > F.col("w")).cast("long").alias("side"), "v")
        .withColumn("trie", F.xxhash64("k", "block", "p", "q"))
    )
    order = ["trie", "k", "block", "p", "q", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            part = np.column_stack([np.asarray(batch.column(i)).astype("i8") for i in range(len(order) + 1)])
            held.append(part)
            rows += len(part)
            if rows >= CHUNK_ROWS:
                whole = np.concatenate(held)
                new = np.flatnonzero((whole[1:, :5] != whole[:-1, :5]).any(axis=1)) + 1
                last = int(new[-1]) if len(new) else 0
                if last:
                    yield from links(whole[:last])
                held, rows = [whole[last:]], len(whole) - last
        if rows:
            yield from links(np.concatenate(held))

    def links(part: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, value = part[:, :5], part[:, 6].view("u8") if part.flags.f_contiguous else part[:, 6].copy().view("u8")
        group = np.cumsum(np.r_[0, (key[1:] != key[:-1]).any(axis=1)])
        at = np.lexsort((value, part[:, 5], group))
        part, value, group = part[at], value[at], group[at]
        root = linked_roots(value, part[:, 5], group, part[:, 3] != part[:, 4], width, max_bits)
        moved = np.flatnonzero(root != np.arange(len(root)))
        shift = (part[:, 1].astype("u8") * np.uint64(width)) % np.uint64(64)
        plain = np.where(shift == 0, value, (value >> shift) | (value << ((np.uint64(64) - shift) % np.uint64(64))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(plain[moved].view("i8")), pa.array(plain[root[moved]].view("i8"))], names=["a", "b"])

    rows = turned.select(*order, "v").repartition("trie").sortWithinPartitions(*order)
    return rows.mapInArrow(run, "a long, b long").where("a <> b")


def simhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per row of docs: key, fp (signed long), fingerprint (16 hex digits), component_id.

    component_id is the smallest key among all texts reachable over links of at most max_bits differing
    bits. A null or empty text has fingerprint zero and links like any other; a text with fewer words than
    a shingle is one shingle. A null key takes part, but names a component only if no other key is in it.
    Repeated rows give repeated rows; an empty table gives an empty one; other columns are not read.
    """
    prints = settle(with_fingerprint(columns_free_of(docs, key, text), [key], text, shingle), "prints")
    classes = _classes(prints, key, max_bits).select("fp", "component_id")
    return prints.join(classes, "fp").select(
        key, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(prints: DataFrame, key: str, max_bits: int) -> DataFrame:
    """fp, root (a fingerprint that stands for the component) and component_id of every distinct fingerprint."""
    distinct = settle(prints.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    roots = connected_components(near_links(distinct.select("fp"), max_bits))
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return classes.join(lowest, "root").select("fp", "root", "component_id")


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """docs without near-duplicates: of each component one row stays, that with the smallest key and text hash.

    A null key comes after all others, so such a row stays only if its component has no other key. A key that
    occurs in two components is chosen for each of them on its own. Of rows with one key and text one stays.
    """
    thin = columns_free_of(docs, key, text).select(
        F.col(f"`{key}`").alias("__key"), F.xxhash64(F.col(f"`{text}`")).alias("__version"), F.col(f"`{text}`").alias("__text"))
    prints = settle(with_fingerprint(thin, ["__key", "__version"], "__text", shingle), "prints")
    roots = _classes(prints, "__key", max_bits).select("fp", "root")
    first = F.min(F.struct(F.col("__key").isNull().alias("none"), "__key", "__version")).alias("b")
    chosen = prints.join(roots, "fp").groupBy("root").agg(first).select("b.__key", "b.__version").distinct()
    version = free_name(docs, "__hash")
    marked = docs.withColumn(version, F.xxhash64(F.col(f"`{text}`")))
    same = marked[f"`{key}`"].eqNullSafe(chosen["__key"]) & (marked[version] == chosen["__version"])
    return marked.join(chosen, same, "left_semi").dropDuplicates([key, version]).drop(version)

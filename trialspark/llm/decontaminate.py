"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring words: positions marked 0 are ignored, so that a substituted word
under such a position does not spoil the hash. Hashes of all seeds of the test items are joined to those of
the documents; around every hit, document and item are laid over each other without gaps. An item counts that is met
whole, with enough equal words wherever they stand, and of a long one also a long stretch with enough equal words.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import columns_free_of, settle

#: Found by enumeration: every overlap of at least 11 words with 80% equal is hit by one of these masks.
MASKS = ("1101111", "111010011", "11100100011", "110100111")
MIN_OVERLAP = 13  # words; an item with no more words must be met whole
MIN_WORDS = 5  # items with fewer words say too little and match nothing, unless asked for
SHORT_WEIGHT = 5  # words that a mask of a whole short item compares, if the share leaves so many
MIN_SHARE = 0.8  # of equal words in an overlap
FILTER_BITS = 26  # a filter of 2^26 bits (8 MB, whatever the number of items) goes to every task
WORD = re.compile(r"\w+")
CODE = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """64-bit codes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


def _tokens(text: str | None, codes: _Codes) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(codes.__getitem__, words), "u8", len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * CODE
    return h ^ (h >> np.uint64(29))


def seed_hashes(tokens: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[np.ndarray, int]]:
    """For each mask the hashes of all its positions in a token array, and the mask's length."""
    for number, mask in enumerate(masks):
        n = len(tokens) - len(mask) + 1
        if n <= 0:
            yield np.empty(0, "u8"), len(mask)
            continue
        h = np.full(n, number + 1, "u8")
        for i, keep in enumerate(mask):
            if keep == "1":
                h = (h + tokens[i:i + n]) * CODE
        yield _mix(h), len(mask)


def _slots(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - FILTER_BITS)


def _items(benchmark: DataFrame, item: str, text: str, min_words: int) -> DataFrame:
    """Distinct items (item, item_text as a number, tokens) with enough words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            tokens = [_tokens(t.as_py(), codes).view("i8") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.list_(pa.int64()))], names=["item", "version", "words"])

    kind = benchmark.schema[item].dataType.simpleString()
    frame = benchmark.select(F.col(item).alias("item"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    return frame.distinct().mapInArrow(run, f"item {kind}, version long, words array<long>").where(
        F.size("words") >= max(1, min_words))


def short_masks(n: int, share: float = MIN_SHARE) -> tuple[str, ...]:
    """Masks of n positions that hit every way to substitute as many words as `share` allows, the first and last included.

    Ways that a fixed mask hits need none. Of all masks that ignore the same number of positions, the one that hits
    most of the ways left is taken, until none is left.
    """
    gone = int(n * (1 - share) + 1e-9)
    left = set()
    for out in itertools.combinations(range(n), gone):
        if not any(all(m == "0" or at + i not in out for i, m in enumerate(fixed))
                   for fixed in MASKS for at in range(n - len(fixed) + 1)):
            left.add(frozenset(out))
    ignored = n - min(SHORT_WEIGHT, n - gone)
    choices, masks = [frozenset(c) for c in itertools.combinations(range(n), ignored)] if left else [], []
    while left:
        best = max(choices, key=lambda c: sum(way <= c for way in left))
        left = {way for way in left if not way <= best}
        masks.append("".join("0" if i in best else "1" for i in range(n)))
    return tuple(masks)


def _masks_for(lengths: list[int], share: float = MIN_SHARE) -> tuple[str, ...]:
    """The fixed masks, and the masks of whole items for each length up to 13.

    Of an item of 14 or more words, 80% equal, at least 12 are left between the first and the last equal word, so that
    a fixed mask hits it.
    """
    return MASKS + tuple(m for n in lengths if n <= MIN_OVERLAP for m in short_masks(n, share))


def _item_seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, hashes = [], [], []
            for i, words in enumerate(batch.column(2)):
                tokens = np.asarray(words.values).view("u8")
                for number, (h, size) in enumerate(seed_hashes(tokens, masks)):
                    if number >= len(MASKS) and size != len(tokens):
                        continue  # a mask of whole items of another length
                    row.append(np.full(len(h), i))
                    at.append(np.arange(len(h)))
                    hashes.append(h)
            rows = pa.array(np.concatenate(row)) if row else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows),
                 pa.array(np.concatenate(at) if at else [], pa.int64()),
                 pa.array((np.concatenate(hashes) if hashes else np.empty(0, "u8")).view("i8"))],
                names=["item", "version", "item_at", "seed"])

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(run, f"item {kind}, version long, item_at long, seed long")


def _filter_bits(seeds: DataFrame) -> np.ndarray:
    """Bit filter of all seeds, as bytes; made of 64-bit words that Spark has put together."""
    slot = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = seeds.select(F.shiftright(slot, 6).alias("word"), F.expr(
        f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))").alias("bit"))
    out = np.zeros(1 << (FILTER_BITS - 6), "i8")
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # 2^20 rows at most
        out[r["word"]] = r["bits"]
    return out.view("u1")


def _regions(docs: DataFrame, key: str, text: str, masks: tuple[str, ...], bits: np.ndarray, pad: int) -> DataFrame:
    """Parts of documents with possible hits: key, version, first (index of the first word), words, hits.

    pad words on either side of the hits are in the part; as many as the longest item has, so that an item laid
    over any hit lies inside.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema[key].dataType.simpleString()
    frame = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            row: list[int] = []
            first: list[int] = []
            words: list[np.ndarray] = []
            hits: list[list[dict[str, int]]] = []
            for i, text_ in enumerate(batch.column(2)):
                tokens = _tokens(text_.as_py(), codes)
                for a, b, at, seed in regions(tokens):
                    row.append(i)
                    first.append(a)
                    words.append(tokens[a:b].view("i8"))
                    hits.append([{"at": int(x), "seed": int(s)} for x, s in zip(at, seed.view("i8"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), batch.column(1).take(pa.array(row, pa.int64())),
                 pa.array(first, pa.int64()), pa.array(words, pa.list_(pa.int64())),
                 pa.array(hits, pa.list_(pa.struct([("at", pa.int64()), ("seed", pa.int64())])))],
                names=["key", "version", "first", "words", "hits"])

    def regions(tokens: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        at, seeds, ends = [], [], []
        for h, size in seed_hashes(tokens, masks):
            slot = _slots(h)
            hit = np.flatnonzero(shared.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype("u1") & 1)
            at.append(hit)
            seeds.append(h[hit])
            ends.append(hit + size)
        at, seeds, ends = np.concatenate(at), np.concatenate(seeds), np.concatenate(ends)
        if not len(at):
            return
        order = np.argsort(at, kind="stable")
        at, seeds, ends = at[order], seeds[order], np.maximum.accumulate(ends[order])
        cuts = np.flatnonzero(at[1:] - ends[:-1] > 2 * pad) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(at)]):
            yield max(0, int(at[a]) - pad), min(len(tokens), int(ends[b - 1]) + pad), at[a:b], seeds[a:b]

    return frame.mapInArrow(
        run, f"key {kind}, version long, first long, words array<long>, hits array<struct<at: long, seed: long>>")


def longest_overlap(equal: np.ndarray, need: int, share: float = MIN_SHARE) -> tuple[int, int] | None:
    """Longest stretch of at least `need` positions, begun and ended by equal ones, of which `share` are equal."""
    gain = np.r_[0.0, np.cumsum(np.where(equal, 1 - share, -share))]
    low = np.minimum.accumulate(np.r_[np.where(equal, gain[:-1], np.inf), np.inf])
    high = np.maximum.accumulate(np.r_[-np.inf, np.where(equal, gain[1:], -np.inf)][::-1])[::-1]
    best, i, j = None, 0, 0
    while i < len(gain) and j < len(gain):  # the widest begin i and end j with gain[j] >= gain[i]
        if high[j] >= low[i] - 1e-9:
            if best is None or j - i > best[1] - best[0]:
                best = i, j
            j += 1
        else:
            i += 1
    return best if best and best[1] - best[0] >= need else None


def overlap_of(equal: np.ndarray, whole: int, min_overlap: int, share: float = MIN_SHARE) -> tuple[int, int] | None:
    """The overlap of a document with an item of `whole` words laid over it; equal tells of the positions that both have."""
    if len(equal) == whole and equal.sum() >= share * whole - 1e-9:
        return 0, whole
    return longest_overlap(equal, min_overlap, share) if whole > min_overlap else None


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", min_overlap: int = MIN_OVERLAP, min_share: float = MIN_SHARE, min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row per document and test item that overlap: the longest overlap of the two.

    Columns: key, version (xxhash64 of the text, tells apart rows with one key), item, overlap_words,
    equal_words, item_words, doc_start, item_start (in words from 0). Words are runs of letters, digits and
    underscores, lower-cased. The overlap is the whole item if it lies over words of the document of which min_share are
    equal; else, of an item with more than min_overlap words, the longest such stretch of min_overlap words or more that
    begins and ends with equal words. Null and empty texts overlap nothing, nor do items of fewer than min_words words (1 to 4 words must be met
    verbatim, where asked for); null keys stay null; repeated rows are one; of equally long overlaps the first in the document
    counts. Empty tables give an empty result; other columns are not read. The masks reach every overlap for min_overlap
    from 11 and min_share from 0.8 up.
    """
    items = settle(_items(columns_free_of(benchmark, item, item_text), item, item_text, min_words), "items")
    size = F.size("words")
    lengths = sorted(r["n"] for r in items.select(size.alias("n")).where(size <= MIN_OVERLAP).distinct().collect())  # 13 rows at most
    longest = items.agg(F.max(size)).first()[0] or 0
    masks = _masks_for(lengths, min_share)
    seeds = settle(_item_seeds(items, masks), "seeds")
    regions = settle(_regions(columns_free_of(docs, key, text), key, text, masks, _filter_bits(seeds), longest), "regions")
    hits = regions.select("key", "version", "first", F.explode("hits").alias("h")).select(
        "key", "version", "first", F.col("h.at").alias("at"), F.col("h.seed").alias("seed"))
    lined = hits.join(seeds.withColumnRenamed("version", "item_version"), "seed").select(
        "key", "version", "first", "item", "item_version", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = lined.join(
        regions.select(F.col("key").alias("k"), F.col("version").alias("v"), F.col("first").alias("f"), "words").dropDuplicates(["k", "v", "f"]),
        F.col("key").eqNullSafe(F.col("k")) & (F.col("version") == F.col("v")) & (F.col("first") == F.col("f")),
    ).join(
        items.select(F.col("item").alias("i"), F.col("version").alias("iv"), F.col("words").alias("item_words")),
        F.col("item").eqNullSafe(F.col("i")) & (F.col("item_version") == F.col("iv")),
    ).select("key", "version", "item", "first", "shift", "words", "item_words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for r, (first, shift, words, other) in enumerate(zip(*(batch.column(i) for i in range(3, 7)))):
                words, other = np.asarray(words.values), np.asarray(other.values)
                shift = shift.as_py() - first.as_py()  # index in words of the item's first word
                a, b = max(0, shift), min(len(words), shift + len(other))
                equal = words[a:b] == other[a - shift:b - shift]
                found = overlap_of(equal, len(other), min_overlap, min_share)
                if found:
                    row.append(r)
                    out.append((found[1] - found[0], int(equal[found[0]:found[1]].sum()), len(other),
                                first.as_py() + a + found[0], a - shift + found[0]))
            take = pa.array(row, pa.int64())
            columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(3)), *columns],
                names=["key", "version", "item", "overlap_words", "equal_words", "item_words", "doc_start", "item_start"])

    kinds = f"key {docs.schema[key].dataType.simpleString()}, version long, item {benchmark.schema[item].dataType.simpleString()}"
    found = pairs.mapInArrow(
        verify, f"{kinds}, overlap_words long, equal_words long, item_words long, doc_start long, item_start long")
    best = F.max(F.struct("overlap_words", "equal_words", (-F.col("doc_start")).alias("s"), (-F.col("item_start")).alias("t"), "item_words"))
    return found.groupBy("key", "version", "item").agg(best.alias("b")).select(
        F.col("key").alias(key), "version", F.col("item").alias(item), "b.overlap_words", "b.equal_words", "b.item_words",
        (-F.col("b.s")).alias("doc_start"), (-F.col("b.t")).alias("item_start"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows that overlap a test item."""
    found = find_contamination(docs, benchmark, key, text, **options).select(
        F.col(key).alias("__key"), F.col("version").alias("__version")).distinct()
    same: Column = docs[key].eqNullSafe(found["__key"]) & (F.xxhash64(docs[text]) == found["__version"])
    return docs.join(found, same, "left_anti")

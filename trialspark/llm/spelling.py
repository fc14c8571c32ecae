"""Spelling variants by a bit-sliced position index.

The vocabulary is counted by Spark. Words that differ by one edit share their first or their last half, so words
are dealt to groups by those halves and only meet inside a group. Neighbouring groups form a block with an index:
one bitset over the block's words for each (position, letter). All words of a block run through it at once; four
bitsets for each word (no error so far, one letter replaced, one more, one less) advance letter by letter, the last
two by bitsets of the next and the previous position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import settle

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE = 199  # a run whose hash it divides loses a letter
MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5  # a form is at least so many times as frequent as its variant
GROUP_WORDS = 2_048  # a larger group is dealt again by longer shared parts
BLOCK_CELLS = 1 << 17  # words times letters of one index, unless a single group has more
QUERIES = 1_024  # words that run through an index together


def count_words(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
    damage: int = DAMAGE,
) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, some of them damaged by a hash of key and run; rare and short ones left out."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(
        F.regexp_extract_all(F.col(text), F.lit(f"({RUN})"))).alias("run"))
    low = runs.select("key", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.encode(F.concat_ws(":", "key", "run"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(
        F.col("n") >= min_count)


class PositionIndex:
    """Bitsets over words: by (position, letter), by position that a word reaches, and by length."""

    def __init__(self, words: list[str]):
        self.size = len(words)
        self.lengths = np.fromiter(map(len, words), "i8", self.size)
        self.longest = int(self.lengths.max())
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "u4")
        self.letters = np.unique(flat)
        number = np.searchsorted(self.letters, flat)
        self.codes = np.full((self.size, self.longest), -1, "i4")  # -1: past the end
        inside = np.arange(self.longest) < self.lengths[:, None]
        self.codes[inside] = number
        none = np.zeros((len(self.letters), -(-self.size // 64)), "u8")
        self.at, self.reach = [], []
        for column in self.codes.T:
            here = np.zeros((len(self.letters), self.size), bool)
            some = np.flatnonzero(column >= 0)
            here[column[some], some] = True
            self.at.append(self._packed(here))
            self.reach.append(self._packed(column[None, :] >= 0)[0])
        self.at += [none, none]
        self.reach += [none[0], none[0]]
        self.none = none

    def _packed(self, flags: np.ndarray) -> np.ndarray:
        width = -(-self.size // 64) * 8
        packed = np.packbits(flags, axis=1, bitorder="little")
        return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, width - packed.shape[1])))).view("u8")

    def _of_length(self, length: int) -> np.ndarray:
        return self._packed((self.lengths == length)[None, :])[0]

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) of indexes of words one edit apart; the queries are words of the index, by number."""
        queries = queries[np.argsort(-self.lengths[queries], kind="stable")]
        sizes = self.lengths[queries]
        zero = np.broadcast_to(self._packed(np.ones((1, self.size), bool)), (len(queries), len(self.reach[0]))).copy()
        swapped, shorter = np.zeros_like(zero), np.zeros_like(zero)
        longer = zero & self.reach[0]
        out_query, out_word = [np.empty(0, "i8")], [np.empty(0, "i8")]
        for step in range(int(sizes[0]) + 1):
            ended = np.flatnonzero(sizes == step)
            if len(ended):
                hit = ((swapped[ended] & self._of_length(step)) | (longer[ended] & self._of_length(step + 1))
                       | (shorter[ended] & self._of_length(step - 1)))
                row, word = np.nonzero(hit)
                bits = np.unpackbits(hit[row, word].view("u1").reshape(-1, 8), axis=1, bitorder="little")
                which, bit = np.nonzero(bits)
                out_query.append(queries[ended[row[which]]])
                out_word.append(word[which] * 64 + bit)
            n = int(np.searchsorted(-sizes, -step, "left"))  # queries with a letter left
            if n == 0:
                break
            zero, swapped, longer, shorter = zero[:n], swapped[:n], longer[:n], shorter[:n]
            letter = self.codes[queries[:n], step]
            here, after = self.at[step][letter], self.at[step + 1][letter]
            before = self.at[step - 1][letter] if step else self.none[letter]
            shorter = (shorter & before) | zero
            swapped = (swapped & here) | (zero & self.reach[step] & ~here)
            zero = zero & here
            longer = (longer & after) | (zero & self.reach[step + 1])
        return np.concatenate(out_query), np.concatenate(out_word)


def _group(words: DataFrame) -> DataFrame:
    """words (word, n, c, p, s) with the name of their group: the first p and the last s letters of words of c or c + 1 letters."""
    size = F.char_length("word")
    return words.withColumn("name", F.concat_ws(
        ":", "c", "p", "s", F.col("word").substr(F.lit(1), F.col("p")), F.col("word").substr(size - F.col("s") + 1, F.col("s"))))


def _grouped(vocabulary: DataFrame, min_letters: int, group_words: int) -> DataFrame:
    """Every word in the groups in which its neighbours are: as the longer word of a pair and as one not longer.

    A group with more than group_words words is replaced by two with a longer shared start or a longer shared end, until it
    is small or its words differ in one place only, of which the alphabet bounds the number.
    """
    size = F.char_length("word")
    classes = F.filter(F.array(size, size - 1), lambda c: c >= min_letters)
    words = vocabulary.select("word", "n", F.explode(classes).alias("c"))
    half = F.floor(F.col("c") / 2).cast("int")
    parts = F.array(F.struct(half.alias("p"), F.lit(0).alias("s")), F.struct(F.lit(0).alias("p"), (F.col("c") - half).alias("s")))
    open_ = settle(_group(words.select("word", "n", "c", F.explode(parts).alias("part")).select(
        "word", "n", "c", "part.p", "part.s")), "groups")
    done: DataFrame | None = None
    while True:
        left = F.col("c") - F.col("p") - F.col("s")
        hot = settle(open_.where(left > 1).groupBy("name").agg(F.count("*").alias("m")).where(
            F.col("m") > group_words).select("name"), "hot")
        if hot.isEmpty():
            return done.unionByName(open_) if done else open_
        calm = open_.join(hot, "name", "left_anti").select(open_.columns)
        done = done.unionByName(calm) if done else calm
        step = F.floor(left / 2).cast("int")
        parts = F.array(F.struct((F.col("p") + step).alias("p"), F.col("s")), F.struct(F.col("p"), (F.col("s") + left - step).alias("s")))
        open_ = settle(_group(open_.join(hot, "name", "left_semi").select("word", "n", "c", F.explode(parts).alias("part")).select(
            "word", "n", "c", "part.p", "part.s")), "groups")


def near_words(
    vocabulary: DataFrame, min_letters: int = MIN_LETTERS, group_words: int = GROUP_WORDS, block_cells: int = BLOCK_CELLS
) -> DataFrame:
    """word, near, near_n: all ordered pairs of words that one inserted, deleted or replaced letter tells apart.

    vocabulary: word (distinct, of min_letters letters or more), n.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        counts: list[int] = []
        groups: list[int] = []
        classes: list[int] = []
        name, begin, longest = None, 0, 0
        for batch in batches:
            for word, n, c, group in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if group != name:
                    if len(words) - begin == 1:  # alone in its group
                        for held in (words, counts, groups, classes):
                            held.pop()
                    if len(words) * longest >= block_cells:
                        yield from block(words, counts, groups, classes)
                        words, counts, groups, classes, longest = [], [], [], [], 0
                    name, begin = group, len(words)
                words.append(word)
                counts.append(n)
                groups.append(begin)
                classes.append(c)
                longest = max(longest, len(word))
        if words:
            yield from block(words, counts, groups, classes)

    def block(words: list[str], counts: list[int], groups: list[int], classes: list[int]) -> Iterator[pa.RecordBatch]:
        index = PositionIndex(words)
        texts, n, group, short = pa.array(words), np.array(counts), np.array(groups), np.array(classes)
        for first in range(0, len(words), QUERIES):
            a, b = index.near(np.arange(first, min(len(words), first + QUERIES)))
            keep = (group[a] == group[b]) & (np.minimum(index.lengths[a], index.lengths[b]) == short[a])
            a, b = a[keep], b[keep]
            yield pa.RecordBatch.from_arrays(
                [texts.take(pa.array(a)), texts.take(pa.array(b)), pa.array(n[b])], names=["word", "near", "near_n"])

    groups = _grouped(vocabulary, min_letters, group_words).select("word", "n", "c", "name")
    found = groups.repartition("name").sortWithinPartitions("c", "name").mapInArrow(run, "word string, near string, near_n long")
    return found.distinct()  # a pair may share its start and its end


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms of each word that has one; every round doubles the steps taken."""
    roots = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = roots.select(F.col("word").alias("at"), F.col("root").alias("on"))
        moved = settle(roots.join(next_, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def spelling_forms(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
    damage: int = DAMAGE, ratio: int = RATIO, group_words: int = GROUP_WORDS,
) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    Words are runs of letters with A-Z lower-cased; a run whose crc32 with its key `damage` divides loses one letter. form
    is the most frequent word one edit away (ties: the smallest by code points) if it is at least `ratio` times as
    frequent, else null, as is form_n; root ends the chain of forms and is the word itself without one. Null and empty
    texts have no words; a null key counts as an empty text; repeated rows are counted each. Words of any length are
    compared whole. An empty table gives an empty result; other columns are not read.
    """
    vocabulary = settle(count_words(docs, key, text, min_letters, min_count, damage), "vocabulary")
    first: Column = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    near = near_words(vocabulary, min_letters, group_words).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("best"))
    fits = -F.col("best.m") >= ratio * F.col("n")
    told = settle(vocabulary.join(near, "word", "left").select(
        "word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("best.m")).alias("form_n")), "forms")
    return told.join(_roots(told.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Phrase collocations by Toivonen's method.

The texts are read once and written as word numbers. A sample of the documents proposes phrases: those that reach a
lowered count in it. A full pass counts the proposed phrases and their negative border, that is every phrase of which
both parts without the last and without the first word were proposed: first by 64-bit hashes, which never count too
little, then, for the hashes that are frequent, exactly by their words. A phrase of the border that turns out frequent
was missed by the sample; then a further pass counts what it opens, until nothing new is frequent. Sets of phrases
travel as filters of bits: a false hit only counts one more phrase, so the counts stay exact and the filters never grow.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import settle

MAX_WORDS = 4
MIN_COUNT = 30
KEEP = 2_000  # phrases reported for each language
SHARE = 4  # every fourth document, by a hash, is in the sample
INSIDE_PERCENT = 80  # a phrase goes if a longer one that holds it has so many percent of its count
FILTER_BITS = 26  # 8 MB, whatever the number of phrases
LOW_BITS = 24  # of a hash, sent besides its group
CHUNK = 400_000  # words numbered and counted together in a task
GROUP_HASHES = 1_000_000  # about so many hashes of all chunks are counted together
BREAK = 0
PARTS = 32  # groups merged at a time on the way to the first rows of a language
CODE = np.uint64(0x9E3779B97F4A7C15)
PIECES = bytes.maketrans(b".,;:!?\n\v\f\r\t", b"\n" * 10 + b" ")
TOKENS = "sample int, ids binary, codes binary, lang string, word string, n long"


class _Chunk:
    """Whole texts as word numbers with breaks between their pieces. Words are UTF-8."""

    def __init__(self, seed: int):
        self.seed, self.size = seed, 0
        self.known: dict[str, _Words] = {}
        self.ids: list[np.ndarray] = []
        self.langs, self.words = [""], [b"\n"]

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.known:
            self.known[lang] = _Words(lang, self.langs, self.words)
        words = list(filter(None, text.lower().translate(PIECES).replace(b"\n", b" \n ").split(b" ")))  # lower() knows A-Z only
        words.append(b"\n")
        self.ids.append(np.fromiter(map(self.known[lang].__getitem__, words), "u4", len(words)))
        self.size += len(words)

    def rows(self, sample: int) -> pa.RecordBatch:
        """One row with the numbers and the codes of their words, and one row for each word with its count."""
        ids = np.concatenate(self.ids)
        codes = _word_codes(self.langs, self.words, self.seed)
        codes[BREAK] = 0
        some = pa.nulls(len(codes) - 1, pa.binary())
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(codes), sample, "i4")), pa.concat_arrays([pa.array([ids.tobytes()], pa.binary()), some]),
            pa.concat_arrays([pa.array([codes.tobytes()], pa.binary()), some]), pa.array(self.langs, pa.string()),
            pa.array([None, *self.words[1:]], pa.binary()).cast(pa.string()), pa.array(np.bincount(ids, minlength=len(codes)))],
            names=[c.split()[0] for c in TOKENS.split(", ")])


def _word_codes(langs: list[str], words: list[bytes], seed: int) -> np.ndarray:
    starts = {g: xxhash.xxh64_intdigest(g, seed) for g in set(langs)}
    return np.fromiter(map(xxhash.xxh64_intdigest, words, map(starts.__getitem__, langs)), "u8", len(words))


class _Words(dict):
    """Numbers of the words of one language; all languages of a chunk share the lists of words and their languages."""

    def __init__(self, lang: str, langs: list[str], words: list[bytes]):
        super().__init__({b"\n": BREAK})
        self.lang, self.langs, self.words = lang, langs, words

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.langs.append(self.lang)
        self.words.append(word)
        return number


def _numbered(docs: DataFrame, key: str, text: str, lang: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(tokens, vocabulary): sample, ids, codes of chunks of texts; lang, word, code, n of all words.

    A code tells a word and its language. Two words with one code, or a code like that of a break, would spoil the counts:
    then all is numbered again by another hash.
    """
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
        (F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(SHARE)) == 0).cast("int").alias("sample"))
    for seed in itertools.count():
        def run(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            open_ = [_Chunk(seed), _Chunk(seed)]
            for batch in batches:
                for lang_, text_, sample in zip(*batch.columns):
                    sample = sample.as_py()
                    open_[sample].add(lang_.as_py(), text_.as_py())
                    if open_[sample].size >= chunk:
                        yield open_[sample].rows(sample)
                        open_[sample] = _Chunk(seed)
            for sample, held in enumerate(open_):
                if held.size:
                    yield held.rows(sample)

        written = settle(rows.mapInArrow(run, TOKENS), "tokens")

        def coded(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(_word_codes(
                        batch.column(0).to_pylist(), batch.column(1).to_pylist(), seed).view("i8"))], names=[*batch.schema.names, "code"])

        words = written.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        vocabulary = settle(words.mapInArrow(coded, "lang string, word string, n long, code long"), "words")
        if vocabulary.groupBy("code").agg(F.count("*").alias("m")).where("m > 1 OR code = 0").isEmpty():
            return written.where("ids IS NOT NULL").select("sample", "ids", "codes"), vocabulary


class _Filter:
    """Bits of hashes; may say yes to a hash that was never put in, never no to one that was."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - FILTER_BITS)
        return (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype("u1") & 1).astype(bool)


def _longer(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * CODE + last
    return (h ^ (h >> np.uint64(29))) * CODE


def _levels(word: np.ndarray, most: int, proposed: _Filter, before: _Filter | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 1 to `most` words the places and hashes of the phrases that this pass counts; word: codes, 0 at breaks.

    All single words, and a longer phrase if both its parts without an end are proposed, unless the pass before counted it.
    That pass knew a phrase only if it knew both parts and they were proposed then: a false hit of a part whose own words
    were not proposed does not count.
    """
    at = np.flatnonzero(word)
    h = word[at]
    known = np.full(len(h), before is not None)
    yield 1, at, h
    for k in range(2, most + 1):
        yes = proposed(h)
        if before is not None:
            known = known & before(h)
        pair = np.flatnonzero((at[1:] == at[:-1] + 1) & yes[1:] & yes[:-1])
        known = known[pair] & known[pair + 1]
        at, h = at[pair], _longer(h[pair], word[at[pair] + k - 1])
        yield k, at[~known], h[~known]


def _bits(hashes: DataFrame) -> np.ndarray:
    """Bit filter of a column h, as bytes; Spark puts its 64-bit words together, at most 2^20 rows arrive."""
    words = hashes.select(
        F.shiftrightunsigned("h", 64 - FILTER_BITS + 6).alias("word"),
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), "i8")
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view("u1")


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and codes of the words of each chunk."""
    for batch in batches:
        for ids, codes in zip(batch.column("ids"), batch.column("codes")):
            yield np.frombuffer(ids.as_buffer(), "u4"), np.frombuffer(codes.as_buffer(), "u8")


def _hash_counts(
    tokens: DataFrame, sizes: tuple[int, ...], least: int, groups: int, proposed: Broadcast, before: Broadcast | None
) -> np.ndarray:
    """Filter of the hashes of phrases of `sizes` words that this pass meets at least `least` times.

    Hashes are dealt to groups, a power of two, by their first bits; a chunk sends its sorted hashes of a group as one
    row, of each the next 24 bits, first those met once and then the others with their counts. Hashes that agree so far
    are counted together, which only lets more through, and at least as many bits are told apart as the filter has.
    """
    groups = max(groups, 1 << max(0, FILTER_BITS - LOW_BITS))
    first = groups.bit_length() - 1
    kind = np.min_scalar_type(least)  # a count beyond the threshold says no more than the threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes in _codes(batches):
            found = [h for k, _, h in _levels(codes[ids], max(sizes), _Filter(proposed.value), before and _Filter(before.value))
                     if k in sizes]
            h, n = np.unique(np.concatenate(found) >> np.uint64(64 - first - LOW_BITS), return_counts=True)
            group = (h >> np.uint64(LOW_BITS)).astype("i8")
            order = np.argsort(group * 2 + (n > 1), kind="stable")
            h, n, group = h[order], n[order], group[order]
            low = np.ascontiguousarray(h.astype("<u4").view("u1").reshape(-1, 4)[:, :LOW_BITS // 8])
            begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(h) else np.zeros(0, "i8")
            ends = [*begin[1:], len(h)]
            n = np.minimum(n, least).astype(kind)
            yield pa.RecordBatch.from_arrays([
                pa.array(group[begin]), pa.array([low[a:b].tobytes() for a, b in zip(begin, ends)], pa.binary()),
                pa.array([n[a:b][n[a:b] > 1].tobytes() for a, b in zip(begin, ends)], pa.binary())], names=["part", "low", "n"])

    def counted(table: pa.Table) -> pa.Table:
        lows, counts = [], []
        for x, y in zip(table["low"], table["n"]):
            own = np.frombuffer(x.as_buffer(), "u1").reshape(-1, LOW_BITS // 8)
            wide = np.zeros((len(own), 4), "u1")
            wide[:, :LOW_BITS // 8] = own
            lows.append(wide.view("<u4").ravel())
            many = np.frombuffer(y.as_buffer(), kind)
            counts += [np.ones(len(own) - len(many), kind), many]
        low, n = np.concatenate(lows), np.concatenate(counts)
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order].astype("i8")
        begin = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        often = low[begin[np.add.reduceat(n, begin) >= least]].astype("u8")
        part = np.uint64(table["part"][0].as_py())
        h = (part << np.uint64(LOW_BITS) | often) << np.uint64(64 - first - LOW_BITS)
        return pa.table({"h": h.view("i8")})

    rows = tokens.mapInArrow(run, "part long, low binary, n binary")
    return _bits(rows.groupBy("part").applyInArrow(counted, "h long"))


def _pass(tokens: DataFrame, most: int, least: int, groups: int, proposed: Broadcast, before: Broadcast | None) -> DataFrame:
    """phrase (array of codes), h, n of the frequent phrases of 2 words or more that this pass counts."""
    often = _hash_counts(tokens, tuple(range(2, most + 1)), least, groups, proposed, before)
    wanted = tokens.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes in _codes(batches):
            width = np.int64(len(codes))
            for k, at, h in _levels(codes[ids], most, _Filter(proposed.value), before and _Filter(before.value)):
                keep = np.flatnonzero(_Filter(wanted.value)(h)) if k > 1 else []
                if not len(keep):
                    continue
                at, h = at[keep], h[keep]
                rank = ids[at].astype("i8")
                for j in range(1, k):
                    rank = np.unique(rank * width + ids[at + j], return_inverse=True)[1]
                _, first, n = np.unique(rank, return_index=True, return_counts=True)
                phrase = codes[ids[at[first][:, None] + np.arange(k)]].tobytes()
                ends = pa.array(np.arange(len(n) + 1, dtype="i4") * (8 * k))
                yield pa.RecordBatch.from_arrays(
                    [pa.Array.from_buffers(pa.binary(), len(n), [None, ends.buffers()[1], pa.py_buffer(phrase)]), pa.array(n)],
                    names=["phrase", "n"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrase = [np.frombuffer(x.as_buffer(), "u8") for x in batch.column("phrase")]
            size = np.array([len(x) for x in phrase], "i8")
            h = np.zeros(len(size), "u8")
            for k in np.unique(size):
                own = np.stack([x for x in phrase if len(x) == k])
                told = own[:, 0]
                for j in range(1, k):
                    told = _longer(told, own[:, j])
                h[size == k] = told
            whole = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(size)].astype("i4")), pa.array(np.concatenate([np.zeros(0, "u8"), *phrase]).view("i8")))
            yield pa.RecordBatch.from_arrays([whole, pa.array(h.view("i8")), batch.column("n")], names=["phrase", "h", "n"])

    counted = tokens.mapInArrow(run, "phrase binary, n long").groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = settle(counted.mapInArrow(hashed, "phrase array<long>, h long, n long"), "phrases")
    wanted.destroy()  # it lies on every executor's disk
    return out


def frequent_phrases(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MAX_WORDS, least: int = MIN_COUNT,
    chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, phrase, words, n of all phrases of 1 to `most` words that occur at least `least` times; lang, n.

    The lowered count of the sample is half of what it would hold of a phrase that is just frequent; what it misses is found by
    further passes, at most `most`.
    """
    tokens, vocabulary = _numbered(docs, key, text, lang, chunk)
    size = vocabulary.agg(F.sum("n")).first()[0] or 0
    groups = min(1 << 31, 1 << max(0, -(-size * most // GROUP_HASHES) - 1).bit_length())
    proposed = _proposed(tokens, most, max(1, least // (2 * SHARE)), groups)
    often = vocabulary.where(F.col("n") >= least)
    found, before, context = None, None, tokens.sparkSession.sparkContext
    while most > 1:
        now = context.broadcast(proposed)
        more = _pass(tokens, most, least, groups, now, before)
        if before:
            before.destroy()
        found = found.unionByName(more) if found else more
        opened = found.where(F.size("phrase") < most).select("h").union(often.select("code"))
        before, wider = now, proposed | _bits(opened)
        if np.array_equal(wider, proposed):
            before.destroy()
            break
        proposed = wider
    single = often.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    if found is None:
        return single, totals
    parts = found.select("phrase", "n", F.posexplode("phrase").alias("place", "code")).join(often.select("lang", "word", "code"), "code")
    texts = parts.groupBy("phrase", "n").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    return texts.select("lang", F.array_join("w.word", " ").alias("phrase"), F.size("w").alias("words"), "n").union(single), totals


def _proposed(tokens: DataFrame, most: int, least: int, groups: int) -> np.ndarray:
    """Filter of the phrases of fewer than `most` words that the sample holds at least `least` times, level by level."""
    sample = tokens.where("sample = 1")
    bits = np.zeros(1 << (FILTER_BITS - 3), "u1")
    for k in range(1, most):
        now = tokens.sparkSession.sparkContext.broadcast(bits)
        bits = bits | _hash_counts(sample, (k,), least, groups, now, None)
        now.destroy()
    return bits


def first_rows(rows: DataFrame, group: str, order: list[Column], unique: str, keep: int, rows_a_task: int = 100_000) -> DataFrame:
    """The first `keep` rows of each group with their `rank` from 1; a group is cut by a hash of `unique` and merged in steps.

    No task orders more than about rows_a_task rows, or `keep` rows of each of 32 parts.
    """
    parts = max(1, -(-rows.count() // rows_a_task))
    while True:
        place = Window.partitionBy(group, "part").orderBy(*order)
        ranked = rows.withColumn("part", F.pmod(F.xxhash64(unique), F.lit(parts))).withColumn(
            "rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= keep).drop("part")
        if parts == 1:
            return ranked
        rows, parts = ranked.drop("rank"), -(-parts // PARTS)


def mine_collocations(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MAX_WORDS, least: int = MIN_COUNT,
    keep: int = KEEP, inside_percent: int = INSIDE_PERCENT, chunk: int = CHUNK,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `keep` best phrases of 2 to `most` words of each language.

    Texts end at . , ; : ! ? and line ends into pieces, those at blanks and tabs into words; A-Z are lower-cased. a is the
    phrase's count, l and r those of its two parts at the cut with the smallest score floor(2000000 a / (l + r)), n all
    words of the language. A phrase inside a longer one with 80% of its count goes. Ties: smaller cuts, larger a, then
    phrases by their bytes. Null texts are empty; a null language is `und`; null keys only decide on the sample;
    repeated rows are counted each; words of any length are kept whole. An empty table gives an empty result; other
    columns are not read.
    """
    found, totals = frequent_phrases(docs, key, text, lang, most, least, chunk)
    found = settle(found, "frequent")
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    split = F.split("phrase", " ")
    cuts = candidates.withColumn("w", split).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"))
    parts = found.where(F.col("words").between(1, most - 1)).select("lang", "phrase", "n")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    rest = F.expr("substring(phrase, length(first) + 2)").alias("rest")  # made after the first join, so that it is moved once
    cuts = cuts.select("lang", "phrase", "a", "k", "l", rest).join(
        parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = "cast({} as decimal(20, 0))".format
    score = F.expr(f"cast(2000000 as decimal(7, 0)) * {wide('a')} div ({wide('l')} + {wide('r')})")
    scored = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.min("a").alias("a"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, k), " "))))
    inside = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy(
        "lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = F.expr(f"cast(100 as decimal(3, 0)) * {wide('longer')} >= cast({int(inside_percent)} as decimal(3, 0)) * {wide('a')}")
    stay = settle(scored.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")
    best = first_rows(stay, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], "phrase", keep)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

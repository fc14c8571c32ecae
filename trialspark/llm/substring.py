"""Repeated passages by compressed full-text indexes, one for each shard.

A window is 50 neighbouring words. Equal windows choose the same core, the word group in them with the smallest
hash; neighbouring windows with one core form a segment. Cores that stand in one document only cannot lie in a
repeated window and drop out early. What is left is dealt to shards by core. Each shard builds an FM-index over its
distinct segments: the Burrows-Wheeler transform of their words in a wavelet matrix of packed bits. All segments
are streamed through it backwards; matching statistics, cut off at 50 words, give for every window the interval
of its occurrences and with it the smallest document that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import settle

WINDOW = 50
CORE = 12  # words of a core
LONGEST_RUN = 64  # windows of a segment
HOT_SEGMENTS = 2_000  # a core with more distinct segments is cut to its repeated windows, one with more runs of these to windows
SHARD_WORDS = 300_000  # words of one index
FILTER_BITS = 26  # 8 MB, whatever the size of the corpus
HOT_WINDOWS = 256  # a window in more segments of a hot core is common
SALTS = 32  # tasks over which the rows of one hot core, or with one common window, are spread
LAST = (1 << 63) - 1  # stands for a null document id, which is larger than all others
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Hasher:
    """Hashes of word groups from prefix sums of word codes times powers of an odd number."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.power = self.back = np.ones(1, "u8")

    def prefix(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        if n >= len(self.power):
            self.power = np.r_[np.uint64(1), np.cumprod(np.full(2 * n, BASE))]
            self.back = np.r_[np.uint64(1), np.cumprod(np.full(2 * n, INVERSE))]
        codes = self.codes
        if len(codes) > 500_000:
            codes.clear()
        for w in set(words).difference(codes):
            codes[w] = xxhash.xxh64_intdigest(w)
        values = np.fromiter(map(codes.__getitem__, words), "u8", n)
        return np.r_[np.uint64(0), np.cumsum(values * self.power[:n])]

    def groups(self, prefix: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        h = (prefix[start + size] - prefix[start]) * self.back[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def segments(prefix: np.ndarray, hasher: Hasher, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, and core of the segments of a text with at least one window."""
    core = min(CORE, window)
    n = len(prefix) - 1
    least = hasher.groups(prefix, np.arange(n - core + 1), core)
    width, span = 1, window - core + 1
    while width < span:  # smallest hash among the cores of each window, by doubling
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    size = np.diff(np.r_[begin, len(least)])
    parts = -(-size // LONGEST_RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(begin, parts) + nth * LONGEST_RUN
    return start, np.minimum(np.repeat(size, parts) - nth * LONGEST_RUN, LONGEST_RUN), least[start]


class WaveletMatrix:
    """Sequence of symbols as one packed bitmap per binary digit, with counts of ones before each 64-bit word."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.shifts = list(range(max(1, int(top).bit_length()) - 1, -1, -1))
        for shift in self.shifts:
            bits = (symbols >> shift) & 1
            packed = np.packbits(np.r_[bits, np.zeros(64 - len(bits) % 64, bits.dtype)].astype("u1"), bitorder="little").view("u8")
            ones = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype="i8")]
            self.levels.append((packed, ones, len(bits) - int(ones[-1])))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        every = np.arange(top + 1)
        self.first = self._down(every, np.zeros(top + 1, "i8"))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, (packed, ones, zeros) in zip(self.shifts, self.levels):
            word, bit = at >> 6, (at & 63).astype("u8")
            rank = ones[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            at = np.where((symbol >> shift) & 1, zeros + rank, at - rank)
        return at

    def count(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, at) - self.first[symbol]


class ShardIndex:
    """FM-index over pieces of text (lists of symbols from 1), each with the smallest document that holds it."""

    def __init__(self, pieces: list[np.ndarray], docs: np.ndarray, window: int):
        self.window = window
        sizes = np.fromiter(map(len, pieces), "i8", len(pieces))
        self.end = np.cumsum(sizes + 1) - 1  # the separators' places
        text = np.zeros(int((sizes + 1).sum()), "i8")
        inside = np.ones(len(text), bool)
        inside[self.end] = False
        text[inside] = np.concatenate(pieces)
        rank = text
        equal_at_window, reach = None, 1
        while reach <= window:  # ranks by the first 1, 2, 4, ... words; longer ties need no order for patterns of this length
            after = np.r_[rank[reach:], np.full(min(reach, len(rank)), -1)][:len(rank)]
            if reach * 2 > window and equal_at_window is None:
                rest = np.r_[rank[window - reach:], np.full(min(window - reach, len(rank)), -1)][:len(rank)]
                equal_at_window = rank, rest
            _, rank = np.unique(rank * (len(text) + 2) + after + 1, return_inverse=True)
            reach *= 2
        order = np.argsort(rank, kind="stable")
        head, rest = (x[order] for x in equal_at_window)
        self.starts = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (rest[1:] != rest[:-1])])
        self.ends = np.r_[self.starts[1:], len(text)]
        self.least = np.minimum.reduceat(np.repeat(docs, sizes + 1)[order], self.starts)
        top = int(text.max())
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 1))]
        self.transform = WaveletMatrix(text[order - 1], top)
        self.size = len(text)

    def least_documents(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each piece, the smallest document of the index that has it; the largest number where none has."""
        sizes = np.fromiter(map(len, pieces), "i8", len(pieces))
        by = np.argsort(-sizes, kind="stable")
        sizes = sizes[by]
        begin = np.cumsum(sizes) - sizes
        flat = np.concatenate([pieces[i] for i in by])
        out = np.full((len(pieces), int(sizes[0])), LAST, "i8")
        low, high = np.zeros(len(pieces), "i8"), np.full(len(pieces), self.size)
        for step in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -step, "left"))  # pieces with another word to their left
            symbol = flat[begin[:n] + sizes[:n] - 1 - step]
            low = self.before[symbol] + self.transform.count(symbol, low[:n])
            high = self.before[symbol] + self.transform.count(symbol, high[:n])
            if step >= self.window:  # the statistics end at the window's length: back to all that share it
                group = np.searchsorted(self.starts, low, "right") - 1
                some = high > low
                low, high = np.where(some, self.starts[group], low), np.where(some, self.ends[group], high)
            if step >= self.window - 1:
                group = np.searchsorted(self.starts, low, "right") - 1
                out[:n, step] = np.where(high > low, self.least[group], LAST)
        found = [out[i, self.window - 1:s][::-1] for i, s in enumerate(sizes)]
        back = np.empty(len(by), "i8")
        back[by] = np.arange(len(by))
        return [found[i] for i in back]


def _bits_of(cores: DataFrame) -> np.ndarray:
    words = cores.select(
        F.shiftrightunsigned("core", 64 - FILTER_BITS + 6).alias("word"),
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(core, {64 - FILTER_BITS}) & 63 as int))").alias("bit"))
    out = np.zeros(1 << (FILTER_BITS - 6), "i8")
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # 2^20 rows at most
        out[r["word"]] = r["bits"]
    return out.view("u1")


def _cores(texts: DataFrame, window: int) -> DataFrame:
    """core of every segment that stands in more than one document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            cores, docs = [np.empty(0, "i8")], [np.empty(0, "i8")]
            for doc, text in zip(batch.column(0), batch.column(2)):
                words = (text.as_py() or b"").split()
                if len(words) >= window:
                    core = np.unique(segments(hasher.prefix(words), hasher, window)[2]).view("i8")
                    cores.append(core)
                    docs.append(np.full(len(core), doc.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (cores, docs)], names=["core", "doc"])

    found = texts.mapInArrow(run, "core long, doc long")
    return found.groupBy("core").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("core")


def _segments(texts: DataFrame, bits: np.ndarray, window: int) -> DataFrame:
    """Segments whose core may be repeated: core, content (a hash), windows, doc, version, start."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        names = ["core", "content", "windows", "doc", "version", "start"]
        for batch in batches:
            rows: list[list[np.ndarray]] = [[np.empty(0, "i8")] for _ in names]
            for doc, version, text in zip(*batch.columns):
                words = (text.as_py() or b"").split()
                if len(words) < window:
                    continue
                prefix = hasher.prefix(words)
                start, size, core = segments(prefix, hasher, window)
                slot = core >> np.uint64(64 - FILTER_BITS)
                keep = np.flatnonzero(shared.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype("u1") & 1)
                start, size, core = start[keep], size[keep], core[keep]
                content = hasher.groups(prefix, start, size + window - 1)
                for row, x in zip(rows, (core.view("i8"), content.view("i8"), size, np.full(len(keep), doc.as_py()),
                                         np.full(len(keep), version.as_py()), start)):
                    row.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r).astype("i8")) for r in rows], names=names)

    return texts.mapInArrow(run, "core long, content long, windows long, doc long, version long, start long")


def _bodies(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Words of the wanted segments (one list per text): core, content, windows, first, last, body, marks.

    marks are the hashes of the windows of hot segments, else null.
    """
    lists = wanted.groupBy("doc", "version").agg(F.collect_list(
        F.struct("start", "windows", "core", "content", "last", "hot")).alias("segments"))
    joined = texts.join(lists, ["doc", "version"]).dropDuplicates(["doc", "version"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            out = []
            for doc, text, listed in zip(batch.column("doc"), batch.column("text"), batch.column("segments")):
                words = text.as_py().split()
                prefix = None
                for s in listed.as_py():
                    a, n = s["start"], s["windows"]
                    marks = None
                    if s["hot"]:
                        prefix = hasher.prefix(words) if prefix is None else prefix
                        marks = hasher.groups(prefix, np.arange(a, a + n), window).view("i8").tolist()
                    out.append((s["core"], s["content"], n, doc.as_py(), s["last"], b" ".join(words[a:a + n + window - 1]), marks))
                if len(out) >= 20_000:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.list_(pa.int64())]
        names = ["core", "content", "windows", "first", "last", "body", "marks"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return joined.select("doc", "text", "segments").mapInArrow(
        run, "core long, content long, windows long, first long, last long, body binary, marks array<long>")


def _crowded(rows: DataFrame, limit: int, content: str) -> DataFrame:
    """rows with hot: whether their core has more than `limit` of them.

    The table of hot cores is at most SALTS / limit of the rows, so a copy for each salt costs little, and no task
    gets all rows of a core.
    """
    hot = rows.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(
        "core", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("hot"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(content), F.lit(SALTS)).cast("int"))
    return salted.join(hot, ["core", "salt"], "left").drop("salt").withColumn("hot", F.coalesce("hot", F.lit(False)))


def _trim(hot: DataFrame, window: int) -> DataFrame:
    """Hot segments cut to runs of windows whose hash stands in more than one document.

    core, content, windows of the segment; place, part (a hash), part_windows, first, last, body of the run. A core in a
    very common passage has as many surroundings as documents; the windows that reach into them go here, and
    the runs that stay are alike in all documents.
    """
    keys = ["core", "content", "windows"]
    each = hot.select(*keys, "first", "last", F.posexplode("marks").alias("place", "mark"))
    counted = each.groupBy("core", "mark").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.count("*").alias("n"))
    often = counted.where("a < b").select("core", "mark", F.expr(f"n > {HOT_WINDOWS}").alias("common"))
    # Rows with a common window first, spread over salts, so that no task gets all of them; then the others.
    common = often.where("common").select("core", "mark", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "common")
    salted = each.withColumn("salt", F.pmod(F.xxhash64("content", "place"), F.lit(SALTS)).cast("int"))
    told = salted.join(common, ["core", "mark", "salt"], "left")
    rest = told.where("common is null").drop("common").join(often.where("not common"), ["core", "mark"])
    kept = told.where("common").unionByName(rest).groupBy(*keys).agg(F.sort_array(F.collect_list("place")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words, places = r["body"].split(), np.array(r["places"])
                for part in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                    body = b" ".join(words[part[0]:part[-1] + window])
                    out.append((r["core"], r["content"], r["windows"], int(part[0]), xxhash.xxh64_intdigest(body) - (1 << 63),
                                len(part), r["first"], r["last"], body))
            kinds = [pa.int64()] * 8 + [pa.binary()]
            names = [*keys, "place", "part", "part_windows", "first", "last", "body"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    longs = ", ".join(f"{n} long" for n in [*keys, "place", "part", "part_windows", "first", "last"])
    return hot.drop("marks").join(kept, keys).mapInArrow(run, f"{longs}, body binary")


def _windows(runs: DataFrame, window: int) -> DataFrame:
    """Every window of the runs: core, part, part_windows, first, last of the run; place, mark (a hash), body of the window."""
    names = ["core", "part", "part_windows", "first", "last", "place", "mark", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for r in batch.to_pylist():
                words, n = r["body"].split(), r["part_windows"]
                marks = hasher.groups(hasher.prefix(words), np.arange(n), window).view("i8")
                columns = [pa.array(np.full(n, r[k]), pa.int64()) for k in names[:5]]
                bodies = pa.array([b" ".join(words[i:i + window]) for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n)), pa.array(marks), bodies], names=names)

    return runs.select(*names[:5], "body").mapInArrow(run, ", ".join(f"{n} long" for n in names[:7]) + ", body binary")


def _told(one: DataFrame, window: int, shard_words: int, hot_segments: int) -> DataFrame:
    """core, part, part_windows, from, to, least of distinct runs.

    Cores that still have many runs are cut to single windows, which are dealt by their own hash: equal windows meet,
    and no shard has to hold a whole core.
    """
    one = settle(_crowded(one, hot_segments, "part"), "runs")
    names, back = {"part": "content", "part_windows": "windows"}, {"content": "part", "windows": "part_windows"}
    told = _searched(one.where(~F.col("hot")).withColumnsRenamed(names), window, shard_words).withColumnsRenamed(back)
    many = one.where("hot")
    if many.isEmpty():
        return told
    each = settle(_windows(many, window), "windows")
    alone = each.groupBy("core", "mark").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("body").alias("body"))
    pieces = alone.withColumnsRenamed({"core": "content", "mark": "core"}).withColumn("windows", F.lit(1).cast("long"))
    found = _searched(pieces, window, shard_words).select(
        F.col("content").alias("core"), F.col("core").alias("mark"), "least")
    return told.unionByName(each.drop("body").join(found, ["core", "mark"]).select(
        "core", "part", "part_windows", F.col("place").alias("from"), (F.col("place") + 1).alias("to"), "least"))


def _searched(pieces: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Runs of windows and the smallest document that has them: core, content, windows, from, to, least.

    pieces: core, content, windows, first, last, body. All pieces of a core meet in one shard, `hot_segments` at most;
    a shard's index is searched by all its pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        words = 0
        for batch in batches:
            for row in batch.to_pylist():
                if words >= shard_words and held[-1]["core"] != row["core"]:
                    yield shard(held)
                    held, words = [], 0
                held.append(row)
                words += row["windows"] + window
        if held:
            yield shard(held)

    def shard(rows: list[dict]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        pieces = [np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in r["body"].split()), "i8") for r in rows]
        index = ShardIndex(pieces, np.array([r["first"] for r in rows], "i8"), window)
        out = []
        for r, least in zip(rows, index.least_documents(pieces)):
            cuts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
            for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(least)].tolist()):
                if least[a] < r["last"]:
                    out.append((r["core"], r["content"], r["windows"], a, b, int(least[a])))
        names = ["core", "content", "windows", "from", "to", "least"]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(6)], names=names)

    columns = ["core", "content", "windows", "first", "last", "body"]
    return pieces.select(*columns).repartition("core").sortWithinPartitions("core").mapInArrow(
        run, "core long, content long, windows long, from long, to long, least long")


def repeated_words(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS,
    hot_segments: int = HOT_SEGMENTS,
) -> DataFrame:
    """doc (null ids as the largest number), version, intervals: word ranges of each text that are to go.

    An interval covers windows whose words also start in a document with a smaller key.
    """
    texts = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("version"),
        F.col(text).cast("binary").alias("text"))
    repeated = settle(_cores(texts, window), "cores")
    found = _segments(texts, _bits_of(repeated), window)
    found = settle(found.join(repeated, "core"), "segments")
    keys = ["core", "content", "windows"]
    distinct = found.groupBy(*keys).agg(F.min(F.struct("doc", "version", "start")).alias("at"), F.max("doc").alias("last"))
    distinct = settle(distinct.select(*keys, "at.doc", "at.version", "at.start", "last"), "distinct")
    wanted = _crowded(distinct, hot_segments, "content")
    bodies = settle(_bodies(texts, wanted, window), "bodies")
    answers = _searched(bodies.where(F.col("marks").isNull()), window, shard_words)
    many = bodies.where(F.col("marks").isNotNull())
    if not many.isEmpty():
        parts = settle(_trim(many, window), "parts")
        one = parts.groupBy("core", "part", "part_windows").agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.min("body").alias("body"))
        told = _told(one, window, shard_words, hot_segments)
        answers = answers.unionByName(parts.select(*keys, "place", "part", "part_windows").join(
            told, ["core", "part", "part_windows"]).select(
            *keys, (F.col("from") + F.col("place")).alias("from"), (F.col("to") + F.col("place")).alias("to"), "least"))
    answers = settle(answers, "answers")
    gone = found.join(answers, keys).where(F.col("least") < F.col("doc")).select(
        "doc", "version", F.struct((F.col("start") + F.col("from")).alias("a"), (F.col("start") + F.col("to") + window - 1).alias("b")).alias("i"))
    return gone.groupBy("doc", "version").agg(F.collect_list("i").alias("intervals"))


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **options: int
) -> DataFrame:
    """One row per row of docs: key, n_words, n_removed, kept (the words that stay, joined by one space).

    Words end at ASCII white space and count as they are. A word goes if a window of `window` words that covers it
    also starts in a document with a smaller key; all windows are judged on the input. A null or empty text has no
    words; a text shorter than a window keeps all. A null key is larger than all others; rows that share a key are
    parts of one document, so they take nothing from each other. An empty table gives an empty one; other columns are
    not read. Words are compared as they are within a shard; copies of a whole segment are told by 128 bits of hashes.
    """
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), F.xxhash64(text).alias("version"),
                        F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"))
    joined = texts.join(repeated_words(docs, key, text, window, **options), ["doc", "version"], "left").select("key", "text", "intervals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text_, intervals in zip(batch.column(1), batch.column(2).to_pylist()):
                words = (text_.as_py() or b"").split()
                stay = np.ones(len(words), bool)
                for i in intervals or []:
                    stay[i["a"]:i["b"]] = False
                total.append(len(words))
                removed.append(int(len(words) - stay.sum()))
                kept.append(b" ".join(words if not intervals else [words[i] for i in np.flatnonzero(stay)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["key", "n_words", "n_removed", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"key {kind}, n_words long, n_removed long, kept binary").select(
        F.col("key").alias(key), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))

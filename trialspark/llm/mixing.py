"""Mixing sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of sources form a pattern; only the
patterns' token totals meet the flow problem: from each pattern, first reading tokens once, then again at a
rising (convex) cost, to the quotas of its sources. The flow tells how many tokens of each pattern the mix
takes; whole rounds take every document, and the rest is filled with documents in a seeded order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from trialspark.llm.common import settle
from trialspark.operators.selection import CUT, cut_points

MAX_REPEATS = 3
SEED = 20_240_601
DIGIT_BITS = 12  # documents are dealt to 2^12 parts of the seeded order, twice, before any are sorted
BROADCAST_PATTERNS = 10_000  # tables of so many rows are broadcast; longer ones are joined as they are
MAX_PATTERNS = 200_000  # patterns and sources come to the driver; more are refused
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_shares(sizes: Mapping[str | None, int], weights: Mapping[str | None, float], cap: float) -> dict[str | None, float]:
    """Shares of the total size by weight; none exceeds cap times its size, the excess goes to the others by weight."""
    target = dict.fromkeys(sizes, 0.0)
    open_, left = set(sizes), float(sum(sizes.values()))
    while open_ and left > 0:
        whole = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / whole > cap * sizes[s]]
        if not full:
            for s in open_:
                target[s] = left * weights[s] / whole
            break
        for s in full:
            target[s] = float(cap * sizes[s])
            open_.discard(s)
        left = float(sum(sizes.values())) - sum(target[s] for s in sizes if s not in open_)
    return target


def bounded(table: DataFrame, most: int, what: str) -> list[Row]:
    """All rows of a table that has `most` rows at most; one row more is an error, not a reason to cut."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}; they meet on the driver")
    return rows


def route(tokens: list[int], members: list[list[int]], quotas: list[int], repeats: int) -> list[list[int]]:
    """Tokens that each pattern gives to each of its sources: a cheapest flow that fills the quotas as far as can be.

    Patterns that share no source, directly or over others, do not compete, so every such group has a flow of its own;
    a pattern alone with one source gives what the source asks for and the pattern has.
    """
    group = list(range(len(tokens)))

    def top(p: int) -> int:
        while group[p] != p:
            group[p] = group[group[p]]
            p = group[p]
        return p

    holder: dict[int, int] = {}
    for p, sources in enumerate(members):
        for s in sources:
            group[top(p)] = top(holder.setdefault(s, p))
    groups: dict[int, list[int]] = {}
    for p in range(len(tokens)):
        groups.setdefault(top(p), []).append(p)
    given: list[list[int]] = [[] for _ in tokens]
    for patterns in groups.values():
        if len(patterns) == 1 and len(members[patterns[0]]) == 1:
            p = patterns[0]
            given[p] = [min(tokens[p] * repeats, quotas[members[p][0]])]
            continue
        sources = sorted({s for p in patterns for s in members[p]})
        at = {s: i for i, s in enumerate(sources)}
        flow = cheapest_flow([tokens[p] for p in patterns], [[at[s] for s in members[p]] for p in patterns], [quotas[s] for s in sources], repeats)
        for p, out in zip(patterns, flow):
            given[p] = out
    return given


def cheapest_flow(tokens: list[int], members: list[list[int]], quotas: list[int], repeats: int) -> list[list[int]]:
    """The flow of one group of patterns. The n-th reading of a pattern costs n - 1 a token.

    Successive cheapest paths; every path fills an edge.
    """
    start, end, first_source = 0, 1, 2 + len(tokens)
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(first_source + len(quotas))]

    def edge(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    given: list[list[int]] = []
    for p, n in enumerate(tokens):
        for again in range(repeats):
            edge(start, 2 + p, n, again)
        given.append([edge(2 + p, first_source + s, n * repeats, 0) for s in members[p]])
    for s, quota in enumerate(quotas):
        edge(first_source + s, end, quota, 0)
    while True:
        far: dict[int, int] = {start: 0}
        came: dict[int, int] = {}
        queue, waiting = deque([start]), {start}
        while queue:
            x = queue.popleft()
            waiting.discard(x)
            for e in out[x]:
                if room[e] > 0 and far[x] + cost[e] < far.get(to[e], 1 << 60):
                    far[to[e]], came[to[e]] = far[x] + cost[e], e
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if end not in far:
            return [[room[e + 1] for e in edges] for edges in given]
        path, x = [], end
        while x != start:
            path.append(came[x])
            x = to[came[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount


def _extra(rows: DataFrame, budget: DataFrame, order: list[str], few: bool) -> DataFrame:
    """rows with `extra`: 1 for documents that fill their pattern's `rest` in the seeded order `spot`.

    Documents are first summed by leading bits of `spot`; only the part in which the rest runs out is cut again,
    and only the last small part is sorted, so that no pattern meets in one task. `few` tells that the tables of
    one row per pattern are known to be small; then they are sent to the documents and a pattern's documents stay apart.
    """
    sent = F.broadcast if few else (lambda df: df)
    done: list[DataFrame] = []
    open_ = rows.join(sent(budget.select("pattern", "rest")), "pattern")
    for level in (1, 2):
        part = F.shiftrightunsigned("spot", 64 - DIGIT_BITS * level).bitwiseAND((1 << DIGIT_BITS) - 1)
        open_ = open_.withColumn("part", part)
        sums = open_.groupBy("pattern", "part").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        run = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        last = (
            sums.withColumn("upto", F.sum("n").over(run)).where(F.col("upto") > F.col("rest"))
            .groupBy("pattern").agg(F.min(F.struct("part", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))).alias("cut"))
            .select("pattern", F.col("cut.part").alias("cut"), F.col("cut.rest").alias("cut_rest"))
        )
        open_ = open_.join(sent(last), "pattern", "left")  # no cut: the rest takes in the whole pattern
        inside = F.col("part") == F.col("cut")
        done.append(open_.where(~F.coalesce(inside, F.lit(False))).select(
            *rows.columns, F.coalesce(F.col("part") < F.col("cut"), F.lit(True)).cast("int").alias("extra")))
        open_ = open_.where(inside).select(*rows.columns, F.col("cut_rest").alias("rest"))
    run = Window.partitionBy("pattern").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fits = 2 * F.sum("size").over(run) - F.col("size") <= 2 * F.col("rest")
    done.append(open_.withColumn("extra", fits.cast("int")).select(*rows.columns, "extra"))
    return done[0].unionByName(done[1]).unionByName(done[2])


def pattern_of(sources: Column) -> Column:
    """Set of sources as one text: sorted, without repeats; null is a source."""
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def mix(
    rows: DataFrame, quotas: Mapping[str | None, float], key: str = "doc_id", repeats: int = MAX_REPEATS, seed: int = SEED
) -> DataFrame:
    """rows (key, version, sources, size) with `taken`, the times each document is read, 0 to repeats.

    sources is an array of source names. The patterns and their token totals come to the driver, one row for each
    set of sources that occurs and MAX_PATTERNS at most, beyond which this raises; documents never do. An empty array is in no quota and never taken.
    """
    import json

    rows = rows.withColumn("pattern", pattern_of(F.col("sources"))).withColumn(
        "spot", F.xxhash64(F.lit(seed), F.col(key), F.col("version")))
    sums = {r["pattern"]: r["n"] for r in bounded(rows.groupBy("pattern").agg(F.sum("size").alias("n")), MAX_PATTERNS, "patterns")}
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(names)}
    patterns = sorted(sums)
    members = [[index[s] for s in json.loads(p) if s in index] for p in patterns]
    flow = route([sums[p] for p in patterns], members, [round(quotas[s]) for s in names], repeats)
    budget = []
    for pattern, given in zip(patterns, flow):
        whole = sums[pattern]
        rounds, rest = divmod(sum(given), whole) if whole else (0, 0)
        budget.append((pattern, min(rounds, repeats), rest if rounds < repeats else 0))
    spark = rows.sparkSession
    budget_ = spark.createDataFrame(budget, "pattern string, rounds int, rest long")
    few = len(budget) <= BROADCAST_PATTERNS
    rounds = budget_.select("pattern", "rounds")
    taken = _extra(rows, budget_, ["spot", key, "version"], few).join(F.broadcast(rounds) if few else rounds, "pattern")
    return taken.withColumn("taken", F.least(F.lit(repeats), F.col("rounds") + F.col("extra"))).drop(
        "extra", "rounds", "spot", "pattern")


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cycle: tuple[int, ...] = (1, 2, 3),
    repeats: int = MAX_REPEATS, seed: int = SEED,
) -> DataFrame:
    """Mix of documents with one source each: key, version, of (the source), size, source_size, target, repeats.

    version is xxhash64 of the text. More than MAX_PATTERNS sources are refused. Sources, in the order of their code points with null last, weigh the numbers of
    `cycle` in turn; their targets share all words, and none exceeds `repeats` times its source. A null or empty text
    has size 0 and is read as often as its source's rounds, which adds nothing. Null keys and repeated rows are
    documents like any other. An empty table gives an empty result; other columns are not read.
    """
    rows = settle(docs.select(
        F.col(key), F.xxhash64(text).alias("version"), F.col(source).cast("string").alias("source"),
        word_count(text).alias("size")), "sizes")
    sizes = {r["source"]: r["n"] for r in bounded(rows.groupBy("source").agg(F.sum("size").alias("n")), MAX_PATTERNS, "sources")}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = capped_shares(sizes, {s: cycle[i % len(cycle)] for i, s in enumerate(order)}, repeats)
    told = rows.sparkSession.createDataFrame(
        [(s, sizes[s], target[s]) for s in order], "name string, source_size long, target double")
    if len(order) <= BROADCAST_PATTERNS:
        told = F.broadcast(told)
    mixed = mix(rows.withColumn("sources", F.array("source")), target, key, repeats, seed)
    return mixed.join(told, F.col("source").eqNullSafe(F.col("name"))).select(
        key, "version", F.col("name").alias("of"), "size", "source_size", "target", F.col("taken").alias("repeats"))


def take_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options: int) -> DataFrame:
    """docs that the mix takes, with `repeats`, the times each is to be read; a column of that name is replaced.

    Of rows that are equal in key, text and source some may be read once more than the others, so that the mix takes
    no word more than planned.
    """
    docs = docs.drop("repeats")
    p = "__"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    alike = mix_sources(docs, key, text, source, **options).groupBy(
        F.col(key).alias(p + "key"), F.col("version").alias(p + "version"), F.col("of").alias(p + "of")).agg(
        F.min("repeats").alias(p + "low"), F.max("repeats").alias("repeats"),
        (F.sum("repeats") - F.min("repeats") * F.count("*")).cast("long").alias(p + "more"))
    alike = settle(alike.where("repeats > 0"), "mix")
    same = docs[key].eqNullSafe(alike[p + "key"]) & (F.xxhash64(docs[text]) == alike[p + "version"]) & (
        docs[source].cast("string").eqNullSafe(alike[p + "of"]))
    even = docs.join(alike.where(F.col(p + "more") == 0), same).select(*docs.columns, "repeats")
    odd = alike.where(F.col(p + "more") > 0)  # some of their rows are read once more
    if odd.isEmpty():
        return even
    split = settle(docs.join(odd, same).withColumn(p + "place", F.monotonically_increasing_id()).withColumn(
        p + "group", F.xxhash64(p + "key", p + "version", p + "of")), "alike")
    more = split.groupBy(p + "group").agg(F.max(p + "more").alias(p + "more"))
    cut = cut_points(split, [p + "group"], p + "place", more, p + "more", few=False).select(p + "group", CUT)
    told = split.join(cut, p + "group").withColumn(
        "repeats", (F.col(p + "low") + (F.col(p + "place") < F.col(CUT)).cast("int")).cast("int")).where("repeats > 0")
    return even.unionByName(told.select(even.columns))

"""SimHash groups, benchmark overlaps and repeated passages against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trialspark.llm import decontaminate as C, simhash as S, substring as B
from trialspark.llm.common import connected_components
from trialspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, score double, fp string, key string, root long"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 0.5, "x", "y", 3) for i, t in rows], KIND)


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, max_bits=3):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def texts(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "É x", "Ab", "aB"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    near = []
    for t in base[:15]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return [*base, *near, base[0], base[0], None, "", " \t\n", "one", "One", "x" * 50_000, " ".join(base) * 3]


def test_fingerprints_and_components(spark):
    rows = [(7 * i % 101, t) for i, t in enumerate(texts())]
    rows += [rows[3], (None, "null key"), (None, rows[5][1])]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"])
                 for r in S.simhash_components(docs_of(spark, rows)).collect())
    prints = [plain_print(t) for _, t in rows]
    roots = plain_components(prints)
    lowest = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            lowest[r] = min(lowest.get(r, i), i)
    want = sorted((i is None, i or 0, format(p, "016x"), lowest.get(r)) for (i, _), p, r in zip(rows, prints, roots))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("trie_rows", [20_000, 8])
def test_trie_join_finds_every_link(spark, trie_rows):
    """Clusters around few centres, with tries whole and cut."""
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(30):
            v = centre
            for _ in range(rng.randint(0, 7)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values) + [0, (1 << 64) - 1]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = S.near_links(prints, trie_rows=trie_rows)
    for r in links.collect():
        assert r["a"] != r["b"]
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    got = {}
    for v in signed:
        got.setdefault(roots.get(v, v), set()).add(v)
    want = {}
    for v, r in zip(signed, plain_components(values)):
        want.setdefault(r, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 800), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(chain).collect()}
    assert set(roots[i] for i in range(301)) == {0} and roots[900] == roots[800] == 800


def test_one_document_of_each_group_stays(spark):
    long_text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, long_text), (3, long_text), (3, long_text), (9, "quite another text here"), (None, "alone without key"),
            (None, "alone without key"), (None, long_text), (2, None), (4, "")]
    kept = S.keep_one(docs_of(spark, rows))
    assert kept.columns == KIND.replace(",", "").split()[::2]
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == sorted(
        [(3, long_text), (9, "quite another text here"), (-1, "alone without key"), (2, "")])


def test_one_row_of_each_component_stays(spark):
    """Against plain components, with keys that occur in several components and with null keys."""
    rng = random.Random(14)
    some = [t for t in texts() if t is None or len(t) < 5000]
    rows = [(rng.choice([None, *range(12)]), t) for t in some * 2]
    long_text = " ".join(f"word{i}" for i in range(200))
    rows += [(None, long_text), (None, long_text + " more"), (1, "a b c d"), (1, "quite another text here"), (1, "a b c d")]
    roots = plain_components([plain_print(t) for _, t in rows])
    kept = [(r["doc_id"], r["text"]) for r in S.keep_one(docs_of(spark, rows)).collect()]
    assert len(kept) == len(set(kept))
    by_row = {}
    for row, root in zip(rows, roots):
        by_row[row] = root
    assert sorted(by_row[r] for r in kept) == sorted(set(roots))
    lowest = {}
    for (i, _), root in zip(rows, roots):
        lowest[root] = min(lowest.get(root, 99), 99 if i is None else i)
    assert all(lowest[by_row[r]] == (99 if r[0] is None else r[0]) for r in kept)


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert S.simhash_components(none).count() == S.keep_one(none).count() == 0
    assert B.remove_repeats(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert C.find_contamination(none, items).count() == 0
    assert C.find_contamination(docs_of(spark, [(1, "a b c d e f")]), items).count() == 0


def some_words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(4)) for _ in range(n)]


def test_overlaps_with_substitutions(spark):
    rng = random.Random(2)
    item, other, short = some_words(rng, 40), some_words(rng, 40), some_words(rng, 7)
    filler = lambda n: some_words(rng, n, "qrstuvwx")
    swapped = list(item)
    for at in (4, 11, 18, 25, 32):
        swapped[at] = "other"
    gone = [w if i % 3 else "other" for i, w in enumerate(item)]
    part = item[10:23]
    rows = [
        (1, " ".join(filler(30) + item + filler(30))), (2, "; ".join(swapped).upper()), (3, " ".join(gone)),
        (4, " ".join(filler(5) + part + filler(5))), (5, " ".join(filler(9) + item[10:20] + filler(9))), (6, None), (7, ""),
        (8, " ".join(filler(3000) + other)), (9, " ".join(filler(3) + short + filler(3))), (None, " ".join(item)),
        (1, " ".join(filler(30))), (10, " ".join(short[:6])), (2, "; ".join(swapped).upper()),
    ]
    bench = spark.createDataFrame(
        [(1, " ".join(item)), (1, " ".join(item)), (2, " ".join(other)), (3, " ".join(short)), (4, None), (5, "a b"), (None, "x")],
        "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in C.find_contamination(docs_of(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 1), (8, 2), (9, 3), (None, 1)}
    assert (got[1, 1]["overlap_words"], got[1, 1]["doc_start"]) == (40, 30)
    assert (got[2, 1]["overlap_words"], got[2, 1]["equal_words"]) == (40, 35)
    assert (got[4, 1]["overlap_words"], got[4, 1]["item_start"]) == (13, 10)
    left = C.remove_contaminated(docs_of(spark, rows), bench)
    assert sorted((r["doc_id"], (r["text"] or "")[:5]) for r in left.collect()) == sorted(
        (i, (t or "")[:5]) for i, t in [rows[10], rows[2], rows[4], rows[5], rows[6], rows[11]])


def test_masks_reach_two_substitutions_in_thirteen_words():
    import itertools

    for gone in itertools.combinations(range(C.MIN_OVERLAP), 2):
        assert any(
            all(m != "1" or at + i not in gone for i, m in enumerate(mask))
            for mask in C.MASKS for at in range(C.MIN_OVERLAP - len(mask) + 1))


def accepted_patterns(n):
    """All ways to substitute as many words of n as the rule allows, the first and last included."""
    import itertools

    allowed = n - -(-4 * n // 5)
    return [[i not in gone for i in range(n)] for gone in itertools.combinations(range(n), allowed)]


@pytest.mark.parametrize("n", range(1, 21))
def test_masks_reach_every_accepted_pattern(n):
    masks = C._masks_for([n])
    assert len(masks) <= len(C.MASKS) + 6
    for equal in accepted_patterns(n):
        assert any(
            all(m == "0" or equal[at + i] for i, m in enumerate(mask))
            for mask in masks for at in range(n - len(mask) + 1))


def test_masks_reach_accepted_patterns_of_any_length():
    """The most equal words that n words can have without a hit, by dynamic programming, are under 80%."""
    size = 1 << max(map(len, C.MASKS))
    hit = np.any([(np.arange(size) & int(m, 2)) == int(m, 2) for m in C.MASKS], axis=0)
    most = np.full(size, -10**6)
    most[1] = 1
    for n in range(2, 401):
        after = np.full(size, -10**6)
        for bit in (0, 1):
            to = (np.arange(size) << 1 | bit) & (size - 1)
            np.maximum.at(after, to[~hit[to]], most[~hit[to]] + bit)
        most = after
        assert n < 11 or 5 * most[1::2].max() < 4 * n


def plain_overlap(words, item, least=13):
    """Words of the longest overlap over all offsets and all stretches; 0 if there is none."""
    best = 0
    for shift in range(-len(item) + 1, len(words)):
        at = [(j, words[shift + j] == item[j]) for j in range(len(item)) if 0 <= shift + j < len(words)]
        if len(at) == len(item) and 5 * sum(e for _, e in at) >= 4 * len(item):
            best = max(best, len(item))
        if len(item) > least:
            for a in range(len(at)):
                equal = 0
                for b in range(a, len(at)):
                    equal += at[b][1]
                    if at[a][1] and at[b][1] and b - a + 1 >= least and 5 * equal >= 4 * (b - a + 1):
                        best = max(best, b - a + 1)
    return best


def test_substitutions_in_items_of_every_short_length(spark):
    """Every way to change words that 80% allows, the first and last included; one more change is too many."""
    rng = random.Random(12)
    items = {n: some_words(rng, n) for n in (5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)}
    rows, want = [], {}
    for n, item in items.items():
        for equal in accepted_patterns(n)[:: 1 if n < 14 else 5]:
            for spoil in (0, 1):
                body = [w if e else "other" for w, e in zip(item, equal)]
                if spoil:
                    body[rng.choice([i for i, e in enumerate(equal) if e])] = "other"
                words = some_words(rng, 4, "qrstuvwx") + body + some_words(rng, 4, "qrstuvwx")
                size = plain_overlap(words, item)
                assert spoil or size == n
                if size:
                    want[len(rows), n] = size
                rows.append((len(rows), " ".join(words)))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["overlap_words"] for r in C.find_contamination(docs_of(spark, rows), bench).collect()}
    assert got == want


def test_overlap_is_told_whole(spark):
    """An item of 300 words of which the document has the ends verbatim and two of three words between."""
    rng = random.Random(8)
    item = some_words(rng, 300)
    words = [w if i < 100 or i >= 202 or i % 3 else "other" for i, w in enumerate(item)]
    rows = [(1, " ".join(some_words(rng, 50, "qrstuvwx") + words)), (2, " ".join(words[:150]))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r for r in C.find_contamination(docs_of(spark, rows), bench).collect()}
    assert (got[1]["overlap_words"], got[1]["equal_words"], got[1]["doc_start"], got[1]["item_start"]) == (300, 266, 50, 0)
    assert got[2]["overlap_words"] == plain_overlap(words[:150], item)


def test_items_of_few_words_match_verbatim_where_asked_for(spark):
    bench = spark.createDataFrame([(n, " ".join(f"w{n}{i}" for i in range(n))) for n in (1, 2, 4)], "item_id long, text string")
    rows = [(1, "x w10 y"), (2, "w20 w21"), (3, "a w40 w41 w42 w43 b"), (4, "w40 w41 w42 other"), (5, "w20")]
    assert C.find_contamination(docs_of(spark, rows), bench).count() == 0
    got = {(r["doc_id"], r["item_id"]) for r in C.find_contamination(docs_of(spark, rows), bench, min_words=1).collect()}
    assert got == {(1, 1), (2, 2), (3, 4)}


def test_longest_overlap_against_all_stretches():
    rng = random.Random(4)
    for _ in range(300):
        equal = np.array([rng.random() < 0.7 for _ in range(rng.randint(1, 40))])
        best = 0
        for a in range(len(equal)):
            for b in range(a + 1, len(equal) + 1):
                if equal[a] and equal[b - 1] and equal[a:b].mean() >= 0.8 - 1e-9:
                    best = max(best, b - a)
        found = C.longest_overlap(equal, 1)
        assert (found[1] - found[0] if found else 0) == best


def plain_repeats(rows, window):
    first = {}
    last = 1 << 63
    split = [(last if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - window + 1):
            k = tuple(w[j:j + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for (key, _), (i, w) in zip(rows, split):
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < i:
                gone.update(range(j, j + window))
        out.append((str(key), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"hot_segments": 1, "shard_words": 50}, {"hot_segments": 2}, {"hot_segments": 4}])
def test_repeated_passages(spark, monkeypatch, options):
    monkeypatch.setattr(B, "HOT_WINDOWS", options.get("hot_segments", 256))
    rng = random.Random(9)
    window = 13
    passage, line = some_words(rng, 40), some_words(rng, 5)
    rows = []
    for i in range(60):
        body = some_words(rng, rng.randint(0, 60), "mnop")
        if i % 2:
            a, b = sorted((rng.randint(0, 40), rng.randint(0, 40)))
            body[len(body) // 2:0] = passage[a:b]
        if i % 7 == 0:
            body = body + line * rng.randint(1, 9)
        rows.append(((i * 17) % 61, rng.choice([" ", "\n", "\t ", "  "]).join(body)))
    rows += [rows[5], (rows[5][0], " ".join(passage)), (None, " ".join(passage)), (None, None), (77, ""), (78, " ".join(passage * 40))]
    got = B.remove_repeats(docs_of(spark, rows), window=window, **options)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got.collect())
    assert got == plain_repeats(rows, window) and any(r[2] for r in got)


@pytest.mark.parametrize("limit", [1, 2, 29, 30, 2000])
def test_common_core_with_many_repeated_surroundings(spark, limit):
    """30 different passages hold one common line; each stands in two or three documents, in part or whole."""
    rng = random.Random(4)
    window, line = 20, some_words(rng, 12, "k")
    rows = []
    for p in range(30):
        passage = some_words(rng, 15, "abcdefgh") + line + some_words(rng, 15, "abcdefgh")
        for copy in range(2 + p % 2):
            a, b = rng.randint(0, 10), rng.randint(32, 42)
            rows.append((len(rows), " ".join(some_words(rng, 6, "xyz") + passage[a:b] + some_words(rng, 6, "xyz"))))
    rng.shuffle(rows)
    docs = docs_of(spark, rows)
    got = B.remove_repeats(docs, window=window, hot_segments=limit)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got.collect())
    assert got == plain_repeats(rows, window) and sum(r[2] > 0 for r in got) >= 30


def test_windows_of_a_crowded_core_are_dealt_apart(spark):
    rng = random.Random(5)
    line = [f"l{i}" for i in range(12)]
    bodies = [" ".join([f"a{i}", f"b{i}", *line, f"c{i}"]).encode() for i in range(50)]
    one = spark.createDataFrame([(9, i, 2, 0, 1, bytearray(b)) for i, b in enumerate(bodies)],
                                "core long, part long, part_windows long, first long, last long, body binary")
    crowded = B._crowded(one, 49, "part")
    assert crowded.where("hot").count() == 50 and B._crowded(one, 50, "part").where("hot").count() == 0
    each = B._windows(crowded, 14)
    assert each.count() == 100 and each.select("mark").distinct().count() == 100
    assert {bytes(r["body"]) for r in each.where("place = 1").collect()} == {b.split(b" ", 1)[1] for b in bodies}
    told = sorted(tuple(r) for r in B._told(one, 14, 100, 49).collect())
    assert told == sorted(tuple(r) for r in B._told(one, 14, 100, 50).select("core", "part", "part_windows", "from", "to", "least").withColumn(
        "from", F.explode(F.sequence("from", F.col("to") - 1))).withColumn("to", F.col("from") + 1).collect())
    assert len(told) == 100


def test_backward_search_against_counting():
    rng = random.Random(6)
    pieces = [np.array([rng.randint(1, 3) for _ in range(rng.randint(4, 30))]) for _ in range(25)]
    docs = np.array([rng.randint(1, 9) for _ in pieces])
    window = 4
    index = B.ShardIndex(pieces, docs, window)
    least = {}
    for p, d in zip(pieces, docs):
        for j in range(len(p) - window + 1):
            k = tuple(p[j:j + window])
            least[k] = min(least.get(k, 99), d)
    for p, found in zip(pieces, index.least_documents(pieces)):
        assert found.tolist() == [least[tuple(p[j:j + window])] for j in range(len(p) - window + 1)]


def test_digest_of_kept_words(spark):
    row = B.remove_repeats(docs_of(spark, [(1, " a\tb\n c ")])).first()
    assert hashlib.sha256(row["kept"].encode()).hexdigest() == hashlib.sha256(b"a b c").hexdigest()


def test_queries_over_a_whole_small_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    prints = [plain_print(t) for _, t in rows]
    roots = plain_components(prints)
    lowest = {}
    for (i, _), r in zip(rows, roots):
        lowest[r] = min(lowest.get(r, i), i)
    want = sorted((i, format(p, "016x"), lowest[r]) for (i, _), p, r in zip(rows, prints, roots))
    assert sorted(map(tuple, QUERIES["op7_simhash"](spark, folder).collect())) == want
    kept = {i: x for i, *x in ((int(r[0]), *r[1:]) for r in plain_repeats(rows, 50))}
    for r in QUERIES["op8_substring"](spark, folder).collect():
        n, gone, text = kept[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(text.encode()).hexdigest())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontamination"](spark, folder).collect()}
    assert found == {(i, j) for i, t in rows for j, b in items if b in (t or "")}

"""Phrases and spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter

import pytest

from trialspark.llm import phrases as P, spelling as S

KIND = "doc_id long, text string, lang string, word string, n long, phrase string, part long"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, "x", 1, "y", 2) for i, t, g in rows], KIND)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_phrases(rows, most, least, keep, percent=80):
    count, words = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low(text)):
            w = re.findall("[^ \t]+", piece)
            words[lang or "und"] += len(w)
            for k in range(1, most + 1):
                count.update((lang or "und", *w[i:i + k]) for i in range(len(w) - k + 1))
    often = {g: a for g, a in count.items() if a >= least}
    out = []
    for g, a in often.items():
        lang, w = g[0], g[1:]
        if len(w) < 2 or any(
                100 * b >= percent * a and len(h) > len(g) and h[0] == lang
                and any(h[i:i + len(w)] == w for i in range(1, len(h) - len(w) + 1)) for h, b in often.items()):
            continue
        score, _, l, r = min((2000000 * a // (often[lang, *w[:k]] + often[lang, *w[k:]]), k, often[lang, *w[:k]], often[lang, *w[k:]])
                             for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, words[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank = Counter()
    return [(x[0], rank[x[0]], *x[1:]) for x in out if not rank.update([x[0]]) and rank[x[0]] <= keep]


def phrase_rows(seed=3):
    rng = random.Random(seed)
    words = ["of", "Of", "the", "new", "york", "city", "É", "é", "a b", "x" * 3000, "b\x1cc"]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randint(0, 80)))
        rows.append((i, text, rng.choice(["en", "en", "de", None])))
    return rows + [rows[0], rows[0], (None, "new york city", "en"), (7, None, "en"), (8, "", None), (9, " ,\t. ", "zz")]


@pytest.mark.parametrize("chunk, hashes", [(40, 30), (1_000_000, 1_000_000)])
def test_phrases(spark, monkeypatch, chunk, hashes):
    monkeypatch.setattr(P, "GROUP_HASHES", hashes)
    rows = phrase_rows()
    got = sorted(tuple(r) for r in P.mine_collocations(docs_of(spark, rows), least=4, keep=25, chunk=chunk).collect())
    assert got == sorted(plain_phrases(rows, 4, 4, 25)) and len(got) > 40


def test_phrases_that_the_sample_missed(spark, monkeypatch):
    """An empty sample proposes nothing: every level is found by a further pass."""
    rows = phrase_rows(5)
    monkeypatch.setattr(P, "_proposed", lambda *_: P.np.zeros(1 << (P.FILTER_BITS - 3), "u1"))
    got = sorted(tuple(r) for r in P.mine_collocations(docs_of(spark, rows), least=4).collect())
    assert got == sorted(plain_phrases(rows, 4, 4, 2000))


def test_words_with_one_code_are_numbered_again(spark, monkeypatch):
    """By the first seed many words share a code."""
    from types import SimpleNamespace

    def weak(text, seed=0, digest=P.xxhash.xxh64_intdigest):
        if seed in (0, 1):  # the language's part
            return seed + 2
        return digest(text, seed) % 5 if seed == 2 else digest(text, seed)

    monkeypatch.setattr(P, "xxhash", SimpleNamespace(xxh64_intdigest=weak))
    rows = [(i, t, "en") for i, t, _ in phrase_rows(7)]
    got = sorted(tuple(r) for r in P.mine_collocations(docs_of(spark, rows), least=4).collect())
    assert got == sorted(plain_phrases(rows, 4, 4, 2000))


def test_phrases_of_a_full_filter(spark, monkeypatch):
    """A filter that says yes to all counts more, with the same result."""
    rows = phrase_rows(6)
    monkeypatch.setattr(P, "_proposed", lambda *_: P.np.full(1 << (P.FILTER_BITS - 3), 255, "u1"))
    got = sorted(tuple(r) for r in P.mine_collocations(docs_of(spark, rows), least=4).collect())
    assert got == sorted(plain_phrases(rows, 4, 4, 2000))


def test_phrases_of_empty_tables(spark):
    assert P.mine_collocations(docs_of(spark, [])).collect() == []
    assert P.mine_collocations(docs_of(spark, [(None, None, None)])).collect() == []


def test_first_rows_in_steps(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i * 7919 % 1000, f"p{i}") for i in range(1000)], "g string, v long, u string")
    got = {(r["g"], r["rank"]): r["u"] for r in P.first_rows(rows, "g", [P.F.desc("v"), P.F.asc("u")], "u", 20, 9).collect()}
    for g in "ab":
        best = sorted((-(i * 7919 % 1000), f"p{i}") for i in range(1000) if ("a" if i % 3 else "b") == g)[:20]
        assert [got[g, k + 1] for k in range(20)] == [u for _, u in best]
    assert len(got) == 40


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_forms(rows, damage=199):
    count = Counter()
    for key, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out)


@pytest.mark.parametrize("group_words, block_cells", [(2048, 1 << 17), (4, 200)])
def test_spelling_forms(spark, monkeypatch, group_words, block_cells):
    """Short alphabets make many neighbours; long words and chains of forms are among them."""
    monkeypatch.setattr(S.near_words, "__defaults__", (S.MIN_LETTERS, group_words, block_cells))
    rng = random.Random(11)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(120)] + ["q" * 700, "q" * 699, "q" * 698 + "r"]
    chain = ["ststst", "stststs", "ststsxs", "stutsxs"]
    bag = [w for w in base for _ in range(rng.choice([5, 6, 30, 200]))] + [w for w, n in zip(chain, (2000, 300, 40, 6)) for _ in range(n)]
    bag += [w[:3].upper() + w[3:] for w in base[:20] for _ in range(3)] + ["Àbcdefg", "àbcdefg", "abc×defgh", "short"] * 8
    rng.shuffle(bag)
    rows = [(i, " ".join(bag[i::40]) + rng.choice(["", ".", " 7"]), None) for i in range(40)]
    rows += [rows[0], rows[0], (None, " ".join(base), None), (3, None, None), (4, "", None)]
    got = sorted((tuple(r) for r in S.spelling_forms(docs_of(spark, rows), damage=13, group_words=group_words).collect()))
    assert got == plain_forms(rows, 13)
    assert any(r[1] != r[2] for r in got if r[1])


def test_spelling_of_empty_tables(spark):
    assert S.spelling_forms(docs_of(spark, [])).collect() == []
    assert S.spelling_forms(docs_of(spark, [(1, "seldom heard words", None)])).collect() == []


def test_phrase_whose_part_was_a_false_hit_before(spark):
    """The pass before hit `a b` and `b c` in its filter, but not the word `a`: it never came to count `a b c`."""
    a, b, c = (P.np.uint64(int.from_bytes(x * 8, "big")) for x in (b"\x11", b"\x55", b"\x99"))
    word = P.np.array([a, b, c, 0], "u8")
    ab, bc = P._longer(word[:1], word[1:2]), P._longer(word[1:2], word[2:3])

    def filter_of(*hashes):
        bits = P.np.zeros(1 << (P.FILTER_BITS - 3), "u1")
        for h in P.np.concatenate(hashes) >> P.np.uint64(64 - P.FILTER_BITS):
            bits[int(h) >> 3] |= 1 << (int(h) & 7)
        return P._Filter(bits)

    before = filter_of(word[1:3], ab, bc)
    now = filter_of(word[:3], ab, bc)
    seen = {k: list(at) for k, at, _ in P._levels(word, 3, before, None)}
    assert seen == {1: [0, 1, 2], 2: [1], 3: []}
    more = {k: list(at) for k, at, _ in P._levels(word, 3, now, before)}
    assert more[2] == [0] and more[3] == [0]

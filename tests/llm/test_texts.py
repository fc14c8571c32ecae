"""Toxicity, personal data, quality and mixing."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.llm import mixing as M, pii as P, quality as Q, toxicity as X
from trialspark.llm.queries import QUERIES

KIND = "doc_id long, text string, label int, features string, score double, stats string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 9, "f", 0.1, "s") for i, t in rows], KIND)


def distance(a, b):
    """Edits between words, a swap of neighbours counting as one."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    lexicon = ["abcab", "bcabca", "aabbccaab", "cab"]
    automaton = X.LexiconAutomaton(lexicon, ["ccc"], ["aab"])
    allowed = {w: 0 if len(w) < 5 else 1 if len(w) < 9 else 2 for w in lexicon}
    for _ in range(4000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        if rng.random() < 0.5:
            word = list(rng.choice(lexicon))
            for _ in range(rng.randint(0, 3)):
                word[rng.randrange(len(word))] = rng.choice(["", "a", "b", "c", "ab"])
            word = "".join(word)
        kind = automaton.match(word)
        if word in lexicon or word.startswith("ccc"):
            assert kind == "exact"
        elif word.startswith("aab"):
            assert kind == "form"
        elif len(word) >= 4:
            assert kind == ("misspelled" if any(distance(word, w) <= n for w, n in allowed.items() if n) else ""), word


def test_quotations_have_no_longest_length():
    pattern = re.compile(
        r'"[^"\n]+"|“[^”\n]+”|«[^»\n]+»|„[^“”\n]+[“”]|‘[^’\n]+’|(?<!\w)\'[^\'\n]+\'(?!\w)')
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("\"“”«»„‘’'\n ab") for _ in range(rng.randint(0, 40)))
        assert X.quotations(text) == [m.span() for m in pattern.finditer(text)]
    scan = X.Scanner(X.LexiconAutomaton(["idiot"], [])).features
    f = lambda text: dict(zip(X.FEATURES, scan(text)))
    filler = "plain " * 75
    for a, b in ('""', "“”", "«»", "„“", "‘’", "''"):
        assert f(f"{a}{filler}idiot {filler}{b} it read")["exact"] == 0
        aimed = f(f"{a}{filler}{b} you are an idiot {a}short{b}")
        assert aimed["exact"] > 0 and aimed["mentioned"] == 0


def test_quotation_is_told_from_abuse():
    scan = X.Scanner(X.LexiconAutomaton(X.BASE_TERMS, []))
    f = lambda t: dict(zip(X.FEATURES, scan.features(t)))
    assert f("you are an idiot")["exact"] > 0 and f("you are an idiot")["aimed"] > 0
    assert f('the word "idiot" is old')["exact"] == 0 and f('the word "idiot" is old')["mentioned"] > 0
    assert f("you are an id1ot")["misspelled"] > 0 and f("you idoit")["misspelled"] > 0
    assert f("what a wortless thing")["misspelled"] > 0 and not any(scan.features("a quiet evening"))
    assert not any(scan.features(None)) and not any(scan.features(""))


def toxic_corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    slurs = ["zgrok", "zgroka", "zgrokel"]
    rows, labels = [], []
    for i in range(500):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(slurs + ["moron"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_words_and_keeps_clean_texts(spark):
    rows, labels = toxic_corpus()
    rows += [(1000, None), (1001, ""), (None, "you moron"), (1002, "you are a mroon and a moron " * 3), (1003, "plain " * 5000), rows[0]]
    known = spark.createDataFrame([*labels, (7, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    got = X.score_toxicity(docs_of(spark, rows), known, X.toxic_fold())
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == len(rows)
    by = {r["doc_id"]: r for r in got.collect()}
    wrong = sum(by[i]["predicted"] != y for i, y in labels)
    assert wrong <= 10
    assert by[1000]["score"] == by[1001]["score"] == by[1003]["score"] < 0.5 < by[1002]["score"]
    kept = X.drop_toxic(docs_of(spark, rows), known, X.toxic_fold())
    assert kept.columns == docs_of(spark, []).columns
    assert kept.count() == got.where("predicted = 0").count()


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = X.score_toxicity(docs_of(spark, [(1, "you idiot, you moron, you scum"), (2, "a calm day")]), none)
    assert {r["doc_id"]: r["predicted"] for r in got.collect()} == {1: 1, 2: 0}
    assert X.score_toxicity(docs_of(spark, []), none).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and P.card_sum(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(P.KINDS[k], a, b) for a, k, b in sorted(out)]


@pytest.fixture(scope="module")
def model():
    return P.train_pii(["the river runs past the old mill and on to the sea"] * 20)


def test_fixed_patterns_equal_plain_matching(model):
    rng = random.Random(11)
    for _ in range(6000):
        text = "".join(rng.choice("aB1234567890..@@+-() %\n_é") for _ in range(rng.randint(0, 60)))
        base, every = P.find_spans(text, model)
        assert base == plain_spans(text) and set(base) <= set(every)


def test_long_runs_take_little_time(model):
    for text in ("a" * 200_000, "1" * 20_000, "a@" * 50_000, "+1 " * 20_000, "1." * 30_000):
        P.base_spans(text)


def test_disguised_data_is_added_and_prose_left_alone(model):
    def added(text):
        base, every = P.find_spans(text, model)
        return [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base]

    assert added("write to john.doe [at] example [dot] com now") == [("email", "john.doe [at] example [dot] com")]
    assert added("call (017) 555-7713 today") == [("phone", "(017) 555-7713")]
    assert added("card 4111.1111.1111.1111 ok") == [("card", "4111.1111.1111.1111")]
    for text in ("he is at home", "version 3.0.1", "on 2024-05-12 12:33:11", "1,234.50 euros", "token = 04dbebab91ab85687d33eeaaf9ac699e"):
        assert not added(text)


def all_segmentations(model, region):
    """Scores of all segmentations, by listing them."""
    n = len(region.spans)

    def rest(at, before):
        if at == n:
            yield 0.0, ()
            return
        for start, kind, score, c in [(s, k, v, c) for j in range(at + 1, n + 1) for s, k, v, c in model._ends(region)[j] if s == at]:
            end = at + 1 if c < 0 else region.candidates[c][1]
            for tail, cs in rest(end, kind):
                yield model.step[before, kind] + score + tail, ((c,) if c >= 0 else ()) + cs

    return list(rest(0, 0))


def test_decoding_finds_the_best_segmentation(model):
    for text in ("a 12 34 56 78 90 b", "x 1.2.3.4 5", "(12) 345-6789 1"):
        region = P.Region(text, 0, len(text))
        score, cs = max(all_segmentations(model, region))
        want = [(P.KINDS[region.candidates[c][2]], region.spans[region.candidates[c][0]][0], region.spans[region.candidates[c][1] - 1][1]) for c in cs]
        assert model.decode(region) == want


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(1)
    model = P.SemiMarkov()
    model.weight += rng.normal(size=model.weight.shape)
    model.step += rng.normal(size=model.step.shape)
    text = "a 12 34 567 8901 b"
    region = P.Region(text, 0, len(text))
    i, j, k, names = region.candidates[-1]
    d_weight, d_step = model.gradient(region, {(i, j, k)})

    def likelihood():
        scores = all_segmentations(model, region)
        gold = next(s for s, cs in scores if [region.candidates[c][:3] for c in cs] == [(i, j, k)])
        return gold - np.log(sum(np.exp(s) for s, _ in scores))

    for table, slope, at in ((model.weight, d_weight, (k, names[0])), (model.step, d_step, (0, k + 1))):
        here = likelihood()
        table[at] += 1e-5
        assert (likelihood() - here) / 1e-5 == pytest.approx(slope[at], abs=1e-3)
        table[at] -= 1e-5


def test_spans_and_redaction_of_a_table(spark, model):
    rows = [(1, "é a.b@c.de, 10.0.0.1"), (2, None), (3, ""), (None, "+1 (017) 555-7713"), (1, "é a.b@c.de, 10.0.0.1"), (4, "x " * 60_000 + "9.9.9.9")]
    got = {(r["doc_id"], len(r["spans"])) for r in P.find_pii(docs_of(spark, rows), model=model).collect()}
    assert got == {(1, 2), (2, 0), (3, 0), (None, 1), (4, 1)}
    df = docs_of(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    clean = {(r["doc_id"], r["text"][-12:] if r["text"] else r["text"], r["n_chars"]) for r in P.redact_pii(df, model=model).collect()}
    assert (1, "[EMAIL], [IP]"[-12:], 15) in clean and (2, None, None) in clean and (3, "", 0) in clean and (None, "[PHONE]", 7) in clean
    assert P.find_pii(docs_of(spark, [])).count() == P.redact_pii(docs_of(spark, [])).count() == 0


def test_query_of_personal_data(spark):
    """The registered query over a whole small table."""
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op6_pii"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_spans(texts[r["doc_id"]] or "")
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s[0] == k for s in base) for k in P.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r["spans"].split(",")) | {""}


def test_rules_of_a_tree():
    described = """DecisionTreeClassificationModel: depth=2
  If (feature 1 <= 0.5)
   If (feature 0 <= 2.0)
    Predict: 0.0
   Else (feature 0 > 2.0)
    Predict: 1.0
  Else (feature 1 > 0.5)
   Predict: 1.0"""
    inf = float("inf")
    assert Q.tree_rules(described) == [
        ((1, -inf, 0.5),), ((0, -inf, 2.0), (1, -inf, 0.5)), ((0, 2.0, inf), (1, -inf, 0.5)), ((1, 0.5, inf),)]


def test_rule_scores_equal_the_rules_applied_by_hand(spark):
    ensemble = Q.RuleEnsemble([(((0, 1.0, 3.0),), 2.0), (((1, -float("inf"), 0.5), (0, 2.0, float("inf"))), -1.0)], 0.25)
    df = spark.createDataFrame([([2.0, 0.1],), ([4.0, 0.9],), ([3.0, 0.5],)], "stats array<double>")
    got = [r[0] for r in df.select(ensemble.score()).collect()]
    want = [1 / (1 + np.exp(-z)) for z in (0.25 + 2, 0.25, 0.25 + 2 - 1)]
    assert got == pytest.approx(want)


def test_quality_learns_shouting(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(4, 80))]
        good = i % 4 > 0
        rows.append((i, " ".join(words) if good else "!! ".join(words).upper()))
        labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (902, "a " * 60_000), (None, "null key"), rows[0]]
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    got = Q.score_quality(docs_of(spark, rows), known, Q.quality_fold())
    assert got.count() == len(rows)
    by = {r["doc_id"]: r for r in got.collect()}
    held = [(i, y) for i, y in labels if spark.sql(f"SELECT crc32(binary('{i}')) % 4 = 2").first()[0]]
    assert held and sum(by[i]["predicted"] != y for i, y in held) <= 2
    assert 0 <= by[900]["score"] <= 1 and by[900]["score"] == by[901]["score"]
    assert Q.score_quality(docs_of(spark, []), known).count() == 0
    assert Q.score_quality(docs_of(spark, [(1, "x")]), known.limit(0)).first()["score"] == 0.5


def test_shares_stop_at_the_cap():
    got = M.capped_shares({"a": 10, "b": 10, "c": 100}, {"a": 1, "b": 50, "c": 1}, 3)
    assert got["b"] == 30 and got["a"] == 30 and got["c"] == pytest.approx(60)
    assert sum(M.capped_shares({"a": 0, "b": 5}, {"a": 1, "b": 2}, 3).values()) == 5
    assert M.capped_shares({}, {}, 3) == {}


def cheapest(tokens, members, quotas, repeats):
    """Largest fill of the quotas and its lowest cost, by trying all token counts."""
    best = (0, 0)
    options = [(p, s) for p, m in enumerate(members) for s in m]

    def go(i, given, left):
        nonlocal best
        if i == len(options):
            fill = sum(quotas) - sum(left)
            cost = 0
            for p, n in enumerate(tokens):
                used = given[p]
                cost += sum(min(n, max(0, used - n * r)) * r for r in range(repeats))
            best = max(best, (fill, -cost))
            return
        p, s = options[i]
        for x in range(min(left[s], tokens[p] * repeats - given[p]) + 1):
            given[p] += x
            left[s] -= x
            go(i + 1, given, left)
            given[p] -= x
            left[s] += x

    go(0, [0] * len(tokens), list(quotas))
    return best


def test_flow_is_a_cheapest_one():
    rng = random.Random(12)
    for _ in range(25):
        tokens = [rng.randint(0, 3) for _ in range(3)]
        members = [[0], [1], [0, 1]]
        quotas = [rng.randint(0, 6), rng.randint(0, 6)]
        flow = M.route(tokens, members, quotas, 3)
        fill = sum(map(sum, flow))
        cost = sum(min(n, max(0, sum(f) - n * r)) * r for n, f in zip(tokens, flow) for r in range(3))
        assert (fill, -cost) == cheapest(tokens, members, quotas, 3)


def test_overlapping_sources_share_documents(spark):
    rows = spark.createDataFrame(
        [(i, 0, ["a"] if i < 20 else ["b", "a"] if i < 40 else ["b"] if i < 60 else [], 10) for i in range(70)],
        "doc_id long, version long, sources array<string>, size long")
    got = M.mix(rows, {"a": 400, "b": 200}).collect()
    assert len(got) == 70 and sum(r["taken"] * 10 for r in got) == 600
    assert all(r["taken"] == 0 for r in got if not r["sources"]) and max(r["taken"] for r in got) <= 2


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(900)]
    rows += [(5000, None, "a"), (5001, "", "d"), (None, "x y", "b"), rows[0], (6000, "z " * 3000, "c")]
    kind = "doc_id long, text string, source string, size long, target double, pattern string, rest int"
    df = spark.createDataFrame([(*r, 1, 2.0, "p", 3) for r in rows], kind)
    mixed = M.mix_sources(df).collect()
    again = M.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again)) and len(mixed) == len(rows)
    total = sum(r["size"] for r in mixed)
    order = ["a", "b", "c", "d", None]
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in order}
    want = M.capped_shares(sizes, dict(zip(order, (1, 2, 3, 1, 2))), 3)
    of = {i: x for i, _, x in rows}
    taken, largest = {}, {}
    for r in mixed:
        source = of[r["doc_id"]]
        assert r["target"] == pytest.approx(want[source]) and r["source_size"] == sizes[source]
        taken[source] = taken.get(source, 0) + r["repeats"] * r["size"]
        largest[source] = max(largest.get(source, 0), r["size"])
        assert 0 <= r["repeats"] <= 3
    assert sum(sizes.values()) == total
    for source, n in taken.items():
        assert abs(n - want[source]) <= largest[source] / 2 + 1
    kept = M.take_mix(df)
    assert kept.columns == [*df.columns, "repeats"] and kept.count() == sum(r["repeats"] > 0 for r in mixed)
    assert M.mix_sources(df.limit(0)).count() == M.take_mix(df.limit(0)).count() == 0


def test_equal_rows_do_not_exceed_the_mix(spark):
    """A third of the rows are equal; the words that are taken of them are those of the mix."""
    rows = [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(60)] + [(7, "same four words here", "a")] * 30
    df = spark.createDataFrame([(*r, 5, 1, "x") for r in rows], "doc_id long, text string, source string, repeats int, __low int, __place string")
    planned = sum(r["size"] * r["repeats"] for r in M.mix_sources(df).collect())
    alike = [r["repeats"] for r in M.mix_sources(df).collect() if r["doc_id"] == 7 and r["size"] == 4]
    kept = M.take_mix(df).collect()
    assert sum(len(r["text"].split()) * r["repeats"] for r in kept) == planned
    assert len(set(alike)) == 2 and sorted(r["repeats"] for r in kept if "same" in r["text"]) == sorted(x for x in alike if x)


def test_more_sources_than_the_driver_takes(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_PATTERNS", 3)
    rows = [(i, "a b", f"s{i}") for i in range(4)]
    with pytest.raises(ValueError, match="more than 3 sources"):
        M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert M.mix_sources(spark.createDataFrame(rows[:3], "doc_id long, text string, source string")).count() == 3


def test_many_sources_need_no_search():
    n = 50_000
    given = M.route([10] * n, [[i] for i in range(n)], [i % 40 for i in range(n)], 3)
    assert all(g == [min(30, i % 40)] for i, g in enumerate(given))


def test_misspelled_words_of_any_length_and_a_fresh_start(monkeypatch):
    long_word = "abcdefghij" * 6
    automaton = X.LexiconAutomaton([long_word, "rascal"], [])
    assert automaton.match(long_word[:30] + long_word[31:]) == "misspelled" and automaton.match(long_word[:-3]) == ""
    words = ["".join(random.Random(i).choices("rascalx", k=6)) for i in range(400)]
    told = [automaton.match(w) for w in words]
    monkeypatch.setattr(X, "KEPT_STEPS", 20)
    again = X.LexiconAutomaton([long_word, "rascal"], [])
    assert [again.match(w) for w in words] == told and "misspelled" in told and again.steps < 60


def test_seeded_order_does_not_depend_on_parts(spark):
    """The parts into which documents are dealt give the same choice as one sort."""
    df = spark.createDataFrame([(i, " ".join(["w"] * (i % 9 + 1)), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    rows = M.mix_sources(df).join(df, "doc_id").select(
        "doc_id", "size", "source", "repeats", "target", F.xxhash64(F.lit(M.SEED), "doc_id", "version").alias("spot")).collect()
    for source in "ab":
        mine = sorted((r for r in rows if r["source"] == source), key=lambda r: r["spot"] % (1 << 64))
        rest = round(mine[0]["target"]) % sum(r["size"] for r in mine)
        extra = [r["repeats"] - min(x["repeats"] for x in mine) for r in mine]
        upto, cut = 0, extra.index(0) if 0 in extra else len(extra)
        for r, e in zip(mine, extra):
            upto += r["size"]
            assert e == (2 * upto - r["size"] <= 2 * rest)
        assert all(extra[:cut]) and not any(extra[cut:])

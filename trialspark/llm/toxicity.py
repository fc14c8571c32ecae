"""Toxicity by a misspelling-tolerant lexicon with context windows.

A lexicon of abusive words and stems is read off labelled documents, on top of a short fixed list. It is kept
as a trie. Words are run through the intersection of that trie with Levenshtein automata: a state is a set of
(trie node, edits so far), states are made as they are met and kept, so that a word costs one look-up a letter.
The words around each hit decide whether the text mentions a term (in quotation marks, after a reporting word)
or uses it; hits of each kind become a few features, which a logistic model with signed weights turns into a
score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import columns_free_of, free_name, settle
from trialspark.llm.labelled import MAX_TRAIN, fold, training_rows

# Common English insults that need no evidence from labels.
BASE_TERMS = (
    "asshole", "bastard", "bitch", "clown", "cretin", "cunt", "degenerate", "disgusting", "dumbass", "fool",
    "idiot", "imbecile", "loser", "moron", "pathetic", "pig", "scum", "slut", "stupid", "trash", "vermin",
    "whore", "worthless",
)
# Words that report or discuss a term, and words that aim it at somebody.
MENTION = frozenset(
    "said says say called calls wrote writes word words term terms quote quoted quotes meaning means spelled "
    "define defined definition insult insults slur phrase dit mot terme wort begriff sagte palabra dijo".split()
)
AIMED = frozenset(
    "you your youre ur u he she they them these those this that his her their are is such tu vous te ton votre "
    "du dich dein ihr sie er eres es usted tú".split()
)
TOKEN = re.compile(r"[\w@$]+")
WORDLY = re.compile(r"\w")
MARK = re.compile("[\"“”«»„‘’'\n]")
CLOSING = {'"': '"', "“": "”", "«": "»", "„": "“”", "‘": "’", "'": "'"}  # marks that end what a mark begins
DIGIT_LETTERS = str.maketrans("013457@$", "oleastas")
WINDOW = 6  # words looked at on either side of a hit
MENTION_REACH = 3  # a reporting word stands at most so many words before the term
STEMS = range(3, 9)  # lengths of the stems that are counted
KEPT_WORDS = 500_000  # words a task remembers before it starts anew
KEPT_STEPS = 500_000  # transitions of the automaton that a task remembers before it starts anew
FEATURES = ("exact", "misspelled", "mentioned", "aimed", "density", "forms", "more_forms", "crowding")


class LexiconAutomaton:
    """Trie of words and stems, run together with Levenshtein automata (a swap of neighbours is one edit).

    Words of 5 to 8 letters allow one edit, longer ones two, shorter ones and stems none. Weak stems also begin
    harmless words; only several of their forms in one text tell something.
    """

    def __init__(
        self, words: Iterable[str], stems: Iterable[str], weak: Iterable[str] = (), exceptions: Iterable[str] = ()
    ):
        self.child: list[dict[str, int]] = [{}]
        self.edits: list[int] = [-1]  # edits allowed for the word that ends here
        self.stem: list[str] = [""]
        self.most: list[int] = [0]  # edits allowed for any word below
        self.exceptions = frozenset(exceptions)
        for word in words:
            self._add(word, 0 if len(word) < 5 else 1 if len(word) < 9 else 2, "")
        for word in weak:
            self._add(word, -1, "form")
        for word in stems:
            self._add(word, -1, "exact")
        self._start()

    def _start(self) -> None:
        """Forget all states but the first; they are made anew when a word asks for them."""
        self.states = {self._close({(0, 0, "")}): 0}
        self.members = list(self.states)
        self.moves: list[dict[str, int]] = [{}]
        self.steps = 0

    def _add(self, word: str, edits: int, stem: str) -> None:
        node = 0
        for letter in word:
            self.most[node] = max(self.most[node], edits)
            if letter not in self.child[node]:
                self.child[node][letter] = len(self.child)
                self.child.append({})
                self.edits.append(-1)
                self.stem.append("")
                self.most.append(0)
            node = self.child[node][letter]
        self.most[node] = max(self.most[node], edits)
        self.edits[node] = max(self.edits[node], edits)
        self.stem[node] = stem or self.stem[node]

    def _close(self, state: set[tuple[int, int, str]]) -> frozenset:
        """Adds letters left out (an edit without reading), and drops positions reached with fewer edits."""
        todo, best = sorted(state), {}
        while todo:
            node, used, due = todo.pop()
            if used > max(self.most[node], 0) or best.get((node, due), 99) <= used:
                continue
            best[node, due] = used
            if not due:
                todo += [(n, used + 1, "") for n in self.child[node].values() if used < self.most[n]]
        return frozenset((n, e, d) for (n, d), e in best.items())

    def _move(self, at: int, letter: str) -> int:
        after: set[tuple[int, int, str]] = set()
        for node, used, due in self.members[at]:
            if due:
                if letter == due:
                    after.add((node, used, ""))
                continue
            after.add((node, used + 1, ""))  # a letter too many
            for c, n in self.child[node].items():
                if c == letter:
                    after.add((n, used, ""))
                elif used < self.most[n]:
                    after.add((n, used + 1, ""))  # another letter
                    if letter in self.child[n]:
                        after.add((self.child[n][letter], used + 1, c))  # two letters swapped
        state = self._close(after)
        if state not in self.states:
            self.states[state] = len(self.members)
            self.members.append(state)
            self.moves.append({})
        self.moves[at][letter] = self.states[state]
        self.steps += 1
        return self.states[state]

    def match(self, word: str) -> str:
        """"exact", "form" (of a weak stem), "misspelled" or "" for a lower-cased word."""
        node, kind = 0, ""
        for letter in word:
            node = self.child[node].get(letter, -1)
            if node < 0:
                break
            if self.stem[node]:
                kind = self.stem[node]
                if kind == "exact":
                    return kind
        if node > 0 and self.edits[node] >= 0:
            return "exact"
        if kind:
            return kind
        if len(word) < 4 or word in self.exceptions:  # a word of 5 letters has 4 after its one edit
            return ""
        if self.steps > KEPT_STEPS:
            self._start()
        at = 0
        for letter in word:
            step = self.moves[at].get(letter)
            at = self._move(at, letter) if step is None else step
            if not self.members[at]:
                return ""
        hit = any(not due and used <= self.edits[n] for n, used, due in self.members[at] if self.edits[n] >= 0)
        return "misspelled" if hit else ""


def term_kind(automaton: LexiconAutomaton, word: str) -> str:
    """Match of a word as written, or with digits and signs read as the letters they look like."""
    kind = automaton.match(word)
    if not kind and not word.isalpha():
        plain = word.translate(DIGIT_LETTERS)
        if plain != word and not word.isdigit() and automaton.match(plain):
            return "misspelled"
    return kind


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans of quotations of any length, from left to right; a mark pairs with the next closing one on its line."""
    marks = [(m.start(), m.group()) for m in MARK.finditer(text)]
    ends, following = [], {}
    for at, mark in reversed(marks):
        if mark == "\n":
            following = {}
        ends.append(min((following[c] for c in CLOSING.get(mark, "") if c in following), default=-1))
        following[mark] = at
    out, free = [], 0
    for (at, mark), end in zip(marks, reversed(ends)):
        if at < free or end <= at + 1 or mark == "'" and (at and WORDLY.match(text, at - 1) or WORDLY.match(text, end + 1)):
            continue
        free = end + 1
        out.append((at, free))
    return out


class Scanner:
    """Context features of texts; remembers which words are no hits."""

    def __init__(self, automaton: LexiconAutomaton):
        self.automaton, self.clean, self.hits = automaton, set(), {}

    def features(self, text: str | None) -> tuple[float, ...]:
        low = (text or "").lower()
        words = TOKEN.findall(low)
        distinct = set(words)
        if len(self.hits) > KEPT_WORDS:
            self.hits = {}
        for word in distinct - self.clean:
            if word not in self.hits:
                kind = term_kind(self.automaton, word)
                if kind:
                    self.hits[word] = kind
                else:
                    self.clean.add(word)
        found = distinct & self.hits.keys()
        if len(self.clean) > KEPT_WORDS:
            self.clean = set()
        if not found:
            return (0.0,) * len(FEATURES)
        quoted = quotations(low)
        spans = [m.span() for m in TOKEN.finditer(low)]
        count: Counter[str] = Counter()
        forms: set[str] = set()
        at = 0
        for i, word in enumerate(words):
            if word not in found:
                continue
            while at < len(quoted) and quoted[at][1] <= spans[i][0]:
                at += 1
            inside = at < len(quoted) and quoted[at][0] <= spans[i][0]
            if inside or not MENTION.isdisjoint(words[max(0, i - MENTION_REACH):i]):
                count["mentioned"] += self.hits[word] != "form"
            elif self.hits[word] == "form":
                forms.add(word)
            else:
                count[self.hits[word]] += 1
                count["aimed"] += not AIMED.isdisjoint(words[max(0, i - WINDOW):i + WINDOW + 1])
        used = count["exact"] + count["misspelled"]
        return (
            *(math.log1p(count[k]) for k in FEATURES[:4]), min(1.0, 20 * used / len(words)),
            math.log1p(len(forms)), math.log1p(max(0, len(forms) - 1)), min(1.0, 20 * len(forms) / len(words)),
        )


def with_features(
    docs: DataFrame, key: list[str], text: str, automaton: LexiconAutomaton, name: str = "__features"
) -> DataFrame:
    """key columns and a column of features, an array of doubles, for every row."""
    frame = docs.select(*key, F.col(f"`{text}`").alias(name))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField(name, T.ArrayType(T.DoubleType()))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(automaton)
        for batch in batches:
            rows = [scanner.features(t.as_py()) for t in batch.column(len(key))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=names)

    return frame.mapInArrow(run, schema)


def _terms(text: str) -> set[str]:
    """Words (marked =) and stems (marked ^) of a text."""
    words = {w for w in TOKEN.findall(text.lower()) if w.isalpha()}
    return {"=" + w for w in words} | {"^" + w[:n] for w in words for n in STEMS if len(w) >= n}


def _term_counts(rows: DataFrame) -> DataFrame:
    """term, toxic, clean: in how many labelled texts each word or stem occurs, near copies counted once."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                words = (text.as_py() or "").lower().split()
                parts = zip(*(words[i:] for i in range(5))) if len(words) >= 5 else [words]
                out.append(min(xxhash.xxh64_intdigest(" ".join(p)) for p in parts) >> 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.int64()), batch.column("label"), batch.column("text")], names=["sketch", "label", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for text, label in zip(batch.column("text"), batch.column("label")):
                both[bool(label.as_py())].update(_terms(text.as_py() or ""))
            terms = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in both[::-1])],
                names=["term", "toxic", "clean"])

    one = rows.select("label", "text").mapInArrow(sketch, "sketch long, label int, text string")
    one = one.groupBy("sketch", "label").agg(F.min("text").alias("text"))
    counts = one.mapInArrow(count, "term string, toxic long, clean long")
    return counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _fullest(stem: str, begun: dict[str, int]) -> str:
    """The longest stem that stands in as many toxic texts as this one."""
    same = [s for s, n in begun.items() if n == begun[stem] and s.startswith(stem)]
    return max(same, key=len)


def mine_lexicon(
    rows: DataFrame, precision: float = 0.95, chance: float = 1e-8, lift: float = 3.0
) -> tuple[list[str], list[str], list[str], list[str]]:
    """Words, stems, weak stems, and clean words that look like misspellings, from labelled rows (label, text).

    A term enters if at least `precision` of its labelled texts are toxic, and if that many toxic texts
    would meet by chance with a probability under `chance`. The shortest such stem stands for the words it
    begins. A weak stem is one whose texts are toxic `lift` times as often as all texts, with as little chance. The collected lists are bounded by the bounded sample of rows.
    """
    share = rows.agg(F.avg("label")).first()[0] or 0.0
    if not 0 < share < 1:
        return sorted(BASE_TERMS), [], [], []
    least = max(3, math.ceil(math.log(chance) / math.log(share)))
    counts = settle(_term_counts(rows), "terms")
    part = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    usual_part = F.least(F.lit(lift * share), F.lit(precision))
    evident = F.col("toxic") * F.log(part / share) >= -math.log(chance)  # bound on a binomial tail
    found = counts.where((F.col("toxic") >= least) & ((part >= precision) | (part >= usual_part) & evident & F.startswith("term", F.lit("^"))))
    rows_ = found.select("term", "toxic", part.alias("part")).collect()
    terms = sorted(((r["term"], r["part"] >= precision) for r in rows_), key=lambda t: (t[0][0] == "=", len(t[0]), t))
    begun = {r["term"][1:]: r["toxic"] for r in rows_ if r["term"][0] == "^"}
    stems: set[str] = set()
    weak: set[str] = set()
    words = set(BASE_TERMS)
    for term, strong in terms:
        if term[0] == "^":
            if not any(term[1:].startswith(s) or s.startswith(term[1:]) and strong for s in stems):
                if strong:
                    stems.add(_fullest(term[1:], begun))
                elif not any(term[1:n + 1] in weak for n in STEMS):
                    weak.add(term[1:])
        elif strong:
            words.add(term[1:])
    automaton = LexiconAutomaton(words, stems, weak)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [t.as_py()[1:] for t in batch.column(0) if automaton.match(t.as_py()[1:]) == "misspelled"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["word"])

    usual = counts.where("startswith(term, '=') and clean > 0").select("term").mapInArrow(near, "word string")
    return sorted(words), sorted(stems), sorted(weak), sorted(r["word"] for r in usual.collect())


class ToxicityModel:
    """Lexicon automaton and weights of the context features; no weight is negative, so a mention lowers no score."""

    def __init__(self, automaton: LexiconAutomaton, weights: list[float], intercept: float):
        self.automaton, self.weights, self.intercept = automaton, weights, intercept

    def score(self, features: str = "__features") -> Column:
        total = F.lit(self.intercept)
        for i, weight in enumerate(self.weights):
            total = total + F.col(features)[i] * weight
        return 1 / (1 + F.exp(-total))


def fit_toxicity(rows: DataFrame, key: str = "doc_id") -> ToxicityModel:
    """Lexicon and weights from labelled rows (key, text, label).

    The lexicon for fitting weights is found on one half of the rows and the weights on the other, so that they
    allow for words that were not seen; the lexicon for scoring comes from all rows. Each toxic row also stands with its exact hits misspelled, and,
    as clean, with all hits mentioned: labels alone seldom show either.
    """
    half = F.pmod(F.xxhash64(F.col(key), F.lit("half")), F.lit(2)) == 0
    words, stems, weak, usual = mine_lexicon(rows)
    *lists, seen = mine_lexicon(rows.where(half))
    shapes = with_features(rows.where(~half), [key, "label"], "text", LexiconAutomaton(*lists, seen)).select("label", F.col("__features").alias("features"))
    shapes = settle(shapes, "features")
    f = [F.col("features")[i] for i in range(len(FEATURES))]
    zero = F.lit(0.0)
    toxic = shapes.where((F.col("label") == 1) & (f[0] > 0))
    shown = shapes.select("label", "features", F.lit(1.0).alias("weight")).unionByName(
        toxic.select("label", F.array(zero, f[0], *f[2:]).alias("features"), F.lit(0.3).alias("weight"))
    ).unionByName(
        toxic.select(F.lit(0).alias("label"), F.array(zero, zero, f[0], *[zero] * (len(f) - 3)).alias("features"), F.lit(0.3).alias("weight")))
    shown = shown.withColumn("x", array_to_vector("features")).withColumn("label", F.col("label").cast("double"))
    present = {r["label"] for r in shown.select("label").distinct().collect()}
    if present != {0.0, 1.0}:  # nothing to learn from: fixed weights on the fixed list
        return ToxicityModel(LexiconAutomaton(BASE_TERMS, []), [2.0, 1.5, 0.0, 0.5, 1.0, 0.0, 0.0, 0.0], -2.5)
    n = len(FEATURES)
    learner = LogisticRegression(
        featuresCol="x", labelCol="label", weightCol="weight", regParam=0.002, maxIter=60, standardization=False,
        lowerBoundsOnCoefficients=Matrices.dense(1, n, [0.0] * n),
    )
    fitted = learner.fit(shown)
    return ToxicityModel(LexiconAutomaton(words, stems, weak, usual), [float(w) for w in fitted.coefficients], float(fitted.intercept))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, held_out: Column | None = None, key: str = "doc_id", text: str = "text",
    label: str = "toxic", max_train: int = MAX_TRAIN, threshold: float = 0.5,
) -> DataFrame:
    """docs without the rows that score at least `threshold`; nothing is joined, the score travels with the row."""
    held_out = F.lit(False) if held_out is None else held_out
    rows = training_rows(columns_free_of(docs, key, text), labels, label, held_out, key, text, max_train)
    model = fit_toxicity(rows, key)
    names = [f"`{c}`" for c in docs.columns]
    features = free_name(docs, "__features")
    marked = with_features(docs, names, text, model.automaton, features)
    return marked.where(model.score(features) < threshold).select(*names)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, held_out: Column | None = None, key: str = "doc_id", text: str = "text",
    label: str = "toxic", max_train: int = MAX_TRAIN,
) -> DataFrame:
    """key, score (0 to 1), predicted (1 from a score of 0.5) for every row of docs.

    Labels of rows for which held_out is true are not read. A null or empty text has no hits and gets the
    score of such texts; long texts are read whole; repeated rows give repeated rows; an empty table gives
    an empty one; without labels of both kinds fixed weights on the fixed list are used.
    """
    held_out = F.lit(False) if held_out is None else held_out
    rows = training_rows(columns_free_of(docs, key, text), labels, label, held_out, key, text, max_train)
    model = fit_toxicity(rows, key)
    scored = with_features(columns_free_of(docs, key, text), [key], text, model.automaton)
    return scored.select(key, model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def toxic_fold(key: str = "doc_id") -> Column:
    return F.coalesce(fold(key, 5) == 0, F.lit(False))

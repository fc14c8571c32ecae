"""Quality by a sparse ensemble of rules over text statistics.

A forest of shallow trees over statistics is fitted to labelled documents; every path from a root to a node is a
conjunction of bounds, a rule. A logistic model with an absolute (lasso) penalty weighs the rules and drops most.
The kept rules become one Spark column expression over the statistics.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import columns_free_of, settle
from trialspark.llm.labelled import BUCKETS, MAX_TRAIN, fold

STATISTICS = (
    "chars", "words", "lines", "word_length", "upper", "digits", "punctuation", "signs", "non_ascii", "white",
    "distinct_words", "top_word", "repeated_lines", "repeated_triples", "words_per_line", "ended_words",
    "marked_words", "one_letter_words", "longest_word", "bars", "entropy",
)
TREES, DEPTH, LASSO = 30, 3, 0.002

_KIND = np.zeros(256, "i8")  # 1 upper, 2 digit, 3 punctuation, 4 other signs, 5 not ASCII, 6 white, 7 bar
for _chars, _code in ((string.ascii_uppercase, 1), (string.digits, 2), (".,;:!?'\"()-", 3), ("#$%&*+/<=>@[\\]^_`{}~", 4), (" \t\n\r\v\f", 6), ("|", 7)):
    _KIND[[ord(c) for c in _chars]] = _code
_KIND[128:] = 5

Rule = tuple[tuple[int, float, float], ...]  # (statistic, above, at most), all of them


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; a null or empty text has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_KIND[np.frombuffer(raw, "u1")], minlength=8) / len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    count = Counter(words)
    triples = set(zip(words, words[1:], words[2:]))
    lengths = np.fromiter(map(len, words), "i8", n)
    share = np.fromiter(count.values(), "f8", len(count)) / n
    last = Counter(w[-1] for w in words)
    ended = sum(last[c] for c in b".!?") / n
    marked = sum(last[c] for c in b"#$%&*!|") / n
    return [
        float(len(text or "")), float(n), float(len(lines)), float(lengths.mean()), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5],
        kinds[6], len(count) / n, float(share.max()), 1 - len(set(lines)) / len(lines), 1 - len(triples) / max(1, n - 2), n / len(lines),
        ended, marked, float((lengths == 1).mean()), float(lengths.max()), kinds[7], float(-(share * np.log(share)).sum()),
    ]


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and `stats`, an array of doubles in the order of STATISTICS, for every row."""
    frame = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([frame.schema["key"], T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[float(x) for x in statistics(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["key", "stats"])

    return frame.mapInArrow(run, schema).withColumnRenamed("key", key)


_NODE = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+|Infinity|-Infinity)\)")


def tree_rules(described: str) -> list[Rule]:
    """Rules of all nodes below the root of a tree, read off its printed form; bounds on one statistic are joined."""
    rules, path = [], []
    for line in described.splitlines():
        found = _NODE.match(line)
        if not found:
            continue
        depth = len(found[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, int(found[2]), found[3], float(found[4])))
        bounds: dict[int, tuple[float, float]] = {}
        for _, feature, side, value in path:
            low, high = bounds.get(feature, (-np.inf, np.inf))
            bounds[feature] = (low, min(high, value)) if side == "<=" else (max(low, value), high)
        rules.append(tuple((f, float(a), float(b)) for f, (a, b) in sorted(bounds.items())))
    return rules


def rule_column(rule: Rule, stats: str = "stats") -> Column:
    """The rule as 1.0 or 0.0."""
    holds = F.lit(True)
    for feature, above, most in rule:
        value = F.col(stats)[feature]
        if above > -np.inf:
            holds = holds & (value > above)
        if most < np.inf:
            holds = holds & (value <= most)
    return holds.cast("double")


class RuleEnsemble:
    """Weighted rules and an intercept."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self, stats: str = "stats") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + rule_column(rule, stats) * weight
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[tuple[float, str]]:
        def text(rule: Rule) -> str:
            return " and ".join(
                f"{STATISTICS[f]} > {a:g}" * (a > -np.inf) + " and " * (a > -np.inf and b < np.inf) + f"{STATISTICS[f]} <= {b:g}" * (b < np.inf)
                for f, a, b in rule)

        return sorted(((w, text(r)) for r, w in self.rules), key=lambda x: -abs(x[0]))


def fit_rules(
    rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 11
) -> RuleEnsemble:
    """Rules and weights from labelled rows (stats, label); with one kind of label only, a constant score."""
    shown = settle(rows.select(F.col("label").cast("double").alias("label"), array_to_vector("stats").alias("x"), "stats"), "shown")
    known = {r["label"]: r["n"] for r in shown.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(known) < 2:
        return RuleEnsemble([], {0.0: -3.0, 1.0: 3.0}.get(next(iter(known), -1.0), 0.0))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.7,
        minInstancesPerNode=5, seed=seed).fit(shown)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString)})
    if not rules:
        return RuleEnsemble([], float(np.log(known[1.0] / known[0.0])))
    coded = settle(shown.select("label", array_to_vector(F.array(*[rule_column(r) for r in rules])).alias("z")), "rules")
    weights = LogisticRegression(featuresCol="z", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=100).fit(coded)
    kept = [(r, float(w)) for r, w in zip(rules, weights.coefficients) if abs(w) > 1e-6]
    return RuleEnsemble(kept, float(weights.intercept))


def score_quality(
    docs: DataFrame, labels: DataFrame, held_out: Column | None = None, key: str = "doc_id", text: str = "text",
    label: str = "quality", max_train: int = MAX_TRAIN, threshold: float = 0.7,
) -> DataFrame:
    """key, score (0 to 1), predicted (1 from `threshold`) for every row of docs.

    Labels of rows for which held_out is true are not read; a key labelled more than once counts as 1 if any of its
    labels is. About max_train labelled rows, sampled by a hash of the key, fit the model; the statistics are
    made once for all rows. A null or empty text has statistics of zero; repeated rows give repeated rows; an
    empty table gives an empty one; null labels are left out.
    """
    held_out = F.lit(False) if held_out is None else held_out
    stats = settle(with_statistics(columns_free_of(docs, key, text), key, text), "stats")
    known = settle(
        labels.select(F.col(key), F.col(label).cast("int").alias("label"))
        .where(F.col(key).isNotNull() & F.col("label").isNotNull() & ~F.coalesce(held_out, F.lit(False)))
        .groupBy(key).agg(F.max("label").alias("label")), "labels")
    share = min(1.0, max_train / max(1, known.count()))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(key), F.lit(BUCKETS)) < int(share * BUCKETS))
    model = fit_rules(stats.join(F.broadcast(known), key).select("stats", "label"))
    return stats.select(key, model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_fold(key: str = "doc_id") -> Column:
    return F.coalesce(fold(key, 4) == 2, F.lit(False))

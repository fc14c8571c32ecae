"""Dropout model training with Spark ML: candidates, grids, cross-validation, choice.

A search shares its fits. Grid points that differ only in the number of trees or rounds are prefixes of one ensemble,
so each fold fits the largest of them once, and running sums of the trees' outputs give the scores of all. Rows are
prepared once for each fold, with exact medians and modes of its training part. A fit of few rows is mostly waiting
for small jobs, so folds of small tables are fitted side by side; large tables are dealt to enough tasks instead.
Searches over more than sizes grow all their ensembles in one job (``growing``), as long as a task can hold the rows.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspark import schema as S
from trialspark.operators import growing, trees
from trialspark.operators.evaluate import grouped_metrics
from trialspark.operators.prep import fold_imputation_values, imputation_values
from trialspark.operators.reshape import union_all

# Search grids. An unlimited tree depth becomes 30, the deepest Spark allows.
FOREST_GRID = {
    "numTrees": [200, 400], "maxDepth": [4, 6, 30], "minInstancesPerNode": [5, 10],
}
FOREST_REGULAR_GRID = {
    "numTrees": [500], "featureSubsetStrategy": ["2", "5", "8"],
    "minInstancesPerNode": [5, 15, 25],
}
BOOST_GRID = {
    "maxIter": [200, 400], "maxDepth": [3, 5, 7], "stepSize": [0.05, 0.1],
    "subsamplingRate": [0.8, 1.0],
}
# Ranges of the space-filling boosting design (log10 for the last two). The least gain is not fixed: a gain
# is here the drop in variance of residuals, at most 1 for the first tree and less later, so its range ends at 0.01.
BOOST_RANGES = {
    "maxIter": (100, 500), "maxDepth": (3, 7), "stepSize": (-3, -1), "minInfoGain": (-6, -2),
}

FEATURES_COL, WEIGHT_COL = "features", "WEIGHT"
ROWS_A_TASK = 200_000  # a learner holds a row with a number for each tree, about 1 KB
BOOST_ROWS_A_TASK = 25_000  # boosting runs three jobs a round: on fewer rows the tasks are shorter than their start
SIDE_ROWS = 3_000_000  # rows that folds fitted side by side hold together
WHOLE_ROWS = 4_000_000  # rows that a task can hold in bins and grow trees on, about 100 bytes each
DEEP = 10  # deeper forests remember the node of each row, or every job would send all trees to the tasks


def space_filling_design(size: int = 15, seed: int = 42) -> list[dict]:
    """Latin hypercube over BOOST_RANGES: each range is cut into ``size`` strata, used once."""
    rng = np.random.default_rng(seed)
    columns = {}
    for name, (low, high) in BOOST_RANGES.items():
        position = (rng.permutation(size) + rng.random(size)) / size
        value = low + position * (high - low)
        if name in ("stepSize", "minInfoGain"):
            columns[name] = [float(10**v) for v in value]
        else:
            columns[name] = [int(round(v)) for v in value]
    return [{n: columns[n][i] for n in columns} for i in range(size)]


def grid_points(grid: Mapping[str, Sequence] | Sequence[Mapping]) -> list[dict]:
    """All combinations of a grid; a list of points is returned as it is."""
    if not isinstance(grid, Mapping):
        return [dict(p) for p in grid]
    return [dict(zip(grid, combo)) for combo in itertools.product(*grid.values())]


def with_balanced_weights(df: DataFrame, target: str = "DPTN") -> DataFrame:
    """Weight rows so that both classes carry the same total weight."""
    sizes = {r[target]: r["count"] for r in df.groupBy(target).count().collect()}
    total = sum(sizes.values())
    weight = F.lit(1.0)
    for value, n in sizes.items():
        weight = F.when(F.col(target) == value, total / (len(sizes) * n)).otherwise(weight)
    return df.withColumn(WEIGHT_COL, weight)


def preparation_stages(
    fills: Mapping[str, float | None],
    numeric: Sequence[str] = S.NUMERIC_FEATURES,
    categorical: Sequence[str] = S.CATEGORICAL_FEATURES,
    features: Sequence[str] = S.FEATURES,
) -> list:
    """Fill in the given values, then assemble. Trees need no scaling."""
    def filled(names):
        return [f"{n}__filled" for n in names]

    def text(value: float | None) -> str:
        return "CAST(NULL AS DOUBLE)" if value is None else f"CAST('{float(value)!r}' AS DOUBLE)"

    cells = ", ".join(
        f"coalesce(CAST(`{n}` AS DOUBLE), {text(fills.get(n))}) AS `{f}`"
        for n, f in zip([*numeric, *categorical], filled([*numeric, *categorical]))
    )
    return [
        SQLTransformer(statement=f"SELECT *, {cells} FROM __THIS__"),
        VectorAssembler(inputCols=filled(features), outputCol=FEATURES_COL),
    ]


def tasks_for(rows: int, cores: int, boosted: bool = False) -> int:
    """Tasks for the rows of a fit: one a core, or as many for each as ROWS_A_TASK demands; for boosting fewer if rows are few."""
    if boosted and rows < cores * BOOST_ROWS_A_TASK:
        return max(1, math.ceil(rows / BOOST_ROWS_A_TASK))
    return cores * max(1, math.ceil(rows / (cores * ROWS_A_TASK)))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where some task would hold more than ROWS_A_TASK; a small table stays as it is.

    Partitions of files may hold very different numbers of rows, so the largest is what counts.
    """
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]  # a row per partition
    if max(sizes, default=0) <= ROWS_A_TASK:
        return df
    return df.repartition(tasks_for(sum(sizes), df.sparkSession.sparkContext.defaultParallelism))


def fitted_stages(train: DataFrame) -> list:
    """Preparation with the exact medians and modes of the training rows."""
    found = imputation_values(train, S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES).collect()
    return preparation_stages({r["FEATURE"]: r["FILL"] for r in found})


def random_forest(target: str = "DPTN", seed: int = 42, weighted: bool = True, max_bins: int = 32):
    """Forest; numeric features are cut into at most ``max_bins`` bins at sampled quantiles."""
    forest = RandomForestClassifier(
        labelCol=target, featuresCol=FEATURES_COL, seed=seed, maxBins=max_bins
    )
    return forest.setWeightCol(WEIGHT_COL) if weighted else forest


def boosted_trees(target: str = "DPTN", seed: int = 42, max_bins: int = 32):
    """Boosted trees; numeric features are cut into at most ``max_bins`` bins at sampled quantiles."""
    return GBTClassifier(labelCol=target, featuresCol=FEATURES_COL, seed=seed, maxBins=max_bins)


@dataclass(frozen=True)
class Search:
    """Grid points with mean and spread of their metrics over the folds, and the best refitted on all rows."""

    points: list[dict]
    metrics: list[dict[str, float]]
    best: int
    bestModel: PipelineModel
    fits: int


def _sizes(points: Sequence[Mapping], size: str, default: int) -> list[tuple[dict, dict[int, int]]]:
    """Other settings, and for each the ensemble sizes wanted with the number of their point."""
    out: list[tuple[dict, dict[int, int]]] = []
    for i, point in enumerate(points):
        rest = {k: v for k, v in point.items() if k != size}
        for settings, sizes in out:
            if settings == rest and point.get(size, default) not in sizes:
                sizes[point.get(size, default)] = i
                break
        else:
            out.append((rest, {point.get(size, default): i}))
    return out


#: Settings that ``growing`` knows, with the names of its rules.
GROWN = {"maxDepth": "depth", "minInstancesPerNode": "least", "minInfoGain": "gain", "subsamplingRate": "rate"}


def _rules(classifier, point: Mapping, size: str) -> growing.Rules | None:
    """The rules of a point, or None if there are others among its settings or those of the classifier."""
    forest = size == "numTrees"
    more = {"featureSubsetStrategy": "features"} if forest else {"stepSize": "step"}
    names = {**GROWN, **more, size: "size"}
    asked = classifier.copy({classifier.getParam(n): v for n, v in point.items()})
    kept = {"minWeightFractionPerNode": 0.0, **({"bootstrap": True, "impurity": "gini"} if forest else {"featureSubsetStrategy": "all"})}
    if set(point) - set(names) or any(asked.getOrDefault(n) != v for n, v in kept.items()) or asked.getOrDefault("maxBins") > 256:
        return None
    if not forest and asked.getOrDefault("maxDepth") > DEEP:
        return None
    return growing.Rules(
        forest=forest, bins=asked.getOrDefault("maxBins"), seed=asked.getOrDefault("seed"),
        **{own: asked.getOrDefault(n) for n, own in names.items()})


def _grown_search(
    train: DataFrame, classifier, size: str, points: Sequence[Mapping], groups, rules: Sequence[growing.Rules], fills,
    weights: Sequence[float], rows: int, target: str, fold: str, folds: int, weighted: bool,
) -> tuple[list[dict], Callable[[Mapping], PipelineModel]]:
    """Metrics per fold and point, and the refit of a point, from ensembles that are grown in one job."""
    dealt = spread(train)
    cuts = growing.fold_cuts(train, S.FEATURES, fills, fold, min(rules[0].bins, rows), WEIGHT_COL if weighted else None)
    asked = [(r, sizes) for r, (_, sizes) in zip(rules, groups)]
    scored = growing.search_scores(dealt, S.FEATURES, target, fold, folds, fills, cuts, asked, weights)
    found = grouped_metrics(scored, ["K", "POINT"], "__y", "P").collect()  # a row per fold and point

    def refit(point: Mapping) -> PipelineModel:
        chosen = classifier.copy({classifier.getParam(n): v for n, v in point.items()})
        stages = Pipeline(stages=preparation_stages(fills[None])).fit(train.limit(0)).stages
        model = growing.refit(dealt, S.FEATURES, target, fold, fills, cuts, _rules(classifier, point, size), weights, chosen)
        return PipelineModel([*stages, model])

    return sorted((r.asDict() for r in found), key=lambda r: r["K"]), refit


def _search(
    train: DataFrame, classifier, size: str, points: Sequence[Mapping], target: str, fold: str, folds: int,
    parallelism: int, weighted: bool,
) -> Search:
    points = [dict(p) for p in points] or [{}]
    forest = size == "numTrees"
    groups = _sizes(points, size, classifier.getOrDefault(size))
    fills = fold_imputation_values(train, S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES, fold, folds)
    spark = train.sparkSession
    classes = train.groupBy(target).agg(
        F.count(F.lit(1)).alias("n"), F.max(WEIGHT_COL if weighted else F.lit(1.0)).alias("w")).collect()  # a row per class
    n, balance = sum(r["n"] for r in classes), {r[target]: r["w"] for r in classes}
    tasks = tasks_for(n, spark.sparkContext.defaultParallelism, not forest)

    def refit(point: Mapping) -> PipelineModel:
        chosen = classifier.copy({classifier.getParam(n): v for n, v in point.items()})
        return Pipeline(stages=[*preparation_stages(fills[None]), chosen]).fit(spread(train))

    def fold_metrics(k: int) -> list[dict]:
        stages = preparation_stages(fills[k])
        ready = Pipeline(stages=stages).fit(train.limit(0)).transform(train)
        keep = [target, fold, FEATURES_COL, *([WEIGHT_COL] if weighted else [])]
        ready = ready.select(*keep).repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        held = ready.filter(F.col(fold) == k).select(F.col(target).alias("__y"), FEATURES_COL)

        def scores(group: tuple[dict, dict[int, int]]) -> DataFrame:
            settings, sizes = group
            wanted = {**settings, size: max(sizes)}
            if wanted.get("maxDepth", 0) > DEEP:
                wanted["cacheNodeIds"] = True
            model = classifier.copy({classifier.getParam(n): v for n, v in wanted.items()}).fit(ready.filter(F.col(fold) != k))
            cuts = sorted(sizes)
            out = trees.model_prefix_scores(held, PipelineModel([model]), ["__y"], cuts)
            s = F.col("SCORES")
            each = [
                F.struct(F.lit(sizes[n]).alias("POINT"),
                         (s[i] * (max(cuts) / n) if forest else 1 / (1 + F.exp(-2 * s[i]))).alias("P"))
                for i, n in enumerate(cuts)
            ]
            return out.select("__y", F.explode(F.array(*each)).alias("e")).select("__y", "e.POINT", "e.P")

        with ThreadPool(min(parallelism, len(groups))) as pool:
            scored = pool.map(inheritable_thread_target(spark)(scores), groups)
        found = grouped_metrics(union_all(scored), ["POINT"], "__y", "P").collect()  # a row per point
        ready.unpersist()
        return [r.asDict() for r in found]

    # Points that differ in size only share their fits as it is, and a large table must be spread over the tasks.
    rules = [_rules(classifier, {**settings, size: max(sizes)}, size) for settings, sizes in groups]
    if len(groups) > 1 and all(rules) and 0 < n <= WHOLE_ROWS and set(balance) <= {0, 1}:
        rows, refit = _grown_search(
            train, classifier, size, points, groups, rules, fills, [balance.get(c, 1.0) for c in (0, 1)], n, target, fold, folds, weighted)
        return _chosen(points, rows, refit, folds * len(groups) + 1)

    # A single point is the best one whatever its metrics, so its refit need not wait for them.
    side = max(1, min((folds + 1) // min(parallelism, len(groups)), SIDE_ROWS // max(1, n)))
    with ThreadPool(side) as pool:
        early = pool.apply_async(inheritable_thread_target(spark)(refit), (points[0],)) if len(points) == 1 else None
        rows = [r for found in pool.map(inheritable_thread_target(spark)(fold_metrics), range(folds), chunksize=1) for r in found]
        single = early.get() if early else None
    return _chosen(points, rows, lambda point: single or refit(point), folds * len(groups) + 1)


def _chosen(points: list[dict], rows: Sequence[Mapping], refit: Callable[[Mapping], PipelineModel], fits: int) -> Search:
    """Mean and spread of the metrics over the folds, and the point with the highest mean AUC refitted."""
    metrics = []
    for i in range(len(points)):
        own = [r for r in rows if r["POINT"] == i]
        told = {}
        for m in ("ROC_AUC", "ACCURACY", "F1"):
            values = [r[m] for r in own if r[m] is not None]
            told[f"MEAN_{m}"] = float(np.mean(values)) if values else float("nan")
            told[f"SD_{m}"] = float(np.std(values)) if values else float("nan")
        metrics.append(told)
    best = int(np.nanargmax([m["MEAN_ROC_AUC"] for m in metrics])) if any(
        m["MEAN_ROC_AUC"] == m["MEAN_ROC_AUC"] for m in metrics) else 0
    return Search(points, metrics, best, refit(points[best]), fits)


def train_random_forest(
    train: DataFrame,
    grid: Mapping[str, Sequence] | Sequence[Mapping] = FOREST_GRID,
    target: str = "DPTN",
    fold: str = "FOLD",
    folds: int = 5,
    parallelism: int = 4,
    seed: int = 42,
    balanced: bool = True,
) -> Search:
    """Random forest chosen by cross-validated ROC AUC over the grid."""
    data = with_balanced_weights(train, target) if balanced else train
    return _search(
        data, random_forest(target, seed, balanced), "numTrees", grid_points(grid), target, fold,
        folds, parallelism, balanced,
    )


def train_boosted_trees(
    train: DataFrame,
    grid: Mapping[str, Sequence] | Sequence[Mapping] = BOOST_GRID,
    target: str = "DPTN",
    fold: str = "FOLD",
    folds: int = 5,
    parallelism: int = 4,
    seed: int = 42,
) -> Search:
    """Gradient-boosted trees chosen by cross-validated ROC AUC over the grid."""
    return _search(
        train, boosted_trees(target, seed), "maxIter", grid_points(grid), target, fold, folds,
        parallelism, False,
    )


def cv_results(spark: SparkSession, search: Search, model: str) -> DataFrame:
    """One row per grid point: settings as JSON text, mean and spread of three metrics, and whether it is the best."""
    names = [f"{s}_{m}" for m in ("ROC_AUC", "ACCURACY", "F1") for s in ("MEAN", "SD")]
    rows = [
        (model, i, json.dumps(point, sort_keys=True), *(told[n] for n in names), "Y" if i == search.best else "N")
        for i, (point, told) in enumerate(zip(search.points, search.metrics))
    ]
    columns = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, f"MODEL string, POINT int, SETTINGS string, {columns}, IS_BEST string")


def best_settings(search: Search) -> dict:
    return search.points[search.best]


def refit_best(
    train: DataFrame, classifier, settings: Mapping, weighted: bool = False, target: str = "DPTN"
) -> PipelineModel:
    """Fit one specification on all training rows."""
    data = with_balanced_weights(train, target) if weighted else train
    chosen = classifier.copy({classifier.getParam(k): v for k, v in settings.items()})
    return Pipeline(stages=[*fitted_stages(train), chosen]).fit(spread(data))


def feature_importance(
    spark: SparkSession, model: PipelineModel, n: int = 12, features: Sequence[str] = S.FEATURES
) -> DataFrame:
    """The n most important features of a tree model."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(f, S.FEATURE_LABELS.get(f, f), float(w)) for f, w in zip(features, weights)]
    table = spark.createDataFrame(rows, "FEATURE string, LABEL string, IMPORTANCE double")
    return table.orderBy(F.desc("IMPORTANCE"), "FEATURE").limit(n)


def importance_map(model: PipelineModel, features: Sequence[str] = S.FEATURES) -> dict[str, float]:
    weights = model.stages[-1].featureImportances.toArray()
    return {f: float(w) for f, w in zip(features, weights)}

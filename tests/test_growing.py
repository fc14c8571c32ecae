"""Ensembles grown by tasks against Spark's learners, where nothing is drawn, and against a plain forest."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from trialspark import schema as S
from trialspark.operators import growing as G, split, training as M, trees
from trialspark.operators.evaluate import binary_metrics
from trialspark.operators.scoring import score
from trialspark.plans.catalog import models as catalog


def made(n, seed=7, missing=0.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        events, compliance = rng.randrange(8), rng.choice([50.0, 70.0, 85.0, 100.0])
        p = 0.08 + 0.08 * events + (0.25 if compliance < 80 else 0)
        row = [rng.randrange(25, 71), rng.choice([1, 2]), rng.choice([1, 2, 3, 4]), rng.choice([0, 1, 2]), round(rng.uniform(2, 8.5), 1),
               round(rng.uniform(18, 40), 3), rng.choice([0, 1, 2]), events, rng.randrange(2), rng.randrange(4), rng.randrange(2),
               rng.randrange(3), compliance, rng.randrange(3)]
        row = [None if rng.random() < missing else float(v) for v in row]
        out.append((f"ST-{i:05d}", *row, int(rng.random() < p)))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    schema = "USUBJID string, " + ", ".join(f"{c} double" for c in S.FEATURES) + ", DPTN int"
    return split.stratified_folds(spark.createDataFrame(made(700), schema), folds=2).cache()


@pytest.fixture(scope="module")
def assembled(frame):
    return frame.withColumn("features", array_to_vector(F.array(*S.FEATURES))).cache()


def arrays(frame, bins=32):
    rows = frame.select("USUBJID", *S.FEATURES, "DPTN").collect()
    raw, y = np.array([r[1:-1] for r in rows], "f8"), np.array([r[-1] for r in rows], "i1")
    weight = M.with_balanced_weights(frame).groupBy("DPTN").agg(F.max(M.WEIGHT_COL)).collect()
    balance = np.array([w for _, w in sorted(map(tuple, weight))])
    cuts = []
    for column in raw.T:
        values, at = np.unique(column, return_inverse=True)
        cuts.append(G.cut_points(values, np.bincount(at, balance[y]), bins))
    return [r[0] for r in rows], np.stack([np.searchsorted(c, v) for c, v in zip(cuts, raw.T)], axis=1).astype("u1"), y, balance, cuts


@pytest.mark.parametrize("depth,least", [(4, 5), (30, 5), (30, 1)])
def test_tree_of_classes_equals_sparks(assembled, depth, least):
    """One tree on all features and rows, with weights: the same probabilities, also where many values share a bin."""
    names, x, y, balance, _ = arrays(assembled)
    rules = G.Rules(True, 1, depth, least, 0.0, 32, 1, features="all")
    grown = G.grow_classes(x, y, np.ones(len(y), int), balance, rules, np.random.default_rng(1))
    mine = dict(zip(names, grown.value[G.walk(grown, x)]))
    model = RandomForestClassifier(labelCol="DPTN", weightCol=M.WEIGHT_COL, numTrees=1, featureSubsetStrategy="all", bootstrap=False,
                                   maxDepth=depth, minInstancesPerNode=least, seed=3).fit(M.with_balanced_weights(assembled))
    theirs = {r["USUBJID"]: r["probability"][1] for r in model.transform(assembled).collect()}
    equal = sum(mine[k] == pytest.approx(v, abs=1e-9) for k, v in theirs.items())
    assert equal >= 0.98 * len(mine)  # two splits may be equally good


def test_boosting_equals_sparks(spark, frame, assembled):
    """Rounds on all rows, and the model stored in Spark's form: probabilities, importances and prefixes."""
    point = {"maxIter": 12, "maxDepth": 3, "stepSize": 0.1, "subsamplingRate": 1.0}
    theirs = GBTClassifier(labelCol="DPTN", seed=42, **point).fit(assembled)
    fills = {None: {}}
    cuts = G.fold_cuts(frame, S.FEATURES, fills, "FOLD", 32)
    learner = M.boosted_trees()
    chosen = learner.copy({learner.getParam(n): v for n, v in point.items()})
    mine = G.refit(frame, S.FEATURES, "DPTN", "FOLD", fills, cuts, M._rules(learner, point, "maxIter"), [1.0, 1.0], chosen)
    told = [{r["USUBJID"]: r["probability"][1] for r in m.transform(assembled).collect()} for m in (mine, theirs)]
    assert all(told[0][k] == pytest.approx(v, abs=1e-6) for k, v in told[1].items())
    assert mine.treeWeights == theirs.treeWeights and mine.getMaxDepth() == 3
    assert mine.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.05)  # two features may cut alike


def test_search_by_tasks_agrees_with_sparks_search(frame):
    """Boosting on all rows: the metrics of every point and fold are those of Spark's fits, the best is refitted to the same model."""
    grid = {"maxIter": [3, 6], "maxDepth": [2, 3], "stepSize": [0.1], "subsamplingRate": [1.0]}
    found = M.train_boosted_trees(frame, grid, folds=2)
    assert found.fits == 5 and len(found.metrics) == 4
    for depth in (2, 3):
        plain = M.train_boosted_trees(frame, {**grid, "maxDepth": [depth]}, folds=2)  # one group: Spark's learner
        for point, metrics in zip(plain.points, plain.metrics):
            assert found.metrics[found.points.index(point)] == pytest.approx(metrics, abs=1e-3)  # equal margins may differ in their last bit
    assert len(found.bestModel.stages[-1].trees) == M.best_settings(found)["maxIter"]


def test_forests_of_the_search_are_as_good_as_sparks(spark, frame):
    grid = {"numTrees": [20, 40], "maxDepth": [4, 30], "minInstancesPerNode": [5]}
    found = M.train_random_forest(frame, grid, folds=2)
    for depth in (4, 30):
        plain = M.train_random_forest(frame, {**grid, "maxDepth": [depth]}, folds=2)
        for point, metrics in zip(plain.points, plain.metrics):
            assert found.metrics[found.points.index(point)] == pytest.approx(metrics, abs=0.05)
    forest = found.bestModel.stages[-1]
    assert forest.getNumTrees == M.best_settings(found)["numTrees"] == len(forest.trees)
    assert binary_metrics(score(frame, found.bestModel)).first()["ROC_AUC"] > 0.7
    values = trees.model_leaves(spark, found.bestModel)
    assert set(values.tree) == set(range(len(forest.trees)))


def test_search_by_tasks_does_not_depend_on_partitions_and_fills_missing_values(spark):
    schema = "USUBJID string, " + ", ".join(f"{c} double" for c in S.FEATURES) + ", DPTN int"
    rows = split.stratified_folds(spark.createDataFrame(made(400, 5, 0.1), schema), folds=2).cache()
    grid = {"numTrees": [3, 5], "maxDepth": [3, 12], "minInstancesPerNode": [2]}
    one, other = (M.train_random_forest(df, grid, folds=2) for df in (rows.coalesce(1), rows.repartition(7)))
    assert one.metrics == [pytest.approx(m, abs=1e-12) for m in other.metrics] and one.best == other.best


def test_a_search_keeps_few_cells_and_rows_at_a_time(monkeypatch):
    """The same trees whatever the size of chunks and blocks."""
    rng = np.random.default_rng(2)
    x, y, times = rng.integers(0, 9, (900, 6)).astype("u1"), rng.integers(0, 2, 900).astype("i1"), rng.poisson(1, 900)
    rules = G.Rules(True, 5, 12, 2, 0.0, 9, 1)
    boosting = G.Rules(False, 3, 4, 1, 0.0, 9, 1, rate=0.8)

    def grown():
        tree = G.grow_classes(x, y, times, np.array([0.7, 1.4]), rules, np.random.default_rng(1))
        return [tree.value[G.walk(tree, x)], *[m for _, _, m in G.boosted_trees(x, y, np.arange(800), boosting, 0)]]

    whole = grown()
    monkeypatch.setattr(G, "CELLS", 200)
    monkeypatch.setattr(G, "BLOCK", 37)
    assert all(np.allclose(a, b) for a, b in zip(whole, grown()))


def test_forest_searches_of_many_rows_stay_spread(frame, monkeypatch):
    monkeypatch.setattr(M, "WHOLE_ROWS", 100)
    monkeypatch.setattr(G, "search_scores", None)
    found = M.train_random_forest(frame, {"numTrees": [2], "maxDepth": [2, 3]}, folds=2)
    assert found.fits == 5


def test_deepest_grid_of_a_search_runs_no_job_for_a_group_of_nodes(spark, frame, monkeypatch):
    """Twelve points of deep forests are a few jobs together, where one fit of Spark's learner alone has more than its depth."""
    monkeypatch.setattr(M.RandomForestClassifier, "fit", None)
    found = M.train_random_forest(frame, {**M.FOREST_GRID, "numTrees": [4, 8]}, folds=2)
    assert len(found.metrics) == 12 and all(m["MEAN_ROC_AUC"] > 0.5 for m in found.metrics)


def searched(monkeypatch, frame):
    """Points that a query asks for, by kind of model; searches are run on small ensembles."""
    asked = {}
    for name, size in (("train_random_forest", "numTrees"), ("train_boosted_trees", "maxIter")):
        def small(train, grid, folds, whole=getattr(M, name), name=name, size=size):
            asked[name] = M.grid_points(grid)
            return whole(train, [{**p, size: p[size] // 100} for p in asked[name]], folds=folds)

        monkeypatch.setattr(M, name, small)
    monkeypatch.setattr(catalog, "parts", lambda t: (split.stratified_folds(frame.drop("FOLD")), frame))
    return asked


def test_train_random_forest_searches_the_whole_grid(frame, monkeypatch):
    asked = searched(monkeypatch, frame)
    row = catalog.train_random_forest(None).first()
    assert asked["train_random_forest"] == M.grid_points(M.FOREST_GRID) and len(M.grid_points(M.FOREST_GRID)) == 12
    assert row["MODEL"] == "Random Forest" and row["ROC_AUC"] > 0.6


def test_cv_results_has_every_point_of_both_grids(spark, frame, monkeypatch):
    asked = searched(monkeypatch, frame)
    rows = catalog.cv_results(type("Trial", (), {"spark": spark})).collect()
    assert asked == {"train_random_forest": M.grid_points(M.FOREST_GRID), "train_boosted_trees": M.grid_points(M.BOOST_GRID)}
    assert [sum(r["MODEL"] == m for r in rows) for m in ("Random Forest", "Boosted Trees")] == [12, 24]
    assert sum(r["IS_BEST"] == "Y" for r in rows) == 2 and all(r["MEAN_ROC_AUC"] > 0.5 for r in rows)

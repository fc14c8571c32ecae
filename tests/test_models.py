"""Split, preparation, evaluation, training, scoring, explanation."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from trialspark import schema as S
from trialspark.operators import evaluate as E, explain, prep, split, training as M, trees
from trialspark.operators.scoring import score, score_by_rule
from trialspark.plans.catalog import models as catalog
from trialspark.sources import models as store
from trialspark.sources.domains import shared_folder
from trialspark.streaming.scoring import read_stream, scored_stream, write_scores


def scored(spark, rows):
    return spark.createDataFrame(rows, "DROPOUT_PROB double, DPTN int")


def test_auc_with_ties(spark):
    df = scored(spark, [(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)])
    assert E.roc_auc(df).first()["ROC_AUC"] == 0.875


def test_auc_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(30) / 30, int(rng.random() < 0.4)) for _ in range(300)]
    pos, neg = ([p for p, y in rows if y == v] for v in (1, 0))
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    got = E.roc_auc(scored(spark, rows)).first()["ROC_AUC"]
    assert got == pytest.approx(wins / len(pos) / len(neg))


def test_metrics_without_positives(spark):
    row = E.binary_metrics(scored(spark, [(0.1, 0), (0.2, 0)])).first()
    assert row["ROC_AUC"] is None and row["ACCURACY"] == 1.0 and row["F1"] == 0.0


def test_classification_report(spark):
    df = scored(spark, [(0.9, 1), (0.8, 0), (0.2, 0), (0.1, 0), (0.3, 1)])
    rows = {r["LABEL"]: r for r in E.classification_report(df).collect()}
    assert (rows["Dropout"]["PRECISION"], rows["Dropout"]["RECALL"]) == (0.5, 0.5)
    assert rows["Completed"]["PRECISION"] == pytest.approx(2 / 3)
    assert rows["accuracy"]["F1"] == 0.6 and rows["macro avg"]["SUPPORT"] == 5
    assert rows["weighted avg"]["F1"] == pytest.approx((3 * 2 / 3 + 2 * 0.5) / 5)


def test_roc_ends_at_one(spark):
    df = scored(spark, [(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)])
    points = {r["THRESHOLD"]: (r["TPR"], r["FPR"]) for r in E.roc_points(df).collect()}
    assert points == {0.9: (0.5, 0.0), 0.5: (1.0, 0.5), 0.1: (1.0, 1.0)}


@pytest.fixture(scope="module")
def frame(spark):
    """Subjects whose dropout depends on events and compliance, with some missing values."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        events, compliance = rng.randrange(8), rng.choice([50.0, 70.0, 85.0, 100.0])
        p = 0.08 + 0.08 * events + (0.25 if compliance < 80 else 0)
        rows.append((
            f"ST-{i:04d}", rng.randrange(25, 71), rng.choice([1, 2]), rng.choice([1, 2, 3, 4]),
            rng.choice([0, 1, 2]), round(rng.uniform(2, 8.5), 1), round(rng.uniform(18, 40), 1),
            rng.choice([0, 1, 2]), events, rng.randrange(2), min(3, events), rng.randrange(2),
            rng.randrange(3), compliance, rng.randrange(3), int(rng.random() < p),
        ))
    kinds = {c: "double" if c in ("DAS28BL", "BMIBL", "COMPLPCT") else "int" for c in S.FEATURES}
    schema = "USUBJID string, " + ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", DPTN int"
    return spark.createDataFrame(rows, schema)


def test_split_ignores_partitioning(frame):
    for exact in (False, True):
        a = split.stratified_split(frame.repartition(7), exact=exact)
        b = split.stratified_split(frame.coalesce(1), exact=exact)
        pick = lambda d: sorted(map(tuple, d.select("USUBJID", "PART").collect()))
        assert pick(a) == pick(b)
    sizes = split.stratified_split(frame, exact=True).groupBy("DPTN").agg(
        F.count("*").alias("n"), F.sum((F.col("PART") == "train").cast("int")).alias("t")
    )
    assert all(r["t"] == int(r["n"] * 0.7) for r in sizes.collect())
    share = split.stratified_split(frame).filter("PART = 'train'").count() / 600
    assert 0.62 < share < 0.78


def test_folds_partition_rows(frame):
    folds = split.stratified_folds(frame, exact=True, min_rows=10)
    sizes = folds.groupBy("DPTN", "FOLD").count().groupBy("DPTN").agg(
        (F.max("count") - F.min("count")).alias("gap"), F.count("*").alias("k")
    )
    assert all(r["gap"] <= 1 and r["k"] == 5 for r in sizes.collect())
    assert {r["FOLD"] for r in split.stratified_folds(frame).collect()} == set(range(5))


def test_impute_and_standardise(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1), ("b", 3.0, 1), ("c", None, None), ("d", 10.0, 2)],
        "USUBJID string, X double, C int",
    )
    rows = {r["USUBJID"]: r for r in prep.impute(df, ["X"], ["C"]).collect()}
    assert rows["c"]["X"] == 3.0 and rows["c"]["C"] == 1
    z = [r["X"] for r in prep.standardise(df.dropna(), ["X"]).orderBy("USUBJID").collect()]
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    dummies = prep.dummy_encode(df, ["C"])
    assert dummies.columns == ["USUBJID", "X", "C_2"]
    assert [r["C_2"] for r in dummies.orderBy("USUBJID").collect()] == [0, 0, None, 1]


def test_grids():
    assert len(M.grid_points(M.FOREST_GRID)) == 12
    assert len(M.grid_points(M.BOOST_GRID)) == 24
    assert len(M.grid_points(M.FOREST_REGULAR_GRID)) == 9
    design = M.space_filling_design()
    assert len(design) == 15 and design == M.space_filling_design()
    assert all(3 <= p["maxDepth"] <= 7 and 1e-3 <= p["stepSize"] <= 1e-1 for p in design)


@pytest.fixture(scope="module")
def fitted(frame):
    return M.refit_best(
        frame, M.random_forest(), {"numTrees": 10, "maxDepth": 4}, weighted=True
    )


def test_cross_validation(spark, frame):
    train = split.stratified_folds(frame, folds=3)
    cv = M.train_random_forest(
        train, {"numTrees": [5], "maxDepth": [2, 4]}, folds=3, parallelism=2
    )
    table = M.cv_results(spark, cv, "Random Forest").collect()
    assert len(table) == 2 and sum(r["IS_BEST"] == "Y" for r in table) == 1
    assert M.best_settings(cv)["maxDepth"] in (2, 4)
    boosted = M.train_boosted_trees(
        train, [{"maxIter": 3, "maxDepth": 2, "stepSize": 0.1, "minInfoGain": 0.0}], folds=3
    )
    auc = E.roc_auc(score(frame, boosted.bestModel)).first()["ROC_AUC"]
    assert auc > 0.6


def test_points_that_differ_in_size_share_a_fit(spark, frame):
    """The prefix of boosted trees is the smaller ensemble itself; its metrics equal those of a search of its own."""
    train = split.stratified_folds(frame, folds=2)
    grid = {"maxIter": [2, 4], "maxDepth": [2], "stepSize": [0.1], "subsamplingRate": [0.8]}
    both = M.train_boosted_trees(train, grid, folds=2)
    assert both.fits == 3 and [p["maxIter"] for p in both.points] == [2, 4]
    for i, n in enumerate((2, 4)):
        alone = M.train_boosted_trees(train, {**grid, "maxIter": [n]}, folds=2)
        assert alone.metrics[0] == pytest.approx(both.metrics[i], abs=1e-9)
    forests = M.train_random_forest(train, {"numTrees": [3, 6], "maxDepth": [2, 3]}, folds=2)
    assert forests.fits == 5 and len(forests.bestModel.stages[-1].trees) in (3, 6)
    row = M.cv_results(spark, forests, "Random Forest").where("IS_BEST = 'Y'").first()
    assert row["MEAN_ROC_AUC"] == max(m["MEAN_ROC_AUC"] for m in forests.metrics) and row["SD_F1"] >= 0


def test_fold_fills_equal_medians_and_modes_of_the_other_folds(spark):
    rng = random.Random(3)
    rows = [(i % 3, rng.choice([None, 1.0, 2.0, 7.5, 9.0]), rng.choice([None, 1, 2, 2, 3])) for i in range(101)]
    found = prep.fold_imputation_values(spark.createDataFrame(rows, "f int, a double, c int"), ["a"], ["c"], "f", 3)
    for k in (None, 0, 1, 2):
        a = [r[1] for r in rows if r[0] != k and r[1] is not None]
        c = [r[2] for r in rows if r[0] != k and r[2] is not None]
        assert found[k] == {"a": float(np.median(a)), "c": min(set(c), key=lambda v: (-c.count(v), v))}


def test_grouped_metrics_equal_those_of_each_group(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(9) / 8, int(rng.random() < 0.4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, DROPOUT_PROB double, DPTN int")
    got = {r["g"]: r.asDict() for r in E.grouped_metrics(df, ["g"]).collect()}
    for g in "ab":
        want = E.binary_metrics(df.where(F.col("g") == g)).first()
        assert all(got[g][m] == pytest.approx(want[m]) for m in ("ROC_AUC", "ACCURACY", "F1"))


def test_largest_least_gain_of_the_design_still_splits(frame):
    most = 10 ** M.BOOST_RANGES["minInfoGain"][1]
    model = M.refit_best(frame, M.boosted_trees(), {"maxIter": 2, "maxDepth": 3, "minInfoGain": most})
    assert all(t.numNodes > 1 for t in model.stages[-1].trees)


def test_importance_finds_the_drivers(spark, fitted):
    top = [r["FEATURE"] for r in M.feature_importance(spark, fitted, 4).collect()]
    assert "AENUM" in top and "COMPLPCT" in top


def test_saved_model_scores_the_same(spark, frame, fitted):
    again = store.load_model(store.save_model(fitted, shared_folder(spark, "test-model")))
    a = score(frame, fitted).select("USUBJID", "DROPOUT_PROB", "RISK_TIER").collect()
    b = score(frame, again).select("USUBJID", "DROPOUT_PROB", "RISK_TIER").collect()
    assert sorted(a) == sorted(b)


def test_shapley_values_sum_to_prediction(frame, fitted):
    subjects = frame.limit(40)
    result = explain.shapley_contributions(subjects, fitted, frame.limit(3))
    probs = {r["USUBJID"]: r["DROPOUT_PROB"] for r in score(subjects, fitted).collect()}
    rows = result.collect()
    assert len(rows) == 40
    for r in rows:
        total = r["BASE_VALUE"] + sum(c["CONTRIBUTION"] for c in r["CONTRIBUTIONS"])
        assert total == pytest.approx(r["PREDICTION"]) == pytest.approx(probs[r["USUBJID"]])
    ranked = explain.global_importance(result).orderBy(F.desc("MEAN_ABS")).limit(3).collect()
    assert {"AENUM", "COMPLPCT"} & {r["FEATURE"] for r in ranked}


def test_top_factors(spark, frame):
    weights = {f: w for f, w in zip(S.FEATURES, [0.3, -0.2, 0.1, 0.05, 0.04, 0.02])}
    rows = frame.limit(1).withColumn("DROPOUT_PROB", F.lit(0.9))
    contributions = explain.importance_contributions(rows, weights)
    row = explain.top_factors(contributions, k=4, per_side=2).first()
    assert [r["FEATURE"] for r in row["TOP_RISK_FACTORS"]] == ["AGE", "RACEN"]
    assert [r["FEATURE"] for r in row["TOP_PROTECTIVE_FACTORS"]] == ["SEXN"]
    nested = explain.format_explanation(contributions).first()
    assert nested["PREDICTION"] == "Dropout"
    assert nested["EXPLANATION"]["TOP_RISK_FACTORS"][0]["LABEL"] == "Age (years)"


def test_register(spark):
    record = store.model_record(
        spark, "ST", "DRUG", "A", {"A": {"ROC_AUC": 0.8, "ACCURACY": 0.7, "F1": 0.5}},
        S.FEATURES, 70, 30,
    )
    path = shared_folder(spark, "test-register")
    store.append_record(record, path)
    store.append_record(record, path)
    assert spark.read.parquet(path).count() == 2


def test_stream_scores_equal_batch_scores(spark, frame, fitted):
    rows = frame.withColumn("SITEID", F.lit("101"))
    folder = shared_folder(spark, "test-stream-in")
    rows.repartition(3).write.parquet(folder)
    for model, batch in ((fitted, score(rows, fitted)), (None, score_by_rule(rows))):
        out = shared_folder(spark, "test-stream-out")
        stream = scored_stream(read_stream(spark, folder, rows.schema), model)
        query = write_scores(stream, out, shared_folder(spark, "test-stream-state"))
        query.awaitTermination(120)
        pick = ["USUBJID", "DROPOUT_PROB", "RISK_TIER"]
        got = {r[0]: r[1:] for r in spark.read.parquet(out).select(pick).collect()}
        want = {r[0]: r[1:] for r in batch.select(pick).collect()}
        assert got == want


@pytest.mark.parametrize("name", ["shapley_contributions", "shapley_importance"])
def test_shapley_queries_explain_from_the_whole_background(spark, frame, fitted, monkeypatch, name):
    """Both queries average over 20 background rows, as the study does."""
    asked = []

    def recorded(df, model, background, **rest):
        asked.append(background.count())
        return whole(df.limit(2), model, background, **rest)

    whole = explain.shapley_contributions
    monkeypatch.setattr(explain, "shapley_contributions", recorded)
    monkeypatch.setattr(catalog, "parts", lambda t: (frame, frame))
    monkeypatch.setattr(catalog, "forest", lambda train: fitted)
    assert getattr(catalog, name)(None).count()
    assert asked == [20]


def by_enumeration(score, x, background):
    """Shapley values from all coalitions; a coalition's value is the mean score over the background."""
    n = len(x)
    value = [np.mean([score([x[j] if s >> j & 1 else b[j] for j in range(n)]) for b in background]) for s in range(1 << n)]
    out = []
    for j in range(n):
        out.append(sum(
            math.factorial(s.bit_count()) * math.factorial(n - s.bit_count() - 1) / math.factorial(n)
            * (value[s | 1 << j] - value[s]) for s in range(1 << n) if not s >> j & 1))
    return value[0], value[-1], out


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_shapley_values_equal_enumeration(spark, monkeypatch, kind):
    """Six features, a forest (probability) and boosted trees (margin), with few cells in a task at a time."""
    rng = np.random.default_rng(4)
    rows = [[f"s{i}", *map(float, rng.integers(0, 6, 6)), 0.0] for i in range(120)]
    for r in rows:
        r[-1] = float(r[1] * r[2] + r[3] > 9 + r[4] * (r[5] > 2))
    names = [f"F{j}" for j in range(6)]
    df = spark.createDataFrame(rows, ", ".join(["K string", *[f"{n} double" for n in names], "y double"]))
    learner = (RandomForestClassifier(labelCol="y", numTrees=7, maxDepth=5, seed=1) if kind == "forest"
               else GBTClassifier(labelCol="y", maxIter=5, maxDepth=3, seed=1))
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), learner]).fit(df)
    monkeypatch.setattr(trees, "CELLS", 500)
    leaves, background = trees.model_leaves(spark, model), [r[1:7] for r in rows[:9]]

    def plain(x):
        inside = leaves.masks(np.array([x]))[0] == leaves.full
        return leaves.value[inside].sum()

    got = {r["K"]: r for r in trees.leaf_shapley(
        trees.prepared(df, model, ["K"]), leaves, trees.prepared(df.limit(9), model, []), "K", 6).collect()}
    assert len(got) == 120
    for r in rows[::12]:
        base, score_, phi = by_enumeration(plain, r[1:7], background)
        mine = got[r[0]]
        assert mine["BASE_VALUE"] == pytest.approx(base, abs=1e-9) and mine["PREDICTION"] == pytest.approx(score_, abs=1e-9)
        assert mine["PHI"] == pytest.approx(phi, abs=1e-9)
    sizes = [3, 5]
    parts = {r["K"]: r["SCORES"] for r in trees.prefix_scores(trees.prepared(df, model, ["K"]), leaves, ["K"], sizes).collect()}
    for r in rows[::12]:
        inside = leaves.masks(np.array([r[1:7]]))[0] == leaves.full
        assert parts[r[0]] == pytest.approx([leaves.value[inside & (leaves.tree < n)].sum() for n in sizes])
    whole = {r["K"]: r["probability"][1] for r in model.transform(df).collect()}
    for k, r in got.items():
        p = r["PREDICTION"] if kind == "forest" else 1 / (1 + math.exp(-2 * r["PREDICTION"]))
        assert p == pytest.approx(whole[k], abs=1e-9)


def test_sampled_contributions_sum_to_prediction(frame, fitted):
    for r in explain.sampled_contributions(frame.limit(5), fitted, frame.limit(2), orderings=2).collect():
        assert r["BASE_VALUE"] + sum(c["CONTRIBUTION"] for c in r["CONTRIBUTIONS"]) == pytest.approx(r["PREDICTION"])


def test_queries_fit_specifications_of_the_documented_grids():
    assert catalog.FOREST_POINT in M.grid_points(M.FOREST_GRID)
    assert catalog.BOOST_POINT in M.grid_points(M.BOOST_GRID)


def test_model_queries_fit_at_full_size(frame, fitted, monkeypatch):
    asked = []

    def kept(train, classifier, settings, **rest):
        asked.append(settings)
        return fitted

    monkeypatch.setattr(M, "refit_best", kept)
    catalog.forest(frame)
    for name, run in (("train_random_forest", catalog.train_random_forest), ("train_boosted_trees", catalog.train_boosted_trees)):
        def searched(train, grid, folds):
            asked.extend(M.grid_points(grid))
            raise StopIteration

        monkeypatch.setattr(M, name, searched)
        monkeypatch.setattr(catalog, "parts", lambda t: (frame, frame))
        with pytest.raises(StopIteration):
            run(None)
    assert asked == [catalog.FOREST_POINT, catalog.FOREST_POINT, catalog.BOOST_POINT]


def test_levels_gather_no_set_in_one_buffer(spark, monkeypatch):
    monkeypatch.delattr(prep.F, "collect_set")
    rows = [(i % 3, f"t{i % 2}", float(i % 4), None) for i in range(50)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "A int, B string, C double, D int")
    known = prep.levels(df, ["B", "A", "C", "D"])
    assert known == {"B": ["t0", "t1"], "A": [0, 1, 2], "C": [0.0, 1.0, 2.0, 3.0], "D": []}
    assert len(prep.levels(spark.createDataFrame([(float("nan"),), (1.0,)], "C double"), ["C"])["C"]) == 2
    assert prep.dummy_encode(df, ["B", "A"]).columns == ["C", "D", "B_t1", "A_1", "A_2"]


def test_scores_by_leaf_numbers_equal_those_by_bounds(spark, frame):
    """For prefixes of a forest and of boosted trees, bit for bit."""
    for classifier, settings, cuts in (
            (M.random_forest(weighted=False), {"numTrees": 7, "maxDepth": 12, "cacheNodeIds": True}, [2, 7]),
            (M.boosted_trees(), {"maxIter": 5, "maxDepth": 3}, [1, 3, 5])):
        model = M.refit_best(frame, classifier, settings)
        want = trees.prefix_scores(trees.prepared(frame, model, ["USUBJID"]), trees.model_leaves(spark, model), ["USUBJID"], cuts)
        got = trees.model_prefix_scores(frame, model, ["USUBJID"], cuts)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_search_scores_without_a_look_at_every_leaf(frame, monkeypatch):
    monkeypatch.setattr(trees, "prefix_scores", None)
    monkeypatch.setattr(trees, "model_leaves", None)
    found = M.train_random_forest(split.stratified_folds(frame, folds=2), {"numTrees": [3], "maxDepth": [2, 12]}, folds=2)
    assert found.fits == 5 and all(m["MEAN_ROC_AUC"] > 0.5 for m in found.metrics)


def test_folds_of_small_tables_are_fitted_side_by_side(frame, monkeypatch):
    """Both folds and the refit meet at a barrier, which one at a time would never do."""
    import threading

    together, whole = threading.Barrier(3, timeout=120), M.GBTClassifier.fit
    monkeypatch.setattr(M.GBTClassifier, "fit", lambda self, rows, *more: (together.wait(), whole(self, rows, *more))[1])
    found = M.train_boosted_trees(split.stratified_folds(frame, folds=2), [{"maxIter": 2, "maxDepth": 2}], folds=2)
    assert found.fits == 3 and found.best == 0


def test_rows_of_a_fit_are_dealt_to_enough_tasks(spark, monkeypatch):
    assert M.tasks_for(1_000, 12) == 12 and M.tasks_for(4_000_000, 12) == 24
    assert M.tasks_for(48_000, 12, True) == 2 and M.tasks_for(4_000_000, 12, True) == 24 and M.tasks_for(0, 12, True) == 1
    monkeypatch.setattr(M, "ROWS_A_TASK", 100)
    few, many = spark.range(90).coalesce(1), spark.range(5_000).coalesce(1)
    assert M.spread(few) is few
    sizes = [len(p) for p in M.spread(many).rdd.glom().collect()]
    assert sum(sizes) == 5_000 and max(sizes) <= 100


def test_one_specification_is_fitted_on_rows_dealt_to_enough_tasks(frame, monkeypatch):
    """The learner gets no part of more than ROWS_A_TASK rows, though all rows come in one, and loses none."""
    sizes, whole = [], M.RandomForestClassifier.fit

    def recorded(self, rows, *more):
        sizes.extend(len(p) for p in rows.rdd.glom().collect())
        return whole(self, rows, *more)

    monkeypatch.setattr(M, "ROWS_A_TASK", 20)
    monkeypatch.setattr(M.RandomForestClassifier, "fit", recorded)
    M.refit_best(frame.coalesce(1), M.random_forest(), {"numTrees": 2, "maxDepth": 2}, weighted=True)
    assert sum(sizes) == frame.count() and max(sizes) <= 20


def test_shapley_values_of_deep_trees_sum_to_prediction(spark, frame):
    """Too many bits for one table of all cells: each batch works off its own."""
    deep = M.refit_best(frame, M.random_forest(), {"numTrees": 20, "maxDepth": 14}, weighted=True)
    leaves = trees.model_leaves(spark, deep)
    assert len(leaves) << len(leaves.feature) > trees.CELLS
    found = trees.leaf_shapley(
        trees.prepared(frame.limit(20), deep, ["USUBJID"]), leaves, trees.prepared(frame.limit(3), deep, []), "USUBJID", len(S.FEATURES))
    for r in found.collect():
        assert r["BASE_VALUE"] + sum(r["PHI"]) == pytest.approx(r["PREDICTION"])

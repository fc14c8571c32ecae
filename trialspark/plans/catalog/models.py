"""Model frame, split, preparation, evaluation, training, scoring and explanation.

forest_grid and train_random_forest search the whole forest grid, cv_results both grids. The other queries that fit a model take one documented
specification of a search grid at full size. The full grids are the defaults of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialspark import schema as S
from trialspark.operators import evaluate as E, explain, prep, split, training as M, trees
from trialspark.operators.reshape import sample_subjects
from trialspark.operators.rows import round_numeric, validate_ranges, valid_rows
from trialspark.operators.scoring import score
from trialspark.operators.tables import batch_risk_summary
from trialspark.plans.catalog.derivations import range_sql
from trialspark.plans.catalog.registry import query
from trialspark.plans.catalog.sequences import (
    CONTRIBUTIONS_SQL, METRICS_SQL, contributions, rule_models,
)
from trialspark.plans.order_trial import DRUG, REMOTE_SITES, STUDY, OrderTrial
from trialspark.sources import models as store
from trialspark.sources.domains import read_domain, shared_folder, write_domain
from trialspark.streaming import scoring as stream

# One point of FOREST_GRID and one of BOOST_GRID.
FOREST_POINT = {"numTrees": 200, "maxDepth": 6, "minInstancesPerNode": 5}
BOOST_POINT = {"maxIter": 200, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 1.0}
BACKGROUND_ROWS = 20  # as in plans/study.py
SPLIT_LIMIT = int(0.70 * 2**32)


def _hash(seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}' || USUBJID), 1, 8) AS BIGINT)"


@query("model_frame", "SELECT * FROM frame")
def model_frame(t: OrderTrial) -> DataFrame:
    return t.frame


PART_SQL = f"CASE WHEN {_hash(42)} < {SPLIT_LIMIT} THEN 'train' ELSE 'test' END"


@query("stratified_split", f"SELECT USUBJID, DPTN, {PART_SQL} AS PART FROM frame")
def stratified_split(t: OrderTrial) -> DataFrame:
    """By hash only, without ranking."""
    return split.stratified_split(t.frame.select("USUBJID", "DPTN"), exact=False)


RANKED = """row_number() OVER (PARTITION BY DPTN ORDER BY {h}, USUBJID)"""


@query(
    "stratified_split_exact",
    f"""SELECT USUBJID, DPTN, CASE WHEN {RANKED.format(h=_hash(42))}
      <= floor(count(*) OVER (PARTITION BY DPTN) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS PART FROM frame""",
)
def stratified_split_exact(t: OrderTrial) -> DataFrame:
    """Exact share of each class."""
    return split.stratified_split(t.frame.select("USUBJID", "DPTN"), exact=True)


@query("stratified_folds", f"SELECT USUBJID, DPTN, CAST({_hash(43)} % 5 AS INTEGER) AS FOLD FROM frame")
def stratified_folds(t: OrderTrial) -> DataFrame:
    """By hash only, without ranking."""
    return split.stratified_folds(t.frame.select("USUBJID", "DPTN"), exact=False)


@query(
    "stratified_folds_exact",
    f"""SELECT USUBJID, DPTN, CAST(({RANKED.format(h=_hash(43))} - 1) % 5 AS INTEGER) AS FOLD FROM frame""",
)
def stratified_folds_exact(t: OrderTrial) -> DataFrame:
    """Folds balanced exactly within each class."""
    return split.stratified_folds(t.frame.select("USUBJID", "DPTN"), exact=True)


@query(
    "split_summary",
    f"""SELECT PART, count(*) AS N, round(avg(DPTN), 6) AS DROPOUT_RATE
    FROM (SELECT DPTN, {PART_SQL} AS PART FROM frame) GROUP BY PART""",
)
def split_summary(t: OrderTrial) -> DataFrame:
    return round_numeric(split.split_summary(split.stratified_split(t.frame, exact=False)), 6)


def _impute_sql() -> str:
    fills = [
        f"coalesce(CAST({f} AS DOUBLE), (SELECT median(CAST({f} AS DOUBLE)) FROM itt)) AS {f}"
        for f in S.NUMERIC_FEATURES
    ]
    fills += [
        f"coalesce({f}, (SELECT {f} FROM itt GROUP BY {f} ORDER BY count(*) DESC, {f} LIMIT 1)) AS {f}"
        for f in S.CATEGORICAL_FEATURES
    ]
    return f"SELECT USUBJID, {', '.join(fills)}, DPTN FROM itt"


@query("impute", _impute_sql())
def impute(t: OrderTrial) -> DataFrame:
    """Missing baseline values filled with the exact median or the most frequent value."""
    return prep.impute(prep.model_frame(t.adsl, keep_missing=True))


def _standardise_sql() -> str:
    cells = [
        f"round((f.{c} - avg(f.{c}) OVER ()) / stddev_pop(f.{c}) OVER (), 6) + 0.0 AS {c}"
        for c in S.NUMERIC_FEATURES
    ]
    return f"SELECT USUBJID, {', '.join(cells)} FROM frame f"


@query("standardise", _standardise_sql())
def standardise(t: OrderTrial) -> DataFrame:
    frame = t.frame.select("USUBJID", *S.NUMERIC_FEATURES)
    return round_numeric(prep.standardise(frame), 6)


@query(
    "dummy_encode",
    "SELECT USUBJID, "
    + ", ".join(
        f"CASE WHEN {col} = {v} THEN 1 ELSE 0 END AS {col}_{v}"
        for col, values in {
            "SEXN": [2], "RACEN": [2, 3, 4], "REGIONN": [1, 2], "TRT01PN": [1, 2],
        }.items()
        for v in values
    )
    + " FROM frame",
)
def dummy_encode(t: OrderTrial) -> DataFrame:
    return prep.dummy_encode(t.frame.select("USUBJID", *S.CATEGORICAL_FEATURES))


@query(
    "binary_metrics",
    METRICS_SQL + "SELECT * REPLACE ('rule' AS MODEL) FROM metrics WHERE MODEL = 'additive rule'",
)
def binary_metrics(t: OrderTrial) -> DataFrame:
    return round_numeric(E.binary_metrics(t.outcome, model="rule"), 6)


@query(
    "roc_points",
    """, bys AS (SELECT DROPOUT_PROB AS s, sum(DPTN) AS p, count(*) - sum(DPTN) AS q FROM outcome GROUP BY s)
    SELECT s AS THRESHOLD, round(sum(p) OVER (ORDER BY s DESC) / CAST(sum(p) OVER () AS DOUBLE), 6) AS TPR,
    round(sum(q) OVER (ORDER BY s DESC) / CAST(sum(q) OVER () AS DOUBLE), 6) AS FPR FROM bys""",
)
def roc_points(t: OrderTrial) -> DataFrame:
    points = E.roc_points(t.outcome)
    return points.withColumns({c: F.round(c, 6) for c in ("TPR", "FPR")})


@query(
    "classification_report",
    """, conf AS (
      SELECT CAST(count(*) FILTER (WHERE DPTN = 1 AND DROPOUT_PROB >= 0.5::DOUBLE) AS DOUBLE) AS tp,
        count(*) FILTER (WHERE DPTN = 0 AND DROPOUT_PROB >= 0.5::DOUBLE) AS fp,
        count(*) FILTER (WHERE DPTN = 1 AND DROPOUT_PROB < 0.5::DOUBLE) AS fn,
        CAST(count(*) FILTER (WHERE DPTN = 0 AND DROPOUT_PROB < 0.5::DOUBLE) AS DOUBLE) AS tn FROM outcome),
    cls AS (
      SELECT 'Completed' AS LABEL, coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r,
        coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f, tn + fp AS s, (tp + tn) / (tp + fp + tn + fn) AS acc FROM conf
      UNION ALL
      SELECT 'Dropout', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn, (tp + tn) / (tp + fp + tn + fn) FROM conf),
    rep AS (
      SELECT LABEL, p, r, f, s FROM cls UNION ALL
      SELECT 'accuracy', max(acc), max(acc), max(acc), sum(s) FROM cls UNION ALL
      SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM cls UNION ALL
      SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM cls)
    SELECT LABEL, round(p, 6) AS PRECISION, round(r, 6) AS RECALL, round(f, 6) AS F1, CAST(s AS BIGINT) AS SUPPORT
    FROM rep""",
)
def classification_report(t: OrderTrial) -> DataFrame:
    return round_numeric(E.classification_report(t.outcome), 6)


@query(
    "model_comparison",
    METRICS_SQL
    + """SELECT *, CASE WHEN row_number() OVER (ORDER BY ROC_AUC DESC, MODEL) = 1 THEN 'Y' ELSE 'N' END AS IS_BEST
    FROM metrics""",
)
def model_comparison(t: OrderTrial) -> DataFrame:
    return round_numeric(E.model_comparison(rule_models(t)), 6)


@query(
    "importance_contributions",
    CONTRIBUTIONS_SQL
    + """SELECT USUBJID, PREDICTION, FEATURE, VALUE, round(CONTRIBUTION, 8) + 0.0 AS CONTRIBUTION, DIRECTION
    FROM named""",
)
def importance_contributions(t: OrderTrial) -> DataFrame:
    long = explain.contribution_rows(contributions(t)).drop("LABEL", "BASE_VALUE")
    return long.withColumn("CONTRIBUTION", F.round("CONTRIBUTION", 8))


@query(
    "global_importance",
    CONTRIBUTIONS_SQL
    + "SELECT FEATURE, round(avg(abs(CONTRIBUTION)), 8) AS MEAN_ABS FROM named GROUP BY FEATURE",
)
def global_importance(t: OrderTrial) -> DataFrame:
    return round_numeric(explain.global_importance(contributions(t)), 8)


@query(
    "format_explanation",
    CONTRIBUTIONS_SQL
    + """, shown AS (SELECT *, round(CONTRIBUTION, 4) + 0.0 AS c4 FROM named),
    big AS (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY USUBJID ORDER BY abs(c4) DESC, pos) <= 10),
    sided AS (SELECT *, row_number() OVER (PARTITION BY USUBJID, DIRECTION ORDER BY abs(c4) DESC, pos) AS rk FROM big)
    SELECT USUBJID, round(max(PREDICTION), 4) AS PROBABILITY,
    CASE WHEN max(PREDICTION) >= 0.5::DOUBLE THEN 'Dropout' ELSE 'Completed' END AS PREDICTION,
    coalesce(string_agg(FEATURE, ',' ORDER BY rk) FILTER (WHERE DIRECTION = 'increases_risk' AND rk <= 5), '') AS RISK,
    coalesce(string_agg(FEATURE, ',' ORDER BY rk) FILTER (WHERE DIRECTION = 'decreases_risk' AND rk <= 5), '') AS PROTECTIVE
    FROM sided GROUP BY USUBJID""",
)
def format_explanation(t: OrderTrial) -> DataFrame:
    """Nested explanations, shown as lists of feature names."""
    record = explain.format_explanation(contributions(t))
    return record.select(
        "USUBJID",
        F.col("PREDICTED_DROPOUT_PROBABILITY").alias("PROBABILITY"),
        "PREDICTION",
        F.concat_ws(",", F.col("EXPLANATION.TOP_RISK_FACTORS.FEATURE")).alias("RISK"),
        F.concat_ws(",", F.col("EXPLANATION.TOP_PROTECTIVE_FACTORS.FEATURE")).alias("PROTECTIVE"),
    )


@query(
    "scored_stream",
    f"""SELECT USUBJID, DROPOUT_PROB, DROPOUT_PREDICTED, RISK_TIER FROM scored
    WHERE {range_sql()} = ''""",
)
def scored_stream(t: OrderTrial) -> DataFrame:
    """All subjects streamed from a folder through validation and the additive rule."""
    inputs = t.adsl.select("USUBJID", "SITEID", *S.FEATURES)
    folder = write_domain(inputs, shared_folder(t.spark, "arrivals"))
    rows = stream.read_stream(t.spark, folder, inputs.schema)
    out = shared_folder(t.spark, "scores")
    written = stream.write_scores(
        stream.scored_stream(rows, remote_sites=REMOTE_SITES), out,
        shared_folder(t.spark, "scoring-state"),
    )
    written.awaitTermination()
    return read_domain(t.spark, out).select(
        "USUBJID", "DROPOUT_PROB", "DROPOUT_PREDICTED", "RISK_TIER"
    )


TEST_SQL = f"""SELECT * FROM (SELECT *, CASE WHEN {RANKED.format(h=_hash(42))}
  <= floor(count(*) OVER (PARTITION BY DPTN) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS PART FROM frame)"""


# Queries below fit models. Spark's tree learners have no SQL counterpart; SQL states what must hold of their results.


def parts(t: OrderTrial) -> tuple[DataFrame, DataFrame]:
    """Training rows with folds, and test rows.

    The frame is written once to the shared folder, so cross-validation reads a narrow table
    instead of repeating the joins for every fold.
    """
    split_frame = split.stratified_folds(split.stratified_split(t.frame))
    path = write_domain(split_frame, shared_folder(t.spark, "frame"))
    stored = read_domain(t.spark, path)
    train = stored.filter(F.col("PART") == "train")
    return train, stored.filter(F.col("PART") == "test")


def forest(train: DataFrame):
    return M.refit_best(train, M.random_forest(), FOREST_POINT, weighted=True)


@query("train_random_forest")
def train_random_forest(t: OrderTrial) -> DataFrame:
    """The best of the twelve points of the forest grid, cross-validated and judged on the test rows."""
    train, test = parts(t)
    cv = M.train_random_forest(train, M.FOREST_GRID, folds=5)
    return E.binary_metrics(score(test, cv.bestModel), model="Random Forest")


@query("train_boosted_trees")
def train_boosted_trees(t: OrderTrial) -> DataFrame:
    """One boosting specification of the grid, cross-validated and judged on the test rows; the grid is not searched."""
    train, test = parts(t)
    cv = M.train_boosted_trees(train, [BOOST_POINT], folds=5)
    return E.binary_metrics(score(test, cv.bestModel), model="Boosted Trees")


@query("cv_results")
def cv_results(t: OrderTrial) -> DataFrame:
    """Mean and spread of three metrics of every point of the forest and of the boosting grid."""
    train, _ = parts(t)
    forests = M.train_random_forest(train, M.FOREST_GRID, folds=5)
    boosted = M.train_boosted_trees(train, M.BOOST_GRID, folds=5)
    return M.cv_results(t.spark, forests, "Random Forest").unionByName(
        M.cv_results(t.spark, boosted, "Boosted Trees")
    )


@query("forest_grid")
def forest_grid(t: OrderTrial) -> DataFrame:
    """All twelve points of the forest grid, from one fit for each fold and each pair of points that differ in size only."""
    train, _ = parts(t)
    return M.cv_results(t.spark, M.train_random_forest(train, M.FOREST_GRID, folds=5), "Random Forest")


@query("refit_best")
def refit_best(t: OrderTrial) -> DataFrame:
    """The cross-validated specification refitted on all training rows, judged on the test rows."""
    train, test = parts(t)
    cv = M.train_random_forest(train, [FOREST_POINT], folds=5)
    model = M.refit_best(train, M.random_forest(), M.best_settings(cv), weighted=True)
    return E.classification_report(score(test, model))


@query("feature_importance")
def feature_importance(t: OrderTrial) -> DataFrame:
    train, _ = parts(t)
    return M.feature_importance(t.spark, forest(train), 12)


@query("score")
def score_subjects(t: OrderTrial) -> DataFrame:
    """Probability, label and tier of every subject with valid inputs."""
    train, _ = parts(t)
    # Event counts of this data exceed the limits of a real trial.
    wide = {**S.SCORE_RANGES, "AENUM": (0, 10**6, True, None), "AESNUM": (0, 10**6, True, None),
            "N_ALT_AE": (0, 10**6, True, 0), "N_NEURO_GI_AE": (0, 10**6, True, 0),
            "N_MISSED_DOSES": (0, 10**6, True, 0)}
    inputs = valid_rows(validate_ranges(t.adsl.select("USUBJID", *S.FEATURES), wide))
    scored = score(inputs, forest(train))
    return scored.select("USUBJID", "DROPOUT_PROB", "DROPOUT_PREDICTED", "RISK_TIER")


@query("score_summary")
def score_summary(t: OrderTrial) -> DataFrame:
    """Batch summary of model scores on the test rows."""
    train, test = parts(t)
    return batch_risk_summary(score(test, forest(train)))


@query(
    "save_load_model",
    f"SELECT count(*) AS N, 0.0::DOUBLE AS GAP FROM ({TEST_SQL}) WHERE PART = 'test'",
)
def save_load_model(t: OrderTrial) -> DataFrame:
    """Rows scored by a model and by its saved copy, with the largest difference."""
    train, test = parts(t)
    model = forest(train)
    path = store.save_model(model, shared_folder(t.spark, "model"))
    again = store.load_model(path)
    both = score(test.select("USUBJID", *S.FEATURES), model).withColumnRenamed("DROPOUT_PROB", "P")
    both = score(both.drop("DROPOUT_PREDICTED", "RISK_TIER"), again)
    return both.agg(
        F.count(F.lit(1)).alias("N"), F.max(F.abs(F.col("P") - F.col("DROPOUT_PROB"))).alias("GAP")
    )


@query("load_model")
def load_model(t: OrderTrial) -> DataFrame:
    """Test subjects scored by a model that was saved and loaded."""
    train, test = parts(t)
    path = store.save_model(forest(train), shared_folder(t.spark, "model"))
    scored = score(test.select("USUBJID", *S.FEATURES), store.load_model(path))
    return scored.select("USUBJID", "DROPOUT_PROB", "DROPOUT_PREDICTED", "RISK_TIER")


@query(
    "scored_stream_model",
    f"""SELECT count(*) AS N, 0.0::DOUBLE AS GAP, 0::BIGINT AS OTHER_TIER
    FROM ({TEST_SQL}) WHERE PART = 'test' AND {range_sql()} = ''""",
)
def scored_stream_model(t: OrderTrial) -> DataFrame:
    """Test subjects streamed from a folder and scored by the fitted forest, held against their scores in batch."""
    train, test = parts(t)
    model, rows = forest(train), test.select("USUBJID", *S.FEATURES)
    arrivals = stream.read_stream(t.spark, write_domain(rows, shared_folder(t.spark, "arrivals")), rows.schema)
    out = shared_folder(t.spark, "scores")
    stream.write_scores(
        stream.scored_stream(arrivals, model), out, shared_folder(t.spark, "scoring-state")).awaitTermination()
    told = read_domain(t.spark, out).select("USUBJID", F.col("DROPOUT_PROB").alias("P"), F.col("RISK_TIER").alias("T"))
    return told.join(score(rows, model), "USUBJID").agg(
        F.count(F.lit(1)).alias("N"),
        F.coalesce(F.max(F.abs(F.col("P") - F.col("DROPOUT_PROB"))), F.lit(0.0)).alias("GAP"),
        F.count(F.when(F.col("T") != F.col("RISK_TIER"), 1)).alias("OTHER_TIER"))


@query("model_record")
def model_record(t: OrderTrial) -> DataFrame:
    """Register row of the better of two models, appended to a table and read back."""
    train, test = parts(t)
    candidates = {
        "Random Forest": forest(train),
        "Boosted Trees": M.refit_best(train, M.boosted_trees(), BOOST_POINT),
    }
    table = E.model_comparison({n: score(test, m) for n, m in candidates.items()}).collect()
    metrics = {
        r["MODEL"]: {m: round(r[m], 4) for m in E.METRICS} for r in table
    }
    best = next(r["MODEL"] for r in table if r["IS_BEST"] == "Y")
    record = store.model_record(
        t.spark, STUDY, DRUG, best, metrics, S.FEATURES, train.count(), test.count()
    )
    path = store.append_record(record, shared_folder(t.spark, "register"))
    return read_domain(t.spark, path)


def explained(t: OrderTrial) -> tuple[DataFrame, DataFrame]:
    """Exact Shapley values of the test subjects for the fitted forest, and those subjects with its scores."""
    train, test = parts(t)
    model, background = forest(train), sample_subjects(train.select("USUBJID", *S.FEATURES), BACKGROUND_ROWS)
    subjects = test.select("USUBJID", *S.FEATURES)
    return explain.shapley_contributions(subjects, model, background), score(subjects, model)


@query("shapley_contributions")
def shapley_contributions(t: OrderTrial) -> DataFrame:
    """Shapley values of every test subject."""
    return explain.contribution_rows(explained(t)[0])


@query("shapley_importance")
def shapley_importance(t: OrderTrial) -> DataFrame:
    """Mean absolute Shapley value per feature over the test subjects."""
    return explain.global_importance(explained(t)[0])


@query(
    "shapley_additivity",
    f"""SELECT USUBJID, {len(S.FEATURES)}::BIGINT AS FEATURES, CAST({' + '.join(S.FEATURES)} AS DOUBLE) AS VALUE_SUM,
    0.0::DOUBLE AS GAP, 0.0::DOUBLE AS SCORE_GAP FROM ({TEST_SQL}) WHERE PART = 'test'""",
)
def shapley_additivity(t: OrderTrial) -> DataFrame:
    """For every test subject what base value and contributions miss of the prediction, and this of the forest's own score."""
    values, scored = explained(t)
    sums = explain.contribution_rows(values).groupBy("USUBJID", "BASE_VALUE", "PREDICTION").agg(
        F.count(F.lit(1)).alias("FEATURES"), F.sum("VALUE").alias("VALUE_SUM"), F.sum("CONTRIBUTION").alias("__sum"))
    return sums.join(scored.select("USUBJID", "DROPOUT_PROB"), "USUBJID").select(
        "USUBJID", "FEATURES", "VALUE_SUM",
        F.round(F.abs(F.col("BASE_VALUE") + F.col("__sum") - F.col("PREDICTION")), 9).alias("GAP"),
        F.round(F.abs(F.col("PREDICTION") - F.col("DROPOUT_PROB")), 9).alias("SCORE_GAP"))


# Two small trees over four features, as (tree, value, bounds of features by position); SQL states the same trees.
TREE_FEATURES = ["AGE", "COMPLPCT", "AENUM", "DAS28BL"]
INF = float("inf")
FIXED_LEAVES = [
    (0, 0.10, {0: (-INF, 50.0), 1: (-INF, 80.0)}), (0, 0.30, {0: (-INF, 50.0), 1: (80.0, INF)}),
    (0, 0.05, {0: (50.0, INF), 2: (-INF, 3.0)}), (0, 0.45, {0: (50.0, INF), 2: (3.0, INF)}),
    (1, 0.20, {3: (-INF, 5.5), 0: (-INF, 40.0)}), (1, 0.02, {3: (-INF, 5.5), 0: (40.0, 60.0)}),
    (1, 0.40, {3: (-INF, 5.5), 0: (60.0, INF)}), (1, 0.33, {3: (5.5, INF), 1: (-INF, 90.0), 2: (-INF, 6.0)}),
    (1, 0.12, {3: (5.5, INF), 1: (-INF, 90.0), 2: (6.0, INF)}), (1, 0.01, {3: (5.5, INF), 1: (90.0, INF)}),
]


def _fixed_trees_sql() -> str:
    """Every coalition of the four features against every background row, weighted as Shapley values are."""
    x = [f"CASE WHEN s & {1 << j} <> 0 THEN x.{f} ELSE b.{f} END" for j, f in enumerate(TREE_FEATURES)]
    first = f"""CASE WHEN {x[0]} <= 50 THEN CASE WHEN {x[1]} <= 80 THEN 0.10 ELSE 0.30 END
      ELSE CASE WHEN {x[2]} <= 3 THEN 0.05 ELSE 0.45 END END"""
    second = f"""CASE WHEN {x[3]} <= 5.5 THEN CASE WHEN {x[0]} <= 40 THEN 0.20 WHEN {x[0]} <= 60 THEN 0.02 ELSE 0.40 END
      ELSE CASE WHEN {x[1]} > 90 THEN 0.01 WHEN {x[2]} <= 6 THEN 0.33 ELSE 0.12 END END"""
    one = "CASE WHEN s & {b} <> 0 THEN v * w_in ELSE -v * w_out END"
    cells = ", ".join(
        f"round(sum({one.format(b=1 << j)}), 9) + 0.0 AS PHI_{f}" for j, f in enumerate(TREE_FEATURES))
    return f"""SELECT USUBJID, {cells}, round(sum(v) FILTER (WHERE s = 15), 9) AS PREDICTION FROM (
      SELECT x.USUBJID, s, CAST(avg({first} + {second}) AS DOUBLE) AS v,
        [0, 6, 2, 2, 6][bit_count(s) + 1] / 24.0::DOUBLE AS w_in, [6, 2, 2, 6, 0][bit_count(s) + 1] / 24.0::DOUBLE AS w_out
      FROM frame x, (SELECT * FROM frame ORDER BY md5('42' || USUBJID), USUBJID LIMIT {BACKGROUND_ROWS}) b, range(16) AS t(s)
      GROUP BY x.USUBJID, s) GROUP BY USUBJID"""


@query("shapley_fixed_trees", _fixed_trees_sql())
def shapley_fixed_trees(t: OrderTrial) -> DataFrame:
    """Exact Shapley values of two stated trees for all subjects."""
    x = F.array(*[F.col(f).cast("double") for f in TREE_FEATURES]).alias("__x")
    rows, background = t.frame.select("USUBJID", x), sample_subjects(t.frame, BACKGROUND_ROWS).select(x)
    values = trees.leaf_shapley(rows, trees.Leaves(FIXED_LEAVES), background, "USUBJID", len(TREE_FEATURES))
    return values.select(
        "USUBJID", *[(F.round(F.col("PHI")[j], 9) + 0.0).alias(f"PHI_{f}") for j, f in enumerate(TREE_FEATURES)],
        F.round("PREDICTION", 9).alias("PREDICTION"))

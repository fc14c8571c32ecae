"""The whole study: raw domains to analysis datasets, checks, tables, and a scored model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspark import schema as S
from trialspark.operators import (
    checks, evaluate, explain, prep, split, survival, tables, training,
)
from trialspark.operators.adam import build_adae, build_adsl
from trialspark.operators.numbering import sequence_within
from trialspark.operators.reshape import sample_subjects
from trialspark.operators.rows import population
from trialspark.operators.scoring import score
from trialspark.sources import models
from trialspark.sources.domains import read_domain, require_inputs, write_domain

RAW = {"DM": S.DM, "AE": S.AE, "EX": S.EX, "VS": S.VS, "DS": S.DS}


def read_domains(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """The five raw domains with their declared schemas."""
    found = require_inputs(spark, {name: paths[name] for name in RAW})
    return {name: read_domain(spark, found[name], schema) for name, schema in RAW.items()}


def analysis_datasets(
    spark: SparkSession, raw: Mapping[str, DataFrame], out: str
) -> dict[str, DataFrame]:
    """ADSL and ADAE, written once because every later stage reads them."""
    ae = raw["AE"]
    order = ["AESTDTC", "AEDECOD", *[c for c in ae.columns if c not in
             ("USUBJID", "AESTDTC", "AEDECOD", "AESEQ")]]
    ae = sequence_within(ae.drop("AESEQ"), "USUBJID", order, "AESEQ")
    adsl = build_adsl(raw["DM"], raw["DS"], raw["AE"], raw["EX"], raw["VS"])
    adsl = spark.read.schema(S.ADSL).parquet(write_domain(adsl, f"{out}/adsl"))
    adae = build_adae(ae, adsl)
    adae = spark.read.schema(S.ADAE).parquet(write_domain(adae, f"{out}/adae"))
    return {"ADSL": adsl, "ADAE": adae}


def study_tables(adsl: DataFrame, adae: DataFrame, strata: list[str]) -> dict[str, DataFrame]:
    """Every table and figure dataset of the report."""
    itt = population(adsl, "ITT")
    emergent = adae.filter(F.col("TRTEMFL") == "Y")
    times = survival.survival_input(itt)
    return {
        "continuous": tables.continuous_summary(
            itt, ["AGE", "BMIBL", "DAS28BL", "COMPLPCT", "AENUM"]
        ),
        "categorical": tables.categorical_summary(
            itt, ["SEX", "AGEGR1", "RACE", "DAS28GRP", "COMPLFL"]
        ),
        "site_distribution": tables.site_distribution(itt),
        "demographics": tables.demographics_by_arm(itt),
        "arm_denominators": tables.arm_denominators(adsl),
        "teae_overall": tables.teae_overall(adae, adsl),
        "teae_by_term": tables.teae_by_term(adae, adsl),
        "teae_severity": tables.crosstab(emergent, "AESEV", "TRT01P"),
        "site_dropout": tables.site_summary(itt),
        "arm_dropout": tables.dropout_by_arm(itt),
        "dropout_reasons": tables.dropout_reasons(itt),
        "means_by_status": tables.means_by_status(adsl),
        "km_curve": survival.km_curve(times),
        "logrank": survival.logrank_test(times, strata),
    }


def train_and_score(
    adsl: DataFrame,
    out: str,
    forest_grid=training.FOREST_GRID,
    boost_grid=training.BOOST_GRID,
    folds: int = 5,
    background_rows: int = 20,
    seed: int = 42,
) -> tuple[PipelineModel, dict[str, DataFrame]]:
    """Tune both model types, keep the better one, score all subjects, explain the test rows.

    ``background_rows`` training subjects, drawn by a hash with ``seed``, are the background of the explanations.
    """
    spark = adsl.sparkSession
    parts = split.stratified_folds(split.stratified_split(prep.model_frame(adsl)), folds=folds)
    parts = spark.read.parquet(write_domain(parts, f"{out}/model_frame"))
    train, test = (parts.filter(F.col("PART") == p) for p in ("train", "test"))
    searches = {
        "Random Forest": training.train_random_forest(train, forest_grid, folds=folds),
        "Boosted Trees": training.train_boosted_trees(train, boost_grid, folds=folds),
    }
    judged = evaluate.model_comparison({n: score(test, s.bestModel) for n, s in searches.items()})
    comparison = spark.read.parquet(write_domain(judged, f"{out}/model_comparison"))
    best = comparison.filter(F.col("IS_BEST") == "Y").first()["MODEL"]
    model = searches[best].bestModel
    models.save_model(model, f"{out}/model")
    columns = ["USUBJID", *S.FEATURES]
    background = sample_subjects(train.select(columns), background_rows, seed=seed)
    contributions = explain.shapley_contributions(test.select(columns), model, background)
    return model, {
        "split_summary": split.split_summary(parts),
        "cv_results": training.cv_results(spark, searches["Random Forest"], "Random Forest")
        .unionByName(training.cv_results(spark, searches["Boosted Trees"], "Boosted Trees")),
        "model_comparison": comparison,
        "classification_report": evaluate.classification_report(score(test, model)),
        "roc_points": evaluate.roc_points(score(test, model)),
        "feature_importance": training.feature_importance(spark, model),
        "explanations": explain.format_explanation(contributions),
        "scored": score(adsl.dropna(subset=S.FEATURES), model),
    }


def run_study(
    spark: SparkSession, paths: Mapping[str, str], out: str, id_pattern: str, **model_options
) -> dict[str, DataFrame]:
    """Run all stages, write every result below ``out``, and return the written tables."""
    raw = read_domains(spark, paths)
    data = analysis_datasets(spark, raw, out)
    adsl, adae = data["ADSL"], data["ADAE"]
    log = checks.validation_suite(spark, raw["DM"], raw["AE"], adsl, id_pattern)
    log = spark.read.parquet(write_domain(log, f"{out}/validation_log"))
    arms = [r[0] for r in tables.distinct_values(adsl, ["TRT01P"]).select("VALUE").collect()]
    results = {
        "validation_rollup": checks.validation_rollup(log, adsl, raw["AE"]),
        **study_tables(adsl, adae, arms),
        **train_and_score(adsl, out, **model_options)[1],
    }
    written = {n: write_domain(df, f"{out}/results/{n}") for n, df in results.items()}
    return {
        **data, "validation_log": log, **{n: spark.read.parquet(p) for n, p in written.items()}
    }

"""Fitted pipelines and the register of fitted models."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_record(
    spark: SparkSession,
    study: str,
    drug: str,
    best: str,
    metrics: Mapping[str, Mapping[str, float]],
    features: Sequence[str],
    n_train: int,
    n_test: int,
    target: str = "Patient dropout (DPTN=1)",
) -> DataFrame:
    """One row describing the chosen model, with the metrics of all candidates as JSON text."""
    chosen = metrics[best]
    row = (
        study, drug, target, best, chosen["ROC_AUC"], chosen["ACCURACY"], chosen["F1"],
        list(features), n_train, n_test, json.dumps({k: dict(v) for k, v in metrics.items()}),
    )
    return spark.createDataFrame(
        [row],
        "STUDYID string, DRUG string, TARGET string, BEST_MODEL string, ROC_AUC double, "
        "ACCURACY double, F1 double, FEATURES array<string>, N_TRAIN long, N_TEST long, "
        "COMPARISON string",
    )


def append_record(record: DataFrame, path: str) -> str:
    record.write.mode("append").parquet(path)
    return path

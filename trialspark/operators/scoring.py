"""Scoring of subjects: probability, label and risk tier. Works on batch and streaming rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from trialspark.functions import dropout_rule_score, predicted_label, risk_tier


def _with_outputs(df: DataFrame, probability: Column) -> DataFrame:
    return df.withColumn("DROPOUT_PROB", probability).withColumns(
        {
            "DROPOUT_PREDICTED": predicted_label(F.col("DROPOUT_PROB")),
            "RISK_TIER": risk_tier(F.col("DROPOUT_PROB")),
        }
    )


def probabilities(df: DataFrame, model: PipelineModel, name: str = "DROPOUT_PROB") -> DataFrame:
    """Add the probability of the positive class and nothing else."""
    out = model.transform(df).withColumn(name, vector_to_array(F.col("probability"))[1])
    return out.select(*df.columns, name)


def score(df: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Score rows with a fitted pipeline; without one the probability is missing and the tier Unknown."""
    if model is None:
        return _with_outputs(df, F.lit(None).cast("double"))
    return _with_outputs(probabilities(df, model, "__p"), F.col("__p")).drop("__p")


def score_by_rule(df: DataFrame, remote_sites=("107", "108")) -> DataFrame:
    """Score rows with the additive rule instead of a fitted model."""
    rule = dropout_rule_score(
        F.col("AENUM"), F.col("AESNUM"), F.col("AEMAXSEVN"), F.col("COMPLPCT"),
        F.col("SITEID"), F.col("TRT01PN"), remote_sites,
    )
    return _with_outputs(df, rule)


def risk_table(scored: DataFrame, tiers: Sequence[str] | None = None) -> DataFrame:
    """Dashboard view of scored subjects of some tiers: riskiest first, one decimal, display names."""
    chosen = scored if tiers is None else scored.filter(F.col("RISK_TIER").isin(*tiers))
    return chosen.select(
        F.col("USUBJID").alias("Subject ID"),
        F.col("SITEID").alias("Site"),
        F.col("TRT01P").alias("Treatment"),
        F.col("AGE").alias("Age"),
        F.col("SEX").alias("Sex"),
        F.col("AENUM").alias("N AEs"),
        F.col("AEMAXSEVN").alias("Max Sev (N)"),
        F.round("COMPLPCT", 1).alias("Compliance %"),
        F.round(F.col("DROPOUT_PROB") * 100, 1).alias("Dropout Prob %"),
        F.col("RISK_TIER").alias("Risk Tier"),
    ).orderBy(F.desc("Dropout Prob %"), "Subject ID")

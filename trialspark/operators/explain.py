"""Per-subject explanations.

Contributions are one array of records per subject, so ranking the factors of a subject is
array work inside its row and needs no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from trialspark import schema as S
from trialspark.functions import indicator
from trialspark.operators import trees
from trialspark.operators.reshape import union_all
from trialspark.operators.scoring import probabilities

# Paths that become one constant of the plan; more paths are worked off in blocks, whose sums are added.
BLOCK_PATHS = 1000

RECORD = ["FEATURE", "LABEL", "VALUE", "CONTRIBUTION", "DIRECTION"]


def _record(feature: str, value: Column, contribution: Column) -> Column:
    return F.struct(
        F.lit(feature).alias("FEATURE"),
        F.lit(S.FEATURE_LABELS.get(feature, feature)).alias("LABEL"),
        value.cast("double").alias("VALUE"),
        contribution.alias("CONTRIBUTION"),
        F.when(contribution > 0, "increases_risk").otherwise("decreases_risk").alias("DIRECTION"),
    )


def importance_contributions(
    scored: DataFrame,
    importance: Mapping[str, float],
    probability: str = "DROPOUT_PROB",
    key: str = "USUBJID",
) -> DataFrame:
    """Cheap contributions: global importance x (probability - 0.5), with base value 0.5."""
    gap = F.col(probability) - F.lit(0.5)
    records = [_record(f, F.col(f), F.lit(float(w)) * gap) for f, w in importance.items()]
    return scored.select(
        key,
        F.lit(0.5).alias("BASE_VALUE"),
        F.col(probability).alias("PREDICTION"),
        F.array(*records).alias("CONTRIBUTIONS"),
    )


def shapley_contributions(
    df: DataFrame,
    model: PipelineModel,
    background: DataFrame,
    features: Sequence[str] = S.FEATURES,
    key: str = "USUBJID",
) -> DataFrame:
    """Exact Shapley values of a fitted tree ensemble, against the rows of ``background``.

    A forest is explained on the scale of the probability, boosted trees on that of the margin. The base value plus the
    contributions equals the prediction. ``key`` identifies a row of ``df``; background rows with a missing feature
    count with the value that the model fills in.
    """
    names = list(features)
    inputs = trees.prepared(df, model, [key])
    found = trees.leaf_shapley(
        inputs, trees.model_leaves(df.sparkSession, model), trees.prepared(background, model, []), key, len(names))
    own = df.select(key, F.array(*[F.col(f).cast("double") for f in names]).alias("__own"))
    records = [_record(f, F.col("__own")[j], F.col("PHI")[j]) for j, f in enumerate(names)]
    return found.join(own, key).select(key, "BASE_VALUE", "PREDICTION", F.array(*records).alias("CONTRIBUTIONS"))


def sampled_contributions(
    df: DataFrame,
    model: PipelineModel,
    background: DataFrame,
    orderings: int = 8,
    seed: int = 42,
    features: Sequence[str] = S.FEATURES,
    key: str = "USUBJID",
) -> DataFrame:
    """Shapley values of the predicted probability of any model, sampled over feature orderings.

    Along one ordering the features of a background row are replaced one by one by those of
    the subject, and every change of the prediction is credited to the feature replaced. All
    steps of all subjects are scored in one pass of the model. The base value plus the
    contributions equals the prediction exactly, for any number of orderings.

    ``background`` is a sample of the same columns, whose rows become constants of the plan, and ``key``
    identifies a row of ``df``.
    The steps of a subject are made and summed in the task that holds the subject, so the
    shuffle carries one partial row per subject.
    """
    names = list(features)
    rows = background.select(*[F.col(f).cast("double") for f in names]).dropna()
    sample = rows.collect()
    if not sample:
        raise ValueError("background needs a complete row")
    rng = np.random.default_rng(seed)
    paths = [
        {"rank": np.argsort(rng.permutation(len(names))).tolist(), "from": list(row)}
        for row in sample
        for _ in range(orderings)
    ]
    types = {f.name: f.dataType for f in df.schema.fields}
    own = F.array(*[F.col(f).cast("double") for f in names]).alias("__own")
    p, step = F.col("__p"), F.col("__step")
    n = float(len(paths))

    def walked(block: list[dict]) -> DataFrame:
        # One text constant, which the optimizer folds into an array once.
        listed = F.from_json(
            F.lit(json.dumps(block)), "array<struct<rank: array<int>, from: array<double>>>"
        )
        steps = (
            df.select(key, own)
            .withColumn("__path", F.explode(listed))
            .withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
        )
        rank = F.col("__path.rank")
        mixed = steps.select(
            key, "__own", "__step", rank.alias("__rank"),
            *[
                F.when(rank[j] < F.col("__step"), F.col("__own")[j])
                .otherwise(F.col("__path.from")[j]).cast(types[f]).alias(f)
                for j, f in enumerate(names)
            ],
        )
        return probabilities(mixed, model, "__p")

    scored = union_all([walked(paths[i:i + BLOCK_PATHS]) for i in range(0, len(paths), BLOCK_PATHS)])

    def credit(j: int) -> Column:
        at = F.col("__rank")[j]
        return F.sum(F.when(step == at + 1, p).when(step == at, -p).otherwise(0.0)) / n

    sums = scored.groupBy(key).agg(
        (F.sum(p * indicator(step == 0)) / n).alias("BASE_VALUE"),
        (F.sum(p * indicator(step == len(names))) / n).alias("PREDICTION"),
        F.any_value("__own").alias("__own"),
        *[credit(j).alias(f"__c{j}") for j in range(len(names))],
    )
    records = [
        _record(f, F.col("__own")[j], F.col(f"__c{j}")) for j, f in enumerate(names)
    ]
    return sums.select(key, "BASE_VALUE", "PREDICTION", F.array(*records).alias("CONTRIBUTIONS"))


def contribution_rows(contributions: DataFrame, key: str = "USUBJID") -> DataFrame:
    """One row per subject and feature."""
    return contributions.select(
        key, "BASE_VALUE", "PREDICTION", F.explode("CONTRIBUTIONS").alias("r")
    ).select(key, "BASE_VALUE", "PREDICTION", "r.*")


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature."""
    return (
        contribution_rows(contributions)
        .groupBy("FEATURE")
        .agg(F.avg(F.abs("CONTRIBUTION")).alias("MEAN_ABS"))
    )


def top_factors(
    contributions: DataFrame, k: int = 10, per_side: int = 5, digits: int = 4
) -> DataFrame:
    """Keep each subject's k largest contributions and split them into both directions.

    Contributions are compared after rounding; a tie keeps the feature order.
    """
    def sortable(record: Column, position: Column) -> Column:
        shown = F.round(record["CONTRIBUTION"], digits)
        return F.struct(
            (-F.abs(shown)).alias("size"), position.alias("position"),
            F.struct(
                record["FEATURE"].alias("FEATURE"), record["LABEL"].alias("LABEL"),
                record["VALUE"].alias("VALUE"), shown.alias("CONTRIBUTION"),
                record["DIRECTION"].alias("DIRECTION"),
            ).alias("record"),
        )

    largest = F.slice(F.array_sort(F.transform("CONTRIBUTIONS", sortable)), 1, k)

    def side(direction: str) -> Column:
        mine = F.filter(F.col("__top"), lambda r: r["record"]["DIRECTION"] == direction)
        return F.transform(F.slice(mine, 1, per_side), lambda r: r["record"])

    return (
        contributions.withColumn("__top", largest)
        .withColumns(
            {
                "TOP_RISK_FACTORS": side("increases_risk"),
                "TOP_PROTECTIVE_FACTORS": side("decreases_risk"),
            }
        )
        .drop("__top")
    )


def factor_rows(factors: DataFrame, key: str = "USUBJID") -> DataFrame:
    """One row per listed factor, with its side and rank."""
    both = F.array(
        F.struct(F.lit("risk").alias("SIDE"), F.col("TOP_RISK_FACTORS").alias("f")),
        F.struct(F.lit("protective").alias("SIDE"), F.col("TOP_PROTECTIVE_FACTORS").alias("f")),
    )
    sides = factors.select(key, F.explode(both).alias("s")).select(key, "s.SIDE", "s.f")
    return sides.select(key, "SIDE", F.posexplode("f").alias("__i", "r")).select(
        key, "SIDE", (F.col("__i") + 1).alias("RANK"), "r.*"
    )


def format_explanation(contributions: DataFrame, key: str = "USUBJID") -> DataFrame:
    """Nested record per subject: prediction, label, base value, top factors of both sides."""
    return top_factors(contributions).select(
        key,
        F.round("PREDICTION", 4).alias("PREDICTED_DROPOUT_PROBABILITY"),
        F.when(F.col("PREDICTION") >= 0.5, "Dropout").otherwise("Completed").alias("PREDICTION"),
        F.round("BASE_VALUE", 4).alias("BASE_VALUE"),
        F.struct("TOP_RISK_FACTORS", "TOP_PROTECTIVE_FACTORS").alias("EXPLANATION"),
    )

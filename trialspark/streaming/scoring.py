"""Scoring of arriving rows. Validation and scoring keep no state, so the batch operators are
used unchanged; this module only connects them to a source and a sink."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from trialspark.operators.rows import valid_rows, validate_ranges
from trialspark.operators.scoring import score, score_by_rule


def read_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def scored_stream(
    rows: DataFrame, model: PipelineModel | None = None, remote_sites=("107", "108")
) -> DataFrame:
    """Valid rows with their score; the additive rule is used without a model."""
    checked = valid_rows(validate_ranges(rows))
    return score(checked, model) if model is not None else score_by_rule(checked, remote_sites)


def write_scores(
    scored: DataFrame, folder: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append scores as Parquet. With ``available_now`` it stops after the present input."""
    writer = scored.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(folder)

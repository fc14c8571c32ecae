"""Datasets: reading with declared schemas, writing, lookup tables, registration."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

from trialspark import schema as S
from trialspark.functions import normalise_term
from trialspark.sources.csv_records import read_csv
from trialspark.sources.workspace import shared_folder  # noqa: F401

# Missing text is written as \\N and empty text as "", so both come back as they were; spaces at either end,
# quotes, backslashes and line breaks are kept.
CSV_FORMAT = {
    "header": True, "nullValue": "\\N", "escape": '"', "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

RISK_COLUMNS = [
    "USUBJID", "SITEID", "TRT01P", "AGE", "SEX", "AENUM", "AEMAXSEVN", "COMPLPCT",
    "DROPOUT_PROB", "RISK_TIER",
]


def read_domain(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None,
    whole_files: bool = False,
) -> DataFrame:
    """Typed dataset from CSV (with header; a schema is required) or Parquet.

    CSV is read as ``write_domain`` writes it; a value that does not fit its type is an error. Texts may hold line
    breaks, and many tasks read one file. That needs quotes to come in pairs, as in every file where texts with
    quotes are quoted; ``whole_files`` reads others, and files whose lines end by a carriage return alone, one task a file.
    """
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV dataset needs a declared schema")
        if not whole_files:
            return read_csv(spark, path, schema, CSV_FORMAT)
        reader = spark.read.options(**CSV_FORMAT, enforceSchema=False, multiLine=True, mode="FAILFAST")
        return reader.schema(schema).csv(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(fmt).load(path)


def write_domain(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> str:
    """Replace a dataset.

    For a partitioned dataset the rows are first rebalanced by the partition columns: adaptive
    execution then writes few files per value, and splits a value that holds many rows.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.options(**CSV_FORMAT, emptyValue='""')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def require_inputs(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, str]:
    """Check that every input can be opened; one error names all that cannot."""
    missing = []
    for name, path in paths.items():
        fmt = "csv" if path.lower().endswith(".csv") else "parquet"
        try:
            # Resolves the path only. Text needs no schema inference, so no job starts.
            (spark.read.text(path) if fmt == "csv" else spark.read.parquet(path)).schema
        except AnalysisException:
            missing.append(f"{name} ({path})")
    if missing:
        raise FileNotFoundError("missing datasets: " + ", ".join(missing))
    return dict(paths)


def export_risk_table(
    scored: DataFrame, folder: str, study: str, date: dt.date | None = None
) -> str:
    """Dated CSV export of the scored subjects, in ten fixed columns."""
    day = (date or dt.date.today()).isoformat()
    path = f"{folder.rstrip('/')}/{study.lower()}-risk-report-{day}.csv"
    return write_domain(scored.select(*RISK_COLUMNS), path, "csv")


def site_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        S.SITES, "SITEID string, COUNTRY string, REGION string, N_SUBJ int"
    )


TERM_KIND = T.StructType(
    [
        T.StructField("AEDECOD", T.StringType()), T.StructField("AEBODSYS", T.StringType()),
        T.StructField("BASE_PROB", T.DoubleType()), T.StructField("SEV_SEVERE_P", T.DoubleType()),
    ]
)


def term_entries() -> list[tuple]:
    """Event terms with blanks instead of underscores, as plain rows."""
    return [(a.replace("_", " "), b.replace("_", " "), p, q) for a, b, p, q in S.TERMS]


def term_dictionary(spark: SparkSession) -> DataFrame:
    """Event terms with blanks instead of underscores."""
    raw = spark.createDataFrame(S.TERMS, TERM_KIND)
    return raw.withColumns({c: normalise_term(raw[c]) for c in ("AEDECOD", "AEBODSYS")})


def register_domains(
    spark: SparkSession, domains: Mapping[str, DataFrame], prefix: str = ""
) -> list[str]:
    """Make datasets available to SQL under their names."""
    names = []
    for name, df in domains.items():
        view = f"{prefix}{name}".lower()
        df.createOrReplaceTempView(view)
        names.append(view)
    return names

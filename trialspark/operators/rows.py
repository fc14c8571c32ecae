"""Row-wise frame operators: filters, defaults, labels, expansion, orphan rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from trialspark import schema as S
from trialspark.functions import holds, iso_text, result_text, shift_days, visit_text

POPULATION_FLAGS = {"ITT": "ITTFL", "SAFETY": "SAFFL", "PP": "PPROTFL"}


def population(df: DataFrame, which: str = "ITT") -> DataFrame:
    """Rows whose population flag is 'Y'."""
    return df.filter(F.col(POPULATION_FLAGS[which]) == "Y")


def default_missing(df: DataFrame, defaults: Mapping) -> DataFrame:
    """Replace nulls by the given values; a column keeps its type."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in defaults.items()}
    )


def select_keep(df: DataFrame, keep: Sequence[str], rename: Mapping[str, str] | None = None):
    """Keep the listed columns, then rename some for display."""
    return df.select(*keep).withColumnsRenamed(dict(rename or {}))


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def with_constants(df: DataFrame, **constants) -> DataFrame:
    """Add literal identifier columns such as STUDYID and DOMAIN."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def attach_labels(df: DataFrame, labels: Mapping[str, str] = S.LABELS) -> DataFrame:
    """Store display labels as column metadata."""
    for name in df.columns:
        if name in labels:
            df = df.withMetadata(name, {"label": labels[name]})
    return df


def column_labels(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["label"] for f in df.schema.fields if "label" in f.metadata}


def optional_filters(df: DataFrame, choices: Mapping[str, object]) -> DataFrame:
    """Equality filters; a choice of None keeps every value."""
    for column, value in choices.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def filter_tiers(df: DataFrame, tiers: Sequence[str], column: str = "RISK_TIER") -> DataFrame:
    return df.filter(F.col(column).isin(*tiers))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null (or NaN) in the columns."""
    return df.dropna(subset=list(columns) if columns is not None else None)


def round_numeric(df: DataFrame, digits: int) -> DataFrame:
    """Round every fractional column."""
    fractional = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: F.round(F.col(c), digits) for c in fractional})


def validate_ranges(
    df: DataFrame, spec: Mapping[str, tuple] = S.SCORE_RANGES, reasons: str = "REASONS"
) -> DataFrame:
    """Fill defaults and list every range violation of a row in an array column.

    The array names each violated rule as ``<column> missing|low|high|fraction``; it is empty
    for a row that may be scored.
    """
    present = {f.name for f in df.schema.fields}
    rules: list[Column] = []
    filled = {}
    for name, (low, high, whole, default) in spec.items():
        value = F.col(name).cast("double") if name in present else F.lit(None).cast("double")
        if default is not None:
            value = F.coalesce(value, F.lit(float(default)))
        filled[name] = value
        rules.append(F.when(value.isNull(), f"{name} missing"))
        rules.append(F.when(value < low, f"{name} low"))
        rules.append(F.when(holds(value > high) | F.isnan(value), f"{name} high"))
        if whole:
            rules.append(F.when(value != F.floor(value), f"{name} fraction"))
    checked = df.withColumn(reasons, F.array_compact(F.array(*rules)))
    return checked.withColumns(filled)


def valid_rows(checked: DataFrame, reasons: str = "REASONS") -> DataFrame:
    return checked.filter(F.size(reasons) == 0).drop(reasons)


def rejected_rows(checked: DataFrame, reasons: str = "REASONS") -> DataFrame:
    return checked.filter(F.size(reasons) > 0)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key has no parent; a null key is an orphan.

    The parent keys are unique or made so, and adaptive execution splits a key with many children.
    """
    known = parent.select(F.col(key).alias("__parent")).distinct()
    return child.join(known, F.col(key) == F.col("__parent"), "left_anti")


def cross_with_dictionary(df: DataFrame, entries: Sequence[Sequence], kind: T.StructType) -> DataFrame:
    """Every row with every entry of a fixed list of terms.

    The entries are constants of the program; they are embedded as a literal array and exploded,
    so rows are multiplied in place without a join or a shuffle.
    """
    if not entries:
        return df.limit(0).withColumns({f.name: F.lit(None).cast(f.dataType) for f in kind})
    literal = F.array(
        *[
            F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind)])
            for row in entries
        ]
    )
    return df.withColumn("__entry", F.explode(literal)).select(
        *df.columns, *[F.col("__entry")[f.name].alias(f.name) for f in kind]
    )


def expand_visits(
    df: DataFrame, start: str, first: int = 1, last: int = 6, days: int = 28, prefix: str = "EX"
) -> DataFrame:
    """One row per scheduled visit.

    Treatment visits (first >= 1) cover the block of days before the visit; with a screening
    visit 0 the visit lies on day number x days and start and end coincide.
    """
    begin = F.try_to_date(F.col(start), "yyyy-MM-dd")
    n = F.col("VISITNUM")
    out = df.withColumn("VISITNUM", F.explode(F.sequence(F.lit(first), F.lit(last))))
    if first >= 1:
        opens, closes = shift_days(begin, (n - 1) * days), shift_days(begin, n * days - 1)
    else:
        opens = closes = shift_days(begin, n * days)
    return out.withColumns(
        {
            "VISIT": visit_text(n),
            f"{prefix}STDTC": iso_text(opens),
            f"{prefix}ENDTC": iso_text(closes),
        }
    )


def expand_tests(df: DataFrame, tests: Sequence[tuple[str, str, str, str, int]]) -> DataFrame:
    """Wide measurements to one row per test; a missing value has no text either.

    ``tests`` lists (code, name, unit, value column, decimals of the text result).
    """
    records = F.array(
        *[
            F.struct(
                F.lit(code).alias("VSTESTCD"),
                F.lit(name).alias("VSTEST"),
                F.lit(unit).alias("VSORRESU"),
                F.col(column).cast("double").alias("VSSTRESN"),
                result_text(F.col(column).cast("double"), decimals).alias("VSSTRESC"),
            )
            for code, name, unit, column, decimals in tests
        ]
    )
    values = {t[3] for t in tests}
    kept = [c for c in df.columns if c not in values]
    return df.withColumn("__test", F.explode(records)).select(*kept, "__test.*")

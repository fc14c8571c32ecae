"""Model input: feature frame, imputation, standardisation, dummy columns.

Each preparation step is fitted (a few numbers per column reach the driver) and then applied
as literals in a projection, so applying it never shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from trialspark import schema as S
from trialspark.functions import indicator
from trialspark.operators.quantiles import exact_median, median_of_counts, most_frequent
from trialspark.operators.reshape import pivot_long
from trialspark.operators.rows import complete_cases, population
from trialspark.sources.workspace import settle


def model_frame(
    adsl: DataFrame, features: Sequence[str] = S.FEATURES, keep_missing: bool = False
) -> DataFrame:
    """ITT subjects with key, features and 0/1 target; complete cases unless told otherwise."""
    frame = population(adsl, "ITT").select(
        "USUBJID", *features, indicator(F.col("DPTFL") == "Y").alias("DPTN")
    )
    return frame if keep_missing else complete_cases(frame, features)


def imputation_values(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """(FEATURE, FILL): exact median of numeric and most frequent of categorical columns."""
    medians = exact_median(pivot_long(df, [], numeric), ["FEATURE"], "VALUE", "FILL")
    modes = most_frequent(pivot_long(df, [], categorical), ["FEATURE"], "VALUE", "FILL")
    return medians.unionByName(modes)


def fold_imputation_values(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fold: str, folds: int
) -> dict[int | None, dict[str, float | None]]:
    """For each fold the fills of the rows outside it, and under None those of all rows; exact medians and modes.

    Values are counted once, per feature, value and fold; the counts outside a fold are all counts less its own.
    """
    def outside(columns: Sequence[str]) -> DataFrame:
        long = pivot_long(df, [fold], columns).filter(F.col("VALUE").isNotNull())
        own = [F.sum(indicator(F.col(fold) == k)).alias(f"n{k}") for k in range(folds)]
        counts = long.groupBy("FEATURE", "VALUE").agg(F.count(F.lit(1)).alias("all"), *own)
        parts = [F.struct(F.lit(k).alias("K"), (F.col("all") - F.col(f"n{k}")).cast("long").alias("N")) for k in range(folds)]
        parts.append(F.struct(F.lit(-1).alias("K"), F.col("all").cast("long").alias("N")))
        return settle(counts.select("FEATURE", "VALUE", F.explode(F.array(*parts)).alias("p")).select(
            "FEATURE", "VALUE", "p.K", "p.N").filter(F.col("N") > 0))

    medians = median_of_counts(outside(numeric), ["K", "FEATURE"], "FILL")
    most = F.min(F.struct((-F.col("N")).alias("n"), "VALUE"))
    modes = outside(categorical).groupBy("K", "FEATURE").agg(most["VALUE"].alias("FILL"))
    out: dict[int | None, dict[str, float | None]] = {k: {} for k in (None, *range(folds))}
    for r in medians.unionByName(modes).collect():  # a row per fold and feature
        out[None if r["K"] < 0 else r["K"]][r["FEATURE"]] = r["FILL"]
    return out


def impute(
    df: DataFrame,
    numeric: Sequence[str] = S.NUMERIC_FEATURES,
    categorical: Sequence[str] = S.CATEGORICAL_FEATURES,
    values: DataFrame | None = None,
) -> DataFrame:
    """Fill missing features with the fitted values (fitted on ``df`` unless given)."""
    fitted = values if values is not None else imputation_values(df, numeric, categorical)
    fills = {r["FEATURE"]: r["FILL"] for r in fitted.collect()}
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {
            c: F.coalesce(
                F.col(c).cast("double") if c in numeric else F.col(c),
                F.lit(v).cast("double" if c in numeric else types[c]),
            )
            for c, v in fills.items()
        }
    )


def standardisation(
    df: DataFrame, columns: Sequence[str], population_sd: bool = True
) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation per column, in one pass."""
    spread = F.stddev_pop if population_sd else F.stddev_samp
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[spread(c).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def standardise(
    df: DataFrame,
    columns: Sequence[str] = S.NUMERIC_FEATURES,
    population_sd: bool = True,
    fitted: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """(x - mean) / sd; a constant column becomes 0."""
    stats = fitted or standardisation(df, columns, population_sd)
    out = {}
    for c, (mean, sd) in stats.items():
        centred = F.col(c) - F.lit(mean)
        out[c] = centred / F.lit(sd) if sd else centred * 0.0
    return df.withColumns(out)


def levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted distinct non-null values of every column, from one distinct over (column, value).

    Each value becomes a literal and a column of the plan.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kinds = sorted({types[c] for c in columns})
    values = [f"v{k}" for k in range(len(kinds))]
    cells = [
        F.struct(
            F.lit(i).alias("at"),
            *[(F.col(c) if types[c] == k else F.lit(None).cast(k)).alias(v) for k, v in zip(kinds, values)],
        )
        for i, c in enumerate(columns)
    ]
    rows = df.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    rows = rows.where(" or ".join(f"{v} is not null" for v in values))  # not a number is a value
    out: dict[str, list] = {c: [] for c in columns}
    for r in rows.distinct().orderBy("at", *values).collect():
        c = columns[r["at"]]
        out[c].append(r[values[kinds.index(types[c])]])
    return out


def dummy_encode(
    df: DataFrame,
    columns: Sequence[str] = S.CATEGORICAL_FEATURES,
    fitted: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """0/1 columns ``<column>_<level>`` for every level but the first; null stays null."""
    known = fitted or levels(df, columns)
    new = {}
    for c, values in known.items():
        for v in values[1:]:
            new[f"{c}_{v}"] = F.when(F.col(c).isNotNull(), indicator(F.col(c) == F.lit(v)))
    return df.withColumns(new).drop(*known)

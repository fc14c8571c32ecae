"""Summary tables.

Shape of every plan: filter, one aggregation with partial aggregates before the shuffle, then
cheap work on the small result. Conditional distinct-subject counts first reduce to one row
per subject, which needs no row expansion and no large distinct set in any task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from trialspark.functions import indicator, iso_date, recode, treatment_emergent
from trialspark.operators.quantiles import median_of_counts, value_counts
from trialspark.operators.reshape import pivot_long, union_all
from trialspark.operators.skew import same
from trialspark.sources.workspace import settle


def _rate(flag: str = "DPTFL"):
    """Percent of rows with the flag, over all rows."""
    return F.avg(F.when(F.col(flag) == "Y", 100.0).otherwise(0.0))


def _dropouts(flag: str = "DPTFL"):
    return F.sum(indicator(F.col(flag) == "Y"))


def dropout_by_arm(adsl: DataFrame, by: Sequence[str] = ("TRT01PN", "TRT01P")) -> DataFrame:
    return (
        adsl.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("N_TOTAL"),
            _dropouts().alias("N_DROPOUT"),
            _rate().alias("PCT_DROPOUT"),
        )
        .orderBy(*by)
    )


def means_by_status(adsl: DataFrame, by: str = "DPTFL") -> DataFrame:
    return adsl.groupBy(by).agg(
        F.count(F.lit(1)).alias("N"),
        F.avg("COMPLPCT").alias("MEAN_COMPLIANCE"),
        F.avg("AENUM").alias("MEAN_AE_COUNT"),
        F.avg("AEMAXSEVN").alias("MEAN_MAX_SEV"),
    )


def site_summary(
    adsl: DataFrame, by: Sequence[str] = ("SITEID", "COUNTRY", "REGION"), target: float = 25.0
) -> DataFrame:
    """Per site: size, dropout, compliance, events, and whether dropout exceeds the target."""
    return (
        adsl.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("N_TOTAL"),
            _dropouts().alias("N_DROPOUT"),
            _rate().alias("PCT_DROPOUT"),
            F.avg("COMPLPCT").alias("MEAN_COMP"),
            F.avg("AENUM").alias("MEAN_AE"),
        )
        .withColumn("OVER_TARGET", F.when(F.col("PCT_DROPOUT") > target, "Y").otherwise("N"))
        .orderBy(F.desc("PCT_DROPOUT"), *by)
    )


def arm_denominators(adsl: DataFrame) -> DataFrame:
    return (
        adsl.filter(F.col("SAFFL") == "Y")
        .groupBy("TRT01PN", "TRT01P")
        .agg(F.count(F.lit(1)).alias("N_ARM"))
        .orderBy("TRT01PN")
    )


def _emergent(last: str):
    """Whether an event that started on the last known day, and so any event, is emergent.

    Emergence only asks for a start on or after the reference date, so the last start decides for all
    events of a subject, and events are reduced to one row per subject before they meet the subjects.
    """
    return treatment_emergent(F.date_format(F.col(last), "yyyy-MM-dd"), F.col("RFSTDTC")) == "Y"


def teae_overall(
    ae: DataFrame, adsl: DataFrame, arms: Mapping[int, str] = {0: "N_PLC", 1: "N_LOW", 2: "N_HIGH"}
) -> DataFrame:
    """Subjects with any, any serious and any dropout-related emergent event, by arm."""
    start = iso_date(F.col("AESTDTC"))
    last = ae.groupBy("USUBJID").agg(
        F.max(start).alias("__last"), F.max(F.when(F.col("AESER") == "Y", start)).alias("__serious")
    )
    joined = adsl.select("USUBJID", "TRT01PN", "DPTFL", "RFSTDTC").join(last, "USUBJID")
    categories = {
        "Any TEAE": _emergent("__last"),
        "Any Serious TEAE": _emergent("__serious"),
        "Any TEAE Leading to Dropout": _emergent("__last") & (F.col("DPTFL") == "Y"),
    }
    flags = [f"__f{i}" for i in range(len(categories))]
    subjects = joined.select(
        "TRT01PN", *[indicator(c).alias(f) for f, c in zip(flags, categories.values())]
    )
    any_arm = subjects.groupBy("TRT01PN").agg(*[F.sum(f).alias(f) for f in flags])
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("CATEGORY"), F.col(f).alias("__n"))
            for label, f in zip(categories, flags)
        ]
    )
    long = any_arm.select("TRT01PN", F.explode(rows).alias("r")).select("TRT01PN", "r.*")
    return long.groupBy("CATEGORY").agg(
        *[
            F.sum(F.when(F.col("TRT01PN") == a, F.col("__n")).otherwise(0)).alias(name)
            for a, name in arms.items()
        ],
        F.sum("__n").alias("N_TOTAL"),
    )


def teae_by_term(
    ae: DataFrame,
    adsl: DataFrame,
    min_n: int = 3,
    min_pct: float | None = None,
    denominators: DataFrame | None = None,
    arms: Mapping[int, str] = {0: "N_PLC", 1: "N_LOW", 2: "N_HIGH"},
) -> DataFrame:
    """Subjects per organ class, term and arm for terms frequent enough in some arm.

    The rule is a subject count in the largest arm, or with ``min_pct`` a percentage of the arm
    size taken from ``denominators`` (see arm_denominators).
    """
    last = ae.groupBy("USUBJID", "AEBODSYS", "AEDECOD").agg(
        F.max(iso_date(F.col("AESTDTC"))).alias("__last")
    )
    subjects = last.join(adsl.select("USUBJID", "TRT01PN", "RFSTDTC"), "USUBJID").filter(
        _emergent("__last")
    )
    table = subjects.groupBy("AEBODSYS", "AEDECOD").agg(
        *[F.sum(indicator(F.col("TRT01PN") == a)).alias(name) for a, name in arms.items()],
        F.count(F.lit(1)).alias("N_TOTAL"),
    )
    if min_pct is None:
        frequent = F.greatest(*arms.values()) >= min_n
    else:
        frequent = F.lit(False)
        for a, name in arms.items():
            size = denominators.filter(F.col("TRT01PN") == a).agg(F.sum("N_ARM")).scalar()
            frequent = frequent | (F.col(name) * 100.0 >= size * F.lit(float(min_pct)))
    return table.filter(frequent).orderBy("AEBODSYS", F.desc("N_TOTAL"), "AEDECOD")


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Two-way counts with overall, row and column percentages; null levels are left out."""
    cells = settle(
        df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(row, column)
        .agg(F.count(F.lit(1)).alias("N"))
    )

    share = F.col("N") * 100.0

    def within(level: str):
        return share / F.sum("N").over(Window.partitionBy(level))

    # The total is one number, not a window that would bring all cells into one task.
    whole = cells.agg(F.sum("N").alias("n")).scalar()
    return cells.select(
        row, column, "N", (share / whole).alias("PCT"), within(row).alias("PCT_ROW"),
        within(column).alias("PCT_COL"),
    )


def continuous_summary(
    df: DataFrame, variables: Sequence[str], arm: str = "TRT01P", overall: str = "All"
) -> DataFrame:
    """N, mean, SD, median, minimum and maximum per variable, by arm and overall.

    OVERALL tells the rows of all arms together ('Y') from an arm that happens to have their label; a
    missing arm is a row of its own. The subjects are read once, to count rows per variable, arm and value; every statistic
    comes from these counts.
    """
    by_arm = value_counts(
        pivot_long(df, [arm], variables, "VARIABLE", "__x"), ["VARIABLE", arm], "__x"
    )
    x, n = F.col("VALUE"), F.col("N")
    both = by_arm.select(
        "VARIABLE", F.lit("N").alias("OVERALL"), F.col(arm).cast("string").alias("ARM"), "VALUE", "N"
    ).union(by_arm.groupBy("VARIABLE", F.lit("Y"), F.lit(overall), "VALUE").agg(F.sum("N")))
    # Squares are taken around the mean of the variable, which keeps the difference exact enough.
    centres = {
        r["VARIABLE"]: r["c"]
        for r in by_arm.groupBy("VARIABLE").agg((F.sum(x * n) / F.sum(n)).alias("c")).collect()
    }
    gap = x - recode(F.col("VARIABLE"), centres, 0.0)
    size, first, second = F.sum(n), F.sum(gap * n), F.sum(gap * gap * n)
    spread = F.when(size > 1, F.greatest(second - first * first / size, F.lit(0.0)) / (size - 1))
    cell = ["VARIABLE", "OVERALL", "ARM"]
    stats = both.groupBy(*cell).agg(
        (F.sum(x * n) / size).alias("MEAN"), F.sqrt(spread).alias("SD"),
        F.min(x).alias("MIN"), F.max(x).alias("MAX"), size.alias("N"),
    )
    medians = median_of_counts(both, cell).withColumnsRenamed({c: "__m_" + c for c in cell})
    return stats.join(medians, same(cell, "__m_"), "left").select(
        *cell, "N", "MEAN", "SD", "MEDIAN", "MIN", "MAX"
    )


def categorical_summary(
    df: DataFrame, variables: Sequence[str], arm: str = "TRT01P"
) -> DataFrame:
    """N per level and arm, percent of the level (row) and of the arm (column).

    Rows with any missing class variable are left out of the whole table.
    """
    complete = df.select(arm, *variables).dropna()
    cells = (
        pivot_long(complete, [arm], variables, "VARIABLE", "LEVEL", "string")
        .groupBy("VARIABLE", "LEVEL", arm)
        .agg(F.count(F.lit(1)).alias("N"))
    )

    def percent(within: str):
        return F.col("N") * 100.0 / F.sum("N").over(Window.partitionBy("VARIABLE", within))

    return cells.select(
        "VARIABLE", "LEVEL", arm, "N", percent("LEVEL").alias("PCT_ROW"), percent(arm).alias("PCT_COL")
    )


def site_distribution(
    df: DataFrame, arms: Mapping[int, str] = {0: "N_PLC", 1: "N_LOW", 2: "N_HIGH"}
) -> DataFrame:
    """Subjects per site and country, one column per arm."""
    return df.groupBy("SITEID", "COUNTRY").agg(
        *[F.sum(indicator(F.col("TRT01PN") == a)).alias(name) for a, name in arms.items()]
    )


def dropout_reasons(adsl: DataFrame) -> DataFrame:
    return (
        adsl.filter(F.col("DPTFL") == "Y")
        .groupBy("TRT01P", "TRT01PN", "DSDECOD")
        .agg(F.count(F.lit(1)).alias("N"))
    )


def kpis(adsl: DataFrame) -> DataFrame:
    return adsl.agg(
        F.count(F.lit(1)).alias("N_SUBJECTS"),
        _rate().alias("PCT_DROPOUT"),
        F.avg("COMPLPCT").alias("MEAN_COMPLIANCE"),
        F.avg("AENUM").alias("MEAN_AE"),
    )


def demographics_by_arm(adsl: DataFrame) -> DataFrame:
    return adsl.groupBy("TRT01P").agg(
        F.count(F.lit(1)).alias("N"),
        F.avg("AGE").alias("AGE_MEAN"),
        F.stddev_samp("AGE").alias("AGE_SD"),
        F.avg(F.when(F.col("SEX") == "F", 100.0).otherwise(0.0)).alias("PCT_FEMALE"),
        F.avg("DAS28BL").alias("DAS28_MEAN"),
        F.avg("BMIBL").alias("BMI_MEAN"),
    )


def histogram(
    df: DataFrame, value: str, group: str, width: float = 5.0, threshold: float = 80.0
) -> DataFrame:
    """Counts in right-closed bins centred on multiples of the width, and how many are low."""
    x = F.col(value)
    half = width / 2
    centre = F.ceil((x - half) / width).cast("double") * width
    return (
        df.filter(x.isNotNull())
        .groupBy(F.col(group), centre.alias("BIN"))
        .agg(F.count(F.lit(1)).alias("N"), F.sum(indicator(x < threshold)).alias("N_BELOW"))
    )


def arm_by_status(adsl: DataFrame, arm: str = "TRT01P") -> DataFrame:
    """Completed and dropped-out subjects per arm, with dropout percentage."""
    wide = adsl.groupBy(arm).pivot("DPTFL", ["N", "Y"]).count().fillna(0, ["N", "Y"])
    return wide.withColumn(
        "PCT_DROPOUT", F.try_divide(F.col("Y") * 100.0, F.col("Y") + F.col("N"))
    )


def dm_summary(dm: DataFrame) -> DataFrame:
    """Distinct subjects and rows per arm, in one row."""
    subjects = dm.groupBy("USUBJID").agg(
        *[F.sum(indicator(F.col("TRT01PN") == a)).alias(f"__{a}") for a in (0, 1, 2)]
    )
    return subjects.agg(
        F.count("USUBJID").alias("N_SUBJECTS"),
        F.sum("__0").alias("N_PLACEBO"),
        F.sum("__1").alias("N_LOW_DOSE"),
        F.sum("__2").alias("N_HIGH_DOSE"),
    ).select(F.lit("DM").alias("DOMAIN"), "*")


def disposition_frequency(ds: DataFrame) -> DataFrame:
    return ds.groupBy("DSDECOD").agg(F.count(F.lit(1)).alias("N")).orderBy(F.desc("N"), "DSDECOD")


def batch_risk_summary(
    scored: DataFrame, probability: str = "DROPOUT_PROB", tier: str = "RISK_TIER"
) -> DataFrame:
    def tiers(label: str):
        return F.sum(indicator(F.col(tier) == label))

    return scored.agg(
        F.count(F.lit(1)).alias("N_PATIENTS"),
        tiers("High Risk").alias("N_HIGH_RISK"),
        tiers("Moderate Risk").alias("N_MODERATE_RISK"),
        tiers("Low Risk").alias("N_LOW_RISK"),
        F.avg(probability).alias("MEAN_DROPOUT_PROB"),
    )


def mean_prediction(scored: DataFrame, probability: str = "DROPOUT_PROB") -> DataFrame:
    return scored.agg(F.avg(probability).alias("BASELINE_PROB"))


def distinct_values(
    df: DataFrame, columns: Sequence[str] = ("SITEID", "TRT01P", "REGION")
) -> DataFrame:
    """Sorted distinct values of several columns, in one pass."""
    return (
        pivot_long(df, [], columns, "FILTER", "VALUE", "string")
        .filter(F.col("VALUE").isNotNull())
        .distinct()
        .orderBy("FILTER", "VALUE")
    )


def dataset_profile(df: DataFrame, flag: str = "DPTFL") -> DataFrame:
    """Rows, percent flagged, and the column list, in one row."""
    return df.agg(F.count(F.lit(1)).alias("N_SUBJECTS"), _rate(flag).alias("FLAG_RATE")).withColumn(
        "COLUMNS", F.lit(",".join(df.columns))
    )


def dataset_inventory(datasets: Mapping[str, DataFrame], texts: Mapping[str, str]) -> DataFrame:
    """One row per dataset: name, description, records."""
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("RECORDS")).select(
                F.lit(name).alias("DATASET"), F.lit(texts.get(name, name)).alias("DOMAIN"), "RECORDS"
            )
            for name, df in datasets.items()
        ]
    )

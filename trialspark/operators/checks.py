"""Data-conformance checks.

A check is a column expression that counts issues. All checks on one table are evaluated in a
single aggregation over it (``fold``); checks that need grouping or a second table aggregate
first and return their own one-row count. Each result is a row of the validation log.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialspark import schema as S
from trialspark.functions import (
    differs, indicator, iso_date, not_before, not_in_set, outside,
)
from trialspark.operators.reshape import union_all


@dataclass(frozen=True)
class Check:
    """Identity and wording of a check; ``{n}`` in a text stands for the number of issues."""

    id: str
    domain: str
    name: str
    passed: str
    failed: str
    warn: bool = False
    tolerance: int = 0


def _sentence(template: str, n: Column) -> Column:
    parts = template.split("{n}")
    pieces = [F.lit(parts[0])]
    for part in parts[1:]:
        pieces += [n.cast("string"), F.lit(part)]
    return F.concat(*pieces)


def _log_struct(check: Check, n: Column) -> Column:
    good = n <= check.tolerance
    return F.struct(
        F.lit(check.id).alias("CHECK_ID"),
        F.lit(check.domain).alias("DOMAIN"),
        F.lit(check.name).alias("CHECK_NAME"),
        F.when(good, "PASS").otherwise("WARN" if check.warn else "FAIL").alias("STATUS"),
        n.alias("N_ISSUES"),
        F.when(good, _sentence(check.passed, n))
        .otherwise(_sentence(check.failed, n))
        .alias("DETAILS"),
    )


def check_row(check: Check, counted: DataFrame, n: str = "N_ISSUES") -> DataFrame:
    """Log row of a one-row frame holding the number of issues."""
    count = F.coalesce(F.col(n), F.lit(0)).cast("long")
    return counted.select(_log_struct(check, count).alias("r")).select("r.*")


def fold(df: DataFrame, checks: Sequence[tuple[Check, Column]]) -> DataFrame:
    """Evaluate several row-level checks in one pass; one log row per check."""
    counts = df.agg(*[F.sum(indicator(bad)).alias(f"__n{i}") for i, (_, bad) in enumerate(checks)])
    rows = [
        _log_struct(check, F.coalesce(F.col(f"__n{i}"), F.lit(0)).cast("long"))
        for i, (check, _) in enumerate(checks)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# Row-level predicates: true for an issue.


def bad_id_format(column: str, pattern: str) -> Column:
    return F.coalesce(~F.trim(F.col(column).cast("string")).rlike(pattern), F.lit(True))


def flag_clash(flag: str = "DPTFL", term: str = "DSDECOD", completed: str = "COMPLETED") -> Column:
    done = F.col(term).eqNullSafe(F.lit(completed))
    return (F.col(flag).eqNullSafe("Y") & done) | (
        F.col(flag).eqNullSafe("N") & differs(F.col(term), completed)
    )


def bad_date_order(start: str = "RFSTDTC", end: str = "RFENDTC") -> Column:
    return not_before(iso_date(F.col(start)), iso_date(F.col(end)))


def bad_value(column: str, allowed: Sequence) -> Column:
    return not_in_set(F.col(column), allowed)


def bad_flags(columns: Sequence[str]) -> Column:
    bad = F.lit(False)
    for c in columns:
        bad = bad | not_in_set(F.col(c), ["Y", "N"])
    return bad


def bad_range(column: str, low, high) -> Column:
    return outside(F.col(column), low, high)


# Ids, datasets and names of the checks. The sentences are the library's own.

ID_FORMAT = Check(
    "CHK-01", "DM", "USUBJID format conforms to STUDYID-SITEID-SUBJID",
    "every identifier has the agreed form", "{n} identifiers differ from the agreed form",
)
REQUIRED = Check(
    "CHK-02", "DM", "Required DM SDTM variables present",
    "no required column is absent", "absent columns: ",
)
UNIQUE = Check(
    "CHK-03", "ADSL", "One record per subject (no duplicates)",
    "each subject stands once", "{n} rows repeat a subject",
)
FLAG = Check(
    "CHK-04", "ADSL", "DPTFL consistent with DSDECOD",
    "dropout flags and reasons agree", "{n} rows have a dropout flag against their reason",
)
DATES = Check(
    "CHK-05", "ADSL", "RFSTDTC before RFENDTC for all subjects",
    "each start lies before its end", "{n} rows have no start before their end",
)
SEVERITY = Check(
    "CHK-06", "AE", "AESEV within CDISC controlled terminology",
    "each severity is a listed one", "{n} rows have a severity that is not listed",
)
BALANCE = Check(
    "CHK-07", "ADSL", "Treatment arm balance (max imbalance <= 5)",
    "largest and smallest arm differ by {n}", "largest and smallest arm differ by {n}, more than allowed",
    warn=True, tolerance=5,
)
FLAGS = Check(
    "CHK-08", "ADSL", "SAFFL and ITTFL flags valid (Y or N)",
    "each population flag is Y or N", "{n} rows have another population flag than Y or N",
)
RANGE = Check(
    "CHK-09", "ADSL", "Compliance percentage in valid range [0-100]",
    "each compliance lies from 0 to 100", "{n} rows have a compliance below 0 or above 100",
)
REFERENTIAL = Check(
    "CHK-10", "AE", "All AE records link to valid DM subjects",
    "each event has its subject", "{n} events have no subject",
)


def check_id_format(
    df: DataFrame, pattern: str, column: str = "USUBJID", check: Check = ID_FORMAT
) -> DataFrame:
    return fold(df, [(check, bad_id_format(column, pattern))])


def check_required_columns(
    spark: SparkSession,
    df: DataFrame,
    required: Sequence[str] = S.DM_REQUIRED,
    check: Check = REQUIRED,
) -> DataFrame:
    """Required columns present; the details list the missing ones. Reads the schema only."""
    present = {c.upper() for c in df.columns}
    missing = [c for c in required if c.upper() not in present]
    details = check.failed + " ".join(missing) if missing else check.passed
    row = (
        check.id, check.domain, check.name, "FAIL" if missing else "PASS", len(missing), details,
    )
    return spark.createDataFrame([row], S.VALIDATION_LOG)


def check_unique(df: DataFrame, key: str = "USUBJID", check: Check = UNIQUE) -> DataFrame:
    """Rows beyond the first of each key; rows without a key all count."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    extra = F.when(F.col(key).isNull(), F.col("__n")).otherwise(F.col("__n") - 1)
    return check_row(check, sizes.agg(F.sum(extra).alias("N_ISSUES")))


def check_flag_consistency(adsl: DataFrame, check: Check = FLAG) -> DataFrame:
    return fold(adsl, [(check, flag_clash())])


def check_date_order(adsl: DataFrame, check: Check = DATES) -> DataFrame:
    return fold(adsl, [(check, bad_date_order())])


def check_in_set(
    df: DataFrame, column: str = "AESEV", allowed=S.SEVERITIES, check: Check = SEVERITY
) -> DataFrame:
    return fold(df, [(check, bad_value(column, allowed))])


def check_arm_balance(adsl: DataFrame, arm: str = "TRT01PN", check: Check = BALANCE) -> DataFrame:
    sizes = adsl.groupBy(arm).agg(F.count(F.lit(1)).alias("__n"))
    return check_row(check, sizes.agg((F.max("__n") - F.min("__n")).alias("N_ISSUES")))


def check_flags_valid(
    adsl: DataFrame, columns: Sequence[str] = ("SAFFL", "ITTFL"), check: Check = FLAGS
) -> DataFrame:
    return fold(adsl, [(check, bad_flags(columns))])


def check_range(
    adsl: DataFrame, column: str = "COMPLPCT", low=0, high=100, check: Check = RANGE
) -> DataFrame:
    return fold(adsl, [(check, bad_range(column, low, high))])


def check_referential(
    child: DataFrame, parent: DataFrame, key: str = "USUBJID", check: Check = REFERENTIAL
) -> DataFrame:
    """Child rows without a parent, counted per key first so that only keys are joined."""
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    lost = per_key.join(parent.select(key), key, "left_anti")
    return check_row(check, lost.agg(F.sum("__n").alias("N_ISSUES")))


def validation_suite(
    spark: SparkSession,
    dm: DataFrame,
    ae: DataFrame,
    adsl: DataFrame,
    id_pattern: str,
    id_column: str = "USUBJID",
) -> DataFrame:
    """All ten checks. Row-level checks on ADSL share one pass over it."""
    return union_all(
        [
            check_id_format(dm, id_pattern, id_column),
            check_required_columns(spark, dm),
            check_unique(adsl),
            fold(
                adsl,
                [
                    (FLAG, flag_clash()),
                    (DATES, bad_date_order()),
                    (FLAGS, bad_flags(["SAFFL", "ITTFL"])),
                    (RANGE, bad_range("COMPLPCT", 0, 100)),
                ],
            ),
            check_in_set(ae),
            check_arm_balance(adsl),
            check_referential(ae, dm),
        ]
    )


def validation_rollup(log: DataFrame, adsl: DataFrame, ae: DataFrame) -> DataFrame:
    """Checks by status, with subject, event and dropout counts, in one row."""
    subjects = adsl.agg(
        F.count(F.lit(1)).alias("n"), F.sum(indicator(F.col("DPTFL") == "Y")).alias("d")
    )
    status = F.col("STATUS")
    return log.agg(
        F.sum(indicator(status == "PASS")).alias("N_PASS"),
        F.sum(indicator(status == "FAIL")).alias("N_FAIL"),
        F.sum(indicator(status == "WARN")).alias("N_WARN"),
    ).withColumns(
        {
            "N_SUBJ": subjects.select("n").scalar(),
            "N_DROPOUT": subjects.select("d").scalar(),
            "N_AE": ae.agg(F.count(F.lit(1))).scalar(),
        }
    )

"""Subject-level and event-level analysis datasets.

Every feature table is aggregated to one row per subject before it meets the subject table,
with partial aggregation ahead of the shuffle; the joins then reuse that partitioning. A
feature table whose columns are not used by a query is removed from the plan by the
optimizer, because it is unique on the join key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trialspark import schema as S
from trialspark.functions import (
    band, compliance_flag, indicator, recode, response_flag, severity_code, severity_text,
    treatment_emergent,
)
from trialspark.operators.rows import default_missing


def ae_burden(
    ae: DataFrame,
    subject: str = "USUBJID",
    alt_terms: Sequence[str] = S.ALT_TERMS,
    neuro_gi_terms: Sequence[str] = S.NEURO_GI_TERMS,
) -> DataFrame:
    """Per subject: events, serious events, highest severity, two term counters."""
    worst = F.max(severity_code(F.col("AESEV")))
    return (
        ae.groupBy(subject)
        .agg(
            F.count(F.lit(1)).alias("AENUM"),
            F.sum(indicator(F.col("AESER") == "Y")).alias("AESNUM"),
            worst.alias("AEMAXSEVN"),
            F.sum(indicator(F.col("AEDECOD").isin(*alt_terms))).alias("N_ALT_AE"),
            F.sum(indicator(F.col("AEDECOD").isin(*neuro_gi_terms))).alias("N_NEURO_GI_AE"),
        )
        .withColumn("AEMAXSEV", severity_text(F.col("AEMAXSEVN")))
    )


def ex_compliance(ex: DataFrame, subject: str = "USUBJID") -> DataFrame:
    """Per subject: percent of doses taken (missing records count as not taken), doses missed."""
    taken = F.sum(indicator(F.col("EXOCCUR") == "Y"))
    return ex.groupBy(subject).agg(
        (taken / F.count(F.lit(1)) * F.lit(100.0)).alias("COMPLPCT"),
        F.sum(indicator(F.col("EXOCCUR") == "N")).alias("N_MISSED_DOSES"),
    )


def baseline_last_change(
    vs: DataFrame, test: str = "DAS28", subject: str = "USUBJID", threshold: float = -1.2
) -> DataFrame:
    """Per subject: baseline (visit 0) and last value of a test, change, response flag.

    Repeated records of one visit are averaged. Subjects without a baseline record drop out;
    a record with a null value keeps the subject, with a null change.
    """
    visits = (
        vs.filter(F.col("VSTESTCD") == test)
        .groupBy(subject, "VISITNUM")
        .agg(F.avg("VSSTRESN").alias("__value"))
    )
    at_baseline = F.col("VISITNUM") == 0
    return (
        visits.groupBy(subject)
        .agg(
            F.max(at_baseline).alias("__has_baseline"),
            F.max(F.when(at_baseline, F.col("__value"))).alias("DAS28BL"),
            F.max(F.struct("VISITNUM", "__value"))["__value"].alias("DAS28LAST"),
        )
        .filter("__has_baseline")
        .drop("__has_baseline")
        .withColumn("DAS28CHG", F.col("DAS28LAST") - F.col("DAS28BL"))
        .withColumn("ACR20FL", response_flag(F.col("DAS28CHG"), threshold))
    )


def attach_summaries(dm: DataFrame, burden: DataFrame, compliance: DataFrame) -> DataFrame:
    """Subjects with event burden and compliance, defaults where a subject has no records."""
    joined = dm.join(burden, "USUBJID", "left").join(compliance, "USUBJID", "left")
    return default_missing(joined, {"AENUM": 0, "AESNUM": 0, "AEMAXSEVN": 0, "COMPLPCT": 100.0})


def build_adsl(
    dm: DataFrame,
    ds: DataFrame,
    ae: DataFrame,
    ex: DataFrame,
    vs: DataFrame,
    alt_terms: Sequence[str] = S.ALT_TERMS,
    neuro_gi_terms: Sequence[str] = S.NEURO_GI_TERMS,
    region_code: dict = S.REGION_CODE,
) -> DataFrame:
    """One row per subject with every subject-level variable."""
    disposition = ds.select("USUBJID", "DSDECOD", "EOSSTT", "DPTFL", F.col("DSSTDTC").alias("DCDT"))
    change = baseline_last_change(vs).select("USUBJID", "DAS28CHG", "ACR20FL")
    joined = (
        dm.join(disposition, "USUBJID", "left")
        .join(ae_burden(ae, "USUBJID", alt_terms, neuro_gi_terms), "USUBJID", "left")
        .join(ex_compliance(ex), "USUBJID", "left")
        .join(change, "USUBJID", "left")
    )
    filled = default_missing(
        joined,
        {
            "AENUM": 0, "AESNUM": 0, "AEMAXSEVN": 0, "AEMAXSEV": "NONE", "N_ALT_AE": 0,
            "N_NEURO_GI_AE": 0, "COMPLPCT": 100.0, "N_MISSED_DOSES": 0, "DAS28CHG": 0.0,
            "ACR20FL": "UNKNOWN",
        },
    )
    derived = filled.withColumns(
        {
            "DATASET": F.lit("ADSL"),
            "SEXN": recode(F.col("SEX"), S.SEX_CODE, S.SEX_CODE_OTHER),
            "RACEN": recode(F.col("RACE"), S.RACE_CODE, S.RACE_CODE_OTHER),
            "REGIONN": recode(F.col("REGION"), region_code, S.REGION_CODE_OTHER),
            "BMIGRP": band(F.col("BMIBL"), *S.BMI_BANDS),
            "DAS28BL": F.col("DASCR"),
            "DAS28GRP": F.col("DASGRP"),
            "COMPLFL": compliance_flag(F.col("COMPLPCT")),
            "DPTN": indicator(F.col("DPTFL") == "Y"),
        }
    )
    return derived.select(*S.ADSL.fieldNames())


def build_adae(ae: DataFrame, adsl: DataFrame) -> DataFrame:
    """One row per event of a known subject, with subject columns and derived flags.

    A plain join on the subject: adaptive execution splits subjects with very many events.
    """
    subject = adsl.select(
        "USUBJID", "SITEID", "TRT01P", "TRT01PN", "AGE", "SEX", "DPTFL",
        F.col("RFSTDTC").alias("__rfst"),
    )
    out = ae.drop("SITEID").join(subject, "USUBJID").withColumns(
        {
            "DATASET": F.lit("ADAE"),
            "AESEVN": severity_code(F.col("AESEV")),
            "TRTEMFL": treatment_emergent(F.col("AESTDTC"), F.col("__rfst")),
        }
    )
    return out.select(*S.ADAE.fieldNames())

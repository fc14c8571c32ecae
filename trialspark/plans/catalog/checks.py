"""Data-conformance checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialspark import schema as S
from trialspark.functions import build_usubjid
from trialspark.operators import checks as H
from trialspark.plans.catalog.registry import query
from trialspark.plans.order_trial import STUDY, OrderTrial
from trialspark.sources.workspace import settle

ID_PATTERN = r"^TRIAL-01-\d{1,2}-\d{3}$"


def _log(check: H.Check, issues: str, source: str = "") -> str:
    """SQL of a log row, from the SQL counting its issues."""
    def sentence(text: str) -> str:
        return "'" + text.replace("{n}", "' || n || '") + "'"

    bad = "WARN" if check.warn else "FAIL"
    good = f"n <= {check.tolerance}"
    return f"""SELECT '{check.id}' AS CHECK_ID, '{check.domain}' AS DOMAIN, '{check.name}' AS CHECK_NAME,
    CASE WHEN {good} THEN 'PASS' ELSE '{bad}' END AS STATUS, n AS N_ISSUES,
    CASE WHEN {good} THEN {sentence(check.passed)} ELSE {sentence(check.failed)} END AS DETAILS
    FROM (SELECT CAST(coalesce(({issues}), 0) AS BIGINT) AS n)"""


PRINTED_ID = "'TRIAL-01-' || SITEID || '-' || SUBJID"
BAD_ID = f"SELECT count(*) FROM dm WHERE NOT regexp_matches(trim({PRINTED_ID}), '{ID_PATTERN}')"
CLASH = """SELECT count(*) FROM adsl WHERE (DPTFL = 'Y' AND DSDECOD = 'COMPLETED')
  OR (DPTFL = 'N' AND DSDECOD IS DISTINCT FROM 'COMPLETED')"""
DATES = """SELECT count(*) FROM adsl WHERE RFENDTC IS NULL
  OR (RFSTDTC IS NOT NULL AND CAST(RFSTDTC AS DATE) >= CAST(RFENDTC AS DATE))"""
FLAGS = """SELECT count(*) FROM adsl WHERE coalesce(SAFFL NOT IN ('Y', 'N'), true)
  OR coalesce(ITTFL NOT IN ('Y', 'N'), true)"""
RANGE = "SELECT count(*) FROM adsl WHERE coalesce(NOT COMPLPCT BETWEEN 0 AND 100, true)"
UNIQUE = "SELECT count(*) - count(DISTINCT USUBJID) FROM adsl"
SEVERITY = "SELECT count(*) FROM ae WHERE coalesce(AESEV NOT IN ('MILD', 'MODERATE', 'SEVERE'), true)"
BALANCE = "SELECT max(n) - min(n) FROM (SELECT TRT01PN, count(*) AS n FROM adsl GROUP BY TRT01PN)"
LINKED = "SELECT count(*) FROM ae WHERE USUBJID NOT IN (SELECT USUBJID FROM dm)"


def _with_printed_id(t: OrderTrial) -> DataFrame:
    return t.dm.withColumn(
        "PRINTED_ID", build_usubjid(STUDY, F.col("SITEID"), F.col("SUBJID").cast("int"))
    )


STRICT = H.Check("EX-01", "EX", "Doses by site", "none above {n}", "{n} doses out of range", True, 2)


@query(
    "check_row",
    _log(STRICT, "SELECT count(*) FROM ex WHERE EXOCCUR = 'N'"),
)
def check_row(t: OrderTrial) -> DataFrame:
    """Log row of missed doses, warning above two."""
    missed = t.ex.filter(F.col("EXOCCUR") == "N").agg(F.count(F.lit(1)).alias("N_ISSUES"))
    return H.check_row(STRICT, missed)


@query("check_id_format", _log(H.ID_FORMAT, BAD_ID))
def check_id_format(t: OrderTrial) -> DataFrame:
    return H.check_id_format(_with_printed_id(t), ID_PATTERN, "PRINTED_ID")


def _absent(columns: list[str]) -> str:
    missing = [c for c in S.DM_REQUIRED if c.upper() not in {x.upper() for x in columns}]
    return f"""SELECT '{H.REQUIRED.id}', '{H.REQUIRED.domain}', '{H.REQUIRED.name}', 'FAIL',
    CAST({len(missing)} AS BIGINT), '{H.REQUIRED.failed}{" ".join(missing)}'"""


@query(
    "check_required_columns",
    f"""SELECT '{H.REQUIRED.id}' AS CHECK_ID, '{H.REQUIRED.domain}' AS DOMAIN, '{H.REQUIRED.name}' AS CHECK_NAME,
    'PASS' AS STATUS, CAST(0 AS BIGINT) AS N_ISSUES, '{H.REQUIRED.passed}' AS DETAILS UNION ALL
    {_absent(["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])}""",
)
def check_required_columns(t: OrderTrial) -> DataFrame:
    """Required columns of demographics and of the raw customer table."""
    return H.check_required_columns(t.spark, t.dm).unionByName(
        H.check_required_columns(t.spark, t.table("customer"))
    )


@query(
    "check_unique",
    _log(H.UNIQUE, UNIQUE)
    + " UNION ALL "
    + _log(H.UNIQUE, "SELECT count(*) - count(DISTINCT USUBJID) FROM ex"),
)
def check_unique(t: OrderTrial) -> DataFrame:
    """Subjects are unique in ADSL and repeat in exposure."""
    return H.check_unique(t.adsl).unionByName(H.check_unique(t.ex))


@query("check_flag_consistency", _log(H.FLAG, CLASH))
def check_flag_consistency(t: OrderTrial) -> DataFrame:
    return H.check_flag_consistency(t.adsl)


@query("check_date_order", _log(H.DATES, DATES))
def check_date_order(t: OrderTrial) -> DataFrame:
    return H.check_date_order(t.adsl)


@query(
    "check_in_set",
    _log(H.SEVERITY, SEVERITY)
    + " UNION ALL "
    + _log(H.SEVERITY, "SELECT count(*) FROM ae WHERE coalesce(AESEV NOT IN ('MILD', 'MODERATE'), true)"),
)
def check_in_set(t: OrderTrial) -> DataFrame:
    """Against the full list of severities, and against a list without SEVERE."""
    return H.check_in_set(t.ae).unionByName(H.check_in_set(t.ae, allowed=["MILD", "MODERATE"]))


@query("check_arm_balance", _log(H.BALANCE, BALANCE))
def check_arm_balance(t: OrderTrial) -> DataFrame:
    return H.check_arm_balance(t.adsl)


@query("check_flags_valid", _log(H.FLAGS, FLAGS))
def check_flags_valid(t: OrderTrial) -> DataFrame:
    return H.check_flags_valid(t.adsl)


@query(
    "check_range",
    _log(H.RANGE, RANGE)
    + " UNION ALL "
    + _log(H.RANGE, "SELECT count(*) FROM adsl WHERE coalesce(NOT DAS28BL BETWEEN 3 AND 7, true)"),
)
def check_range(t: OrderTrial) -> DataFrame:
    """Compliance, and a baseline score that is sometimes missing."""
    return H.check_range(t.adsl).unionByName(H.check_range(t.adsl, "DAS28BL", 3, 7))


@query(
    "check_referential",
    _log(H.REFERENTIAL, LINKED)
    + " UNION ALL "
    + _log(H.REFERENTIAL, "SELECT count(*) FROM ae WHERE USUBJID NOT IN (SELECT USUBJID FROM dm WHERE ITTFL = 'Y')"),
)
def check_referential(t: OrderTrial) -> DataFrame:
    """Events against all subjects, and against the ITT subjects only."""
    itt = t.dm.filter(F.col("ITTFL") == "Y")
    return H.check_referential(t.ae, t.dm).unionByName(H.check_referential(t.ae, itt))


REQUIRED_ROW = f"""SELECT '{H.REQUIRED.id}', '{H.REQUIRED.domain}', '{H.REQUIRED.name}', 'PASS',
  CAST(0 AS BIGINT), '{H.REQUIRED.passed}'"""
SUITE_SQL = " UNION ALL ".join(
    [
        _log(H.ID_FORMAT, BAD_ID), REQUIRED_ROW, _log(H.UNIQUE, UNIQUE), _log(H.FLAG, CLASH),
        _log(H.DATES, DATES), _log(H.SEVERITY, SEVERITY), _log(H.BALANCE, BALANCE),
        _log(H.FLAGS, FLAGS), _log(H.RANGE, RANGE), _log(H.REFERENTIAL, LINKED),
    ]
)


def _checked_subjects(t: OrderTrial) -> DataFrame:
    """The subject columns that checks read, computed once for all of them."""
    return settle(
        t.adsl.select(
            "USUBJID", "TRT01PN", "DPTFL", "DSDECOD", "RFSTDTC", "RFENDTC", "SAFFL", "ITTFL",
            "COMPLPCT",
        )
    )


def _suite(t: OrderTrial, adsl: DataFrame) -> DataFrame:
    return H.validation_suite(t.spark, _with_printed_id(t), t.ae, adsl, ID_PATTERN, "PRINTED_ID")


@query("validation_suite", SUITE_SQL)
def validation_suite(t: OrderTrial) -> DataFrame:
    """All ten checks."""
    return _suite(t, _checked_subjects(t))


@query(
    "validation_rollup",
    f""", log AS ({SUITE_SQL})
    SELECT count(*) FILTER (WHERE STATUS = 'PASS') AS N_PASS, count(*) FILTER (WHERE STATUS = 'FAIL') AS N_FAIL,
    count(*) FILTER (WHERE STATUS = 'WARN') AS N_WARN, (SELECT count(*) FROM adsl) AS N_SUBJ,
    (SELECT count(*) FROM adsl WHERE DPTFL = 'Y') AS N_DROPOUT, (SELECT count(*) FROM ae) AS N_AE FROM log""",
)
def validation_rollup(t: OrderTrial) -> DataFrame:
    adsl = _checked_subjects(t)
    return H.validation_rollup(_suite(t, adsl), adsl, t.ae)

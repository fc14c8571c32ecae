"""Joins and row expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialspark.operators import adam, rows as R
from trialspark.operators.rows import population, round_numeric
from trialspark.plans.catalog.registry import query
from trialspark.plans.catalog.sources import TERM_VALUES
from trialspark.plans.order_trial import ALT_TERMS, NEURO_GI_TERMS, OrderTrial
from trialspark import schema as S
from trialspark.sources.domains import TERM_KIND, term_entries


@query(
    "build_adsl",
    "SELECT * REPLACE (round(DAS28CHG, 6) AS DAS28CHG, round(COMPLPCT, 6) AS COMPLPCT) FROM adsl",
)
def build_adsl(t: OrderTrial) -> DataFrame:
    return round_numeric(t.adsl, 6)


@query("build_adae", "SELECT * FROM adae")
def build_adae(t: OrderTrial) -> DataFrame:
    return t.adae


@query(
    "cross_with_dictionary",
    f""", terms(AEDECOD, AEBODSYS, BASE_PROB, SEV_SEVERE_P) AS (VALUES {TERM_VALUES})
    SELECT USUBJID, TRT01PN, AEDECOD, AEBODSYS, BASE_PROB, SEV_SEVERE_P FROM dm CROSS JOIN terms""",
)
def cross_with_dictionary(t: OrderTrial) -> DataFrame:
    return R.cross_with_dictionary(t.dm.select("USUBJID", "TRT01PN"), term_entries(), TERM_KIND)


@query(
    "orphans",
    """SELECT USUBJID, EXREFID, EXSTDTC FROM ex
    WHERE USUBJID NOT IN (SELECT USUBJID FROM dm WHERE ITTFL = 'Y')""",
)
def orphans(t: OrderTrial) -> DataFrame:
    """Doses of subjects outside the ITT population."""
    return R.orphans(
        t.ex.select("USUBJID", "EXREFID", "EXSTDTC"), population(t.dm, "ITT"), "USUBJID"
    )


@query(
    "expand_visits",
    """SELECT USUBJID, CAST(v AS INTEGER) AS VISITNUM, 'WEEK ' || (v * 4) AS VISIT,
    strftime(CAST(RFSTDTC AS DATE) + CAST((v - 1) * 28 AS INTEGER), '%Y-%m-%d') AS EXSTDTC,
    strftime(CAST(RFSTDTC AS DATE) + CAST(v * 28 - 1 AS INTEGER), '%Y-%m-%d') AS EXENDTC
    FROM dm CROSS JOIN range(1, 7) r(v)""",
)
def expand_visits(t: OrderTrial) -> DataFrame:
    return R.expand_visits(t.dm.select("USUBJID", "RFSTDTC"), "RFSTDTC").drop("RFSTDTC")


@query(
    "expand_tests",
    """, visits AS (SELECT USUBJID, v AS VISITNUM, DASCR, AGE, TRT01PN FROM dm CROSS JOIN range(0, 7) r(v)),
    wide AS (SELECT USUBJID, VISITNUM, DASCR - VISITNUM * 0.125::DOUBLE * TRT01PN AS DAS,
      CAST(AGE % 28 AS DOUBLE) AS TJC, CAST((AGE + VISITNUM) % 28 AS DOUBLE) AS SJC FROM visits)
    SELECT USUBJID, CAST(VISITNUM AS INTEGER) AS VISITNUM,
      CASE VISITNUM WHEN 0 THEN 'SCREENING' ELSE 'WEEK ' || (VISITNUM * 4) END AS VISIT,
      VSTESTCD, VSORRESU, VSSTRESN, VSSTRESC
    FROM (SELECT USUBJID, VISITNUM, 'DAS28' AS VSTESTCD, 'score' AS VSORRESU, DAS AS VSSTRESN,
        CAST(round(CAST(CAST(DAS AS VARCHAR) AS DECIMAL(20, 17)), 1) AS DECIMAL(20, 1)) || '' AS VSSTRESC
        FROM wide UNION ALL
      SELECT USUBJID, VISITNUM, 'TJC28', 'count', TJC, printf('%.0f', TJC) FROM wide UNION ALL
      SELECT USUBJID, VISITNUM, 'SJC28', 'count', SJC, printf('%.0f', SJC) FROM wide)""",
)
def expand_tests(t: OrderTrial) -> DataFrame:
    """Three test records at each of seven visits, missing baseline scores included."""
    people = t.dm.select("USUBJID", "RFSTDTC", "DASCR", "AGE", "TRT01PN")
    visits = R.expand_visits(people, "RFSTDTC", 0, 6, prefix="VS")
    n = F.col("VISITNUM")
    wide = visits.select(
        "USUBJID", "VISITNUM", "VISIT",
        (F.col("DASCR") - n * 0.125 * F.col("TRT01PN")).alias("DAS"),
        (F.col("AGE") % 28).alias("TJC"),
        ((F.col("AGE") + n) % 28).alias("SJC"),
    )
    tests = [
        (code, name, unit, column, decimals)
        for (code, name, unit, decimals), column in zip(S.VISIT_TESTS, ["DAS", "TJC", "SJC"])
    ]
    long = R.expand_tests(wide, tests)
    return long.select("USUBJID", "VISITNUM", "VISIT", "VSTESTCD", "VSORRESU", "VSSTRESN", "VSSTRESC")


@query(
    "attach_summaries",
    "SELECT USUBJID, SITEID, TRT01PN, AENUM, AESNUM, AEMAXSEVN, COMPLPCT FROM adsl",
)
def attach_summaries(t: OrderTrial) -> DataFrame:
    joined = adam.attach_summaries(
        t.dm.select("USUBJID", "SITEID", "TRT01PN"),
        adam.ae_burden(t.ae, "USUBJID", ALT_TERMS, NEURO_GI_TERMS),
        adam.ex_compliance(t.ex),
    )
    return joined.select(
        "USUBJID", "SITEID", "TRT01PN", "AENUM", "AESNUM", "AEMAXSEVN", "COMPLPCT"
    )

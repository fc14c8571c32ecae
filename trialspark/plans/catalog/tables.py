"""Aggregations and summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialspark.operators import adam, tables as T
from trialspark.operators.rows import optional_filters, population, round_numeric
from trialspark.plans.catalog.registry import query
from trialspark.plans.order_trial import ALT_TERMS, NEURO_GI_TERMS, OrderTrial

PCT = "avg(CASE WHEN DPTFL = 'Y' THEN 100.0::DOUBLE ELSE 0 END)"
NDROP = "CAST(sum(CASE WHEN DPTFL = 'Y' THEN 1 ELSE 0 END) AS BIGINT)"
ARM_SUMS = ", ".join(
    f"CAST(sum(hit) FILTER (WHERE TRT01PN = {a}) AS BIGINT) AS {n}"
    for a, n in ((0, "N_PLC"), (1, "N_LOW"), (2, "N_HIGH"))
)
TERM_TABLE = f""", pairs AS (
      SELECT AEBODSYS, AEDECOD, USUBJID, any_value(TRT01PN) AS TRT01PN, 1 AS hit FROM adae
      WHERE TRTEMFL = 'Y' GROUP BY AEBODSYS, AEDECOD, USUBJID),
    table_rows AS (SELECT AEBODSYS, AEDECOD, {ARM_SUMS}, count(*) AS N_TOTAL FROM pairs GROUP BY ALL),
    counted AS (SELECT * REPLACE (coalesce(N_PLC, 0) AS N_PLC, coalesce(N_LOW, 0) AS N_LOW,
      coalesce(N_HIGH, 0) AS N_HIGH) FROM table_rows)"""


@query(
    "ae_burden",
    """SELECT USUBJID, AENUM, AESNUM, AEMAXSEVN, N_ALT_AE, N_NEURO_GI_AE,
    CASE AEMAXSEVN WHEN 1 THEN 'MILD' WHEN 2 THEN 'MODERATE' ELSE 'SEVERE' END AS AEMAXSEV FROM ae_feat""",
)
def ae_burden(t: OrderTrial) -> DataFrame:
    return adam.ae_burden(t.ae, "USUBJID", ALT_TERMS, NEURO_GI_TERMS)


@query("ex_compliance", "SELECT * FROM ex_feat")
def ex_compliance(t: OrderTrial) -> DataFrame:
    return adam.ex_compliance(t.ex)


@query(
    "baseline_last_change",
    """SELECT USUBJID, round(DAS28BL, 6) AS DAS28BL, round(DAS28LAST, 6) AS DAS28LAST,
    round(DAS28CHG, 6) + 0.0 AS DAS28CHG, ACR20FL FROM vs_feat""",
)
def baseline_last_change(t: OrderTrial) -> DataFrame:
    return round_numeric(adam.baseline_last_change(t.vs), 6)


@query(
    "dropout_by_arm",
    f"""SELECT TRT01PN, TRT01P, count(*) AS N_TOTAL, {NDROP} AS N_DROPOUT, round({PCT}, 6) AS PCT_DROPOUT
    FROM adsl GROUP BY TRT01PN, TRT01P""",
)
def dropout_by_arm(t: OrderTrial) -> DataFrame:
    return round_numeric(T.dropout_by_arm(t.adsl), 6)


@query(
    "means_by_status",
    """SELECT DPTFL, count(*) AS N, round(avg(COMPLPCT), 6) AS MEAN_COMPLIANCE,
    round(avg(AENUM), 6) AS MEAN_AE_COUNT, round(avg(AEMAXSEVN), 6) AS MEAN_MAX_SEV
    FROM adsl GROUP BY DPTFL""",
)
def means_by_status(t: OrderTrial) -> DataFrame:
    return round_numeric(T.means_by_status(t.adsl), 6)


@query(
    "site_summary",
    f"""SELECT SITEID, COUNTRY, REGION, count(*) AS N_TOTAL, {NDROP} AS N_DROPOUT,
    round({PCT}, 6) AS PCT_DROPOUT, round(avg(COMPLPCT), 6) AS MEAN_COMP, round(avg(AENUM), 6) AS MEAN_AE,
    CASE WHEN {PCT} > 25 THEN 'Y' ELSE 'N' END AS OVER_TARGET
    FROM itt GROUP BY SITEID, COUNTRY, REGION""",
)
def site_summary(t: OrderTrial) -> DataFrame:
    return round_numeric(T.site_summary(t.itt), 6)


@query(
    "arm_denominators",
    "SELECT TRT01PN, TRT01P, count(*) AS N_ARM FROM adsl WHERE SAFFL = 'Y' GROUP BY TRT01PN, TRT01P",
)
def arm_denominators(t: OrderTrial) -> DataFrame:
    return T.arm_denominators(t.adsl)


@query(
    "teae_overall",
    f""", subject AS (
      SELECT USUBJID, TRT01PN, bool_or(AESER = 'Y') AS serious, bool_or(DPTFL = 'Y') AS dropped FROM adae
      WHERE TRTEMFL = 'Y' GROUP BY USUBJID, TRT01PN),
    said AS (
      SELECT TRT01PN, unnest(['Any TEAE', 'Any Serious TEAE', 'Any TEAE Leading to Dropout']) AS CATEGORY,
        unnest([1, CAST(serious AS INTEGER), CAST(dropped AS INTEGER)]) AS hit FROM subject)
    SELECT CATEGORY, {ARM_SUMS}, CAST(sum(hit) AS BIGINT) AS N_TOTAL FROM said GROUP BY CATEGORY""",
)
def teae_overall(t: OrderTrial) -> DataFrame:
    return T.teae_overall(t.ae, t.adsl)


@query(
    "teae_by_term",
    TERM_TABLE + " SELECT * FROM counted WHERE greatest(N_PLC, N_LOW, N_HIGH) >= 3",
)
def teae_by_term(t: OrderTrial) -> DataFrame:
    return T.teae_by_term(t.ae, t.adsl)


@query(
    "teae_by_term_percent",
    TERM_TABLE
    + """, sizes AS (SELECT TRT01PN AS a, count(*) AS n FROM adsl WHERE SAFFL = 'Y' GROUP BY a)
    SELECT * FROM counted WHERE N_PLC * 100.0 >= 8.0 * (SELECT n FROM sizes WHERE a = 0)
      OR N_LOW * 100.0 >= 8.0 * (SELECT n FROM sizes WHERE a = 1)
      OR N_HIGH * 100.0 >= 8.0 * (SELECT n FROM sizes WHERE a = 2)""",
)
def teae_by_term_percent(t: OrderTrial) -> DataFrame:
    """Terms of at least 8% of some arm."""
    return T.teae_by_term(
        t.ae, t.adsl, min_pct=8.0, denominators=T.arm_denominators(t.adsl)
    )


@query(
    "crosstab",
    """, cells AS (SELECT AESEV, TRT01P, count(*) AS N FROM adae WHERE TRTEMFL = 'Y' GROUP BY AESEV, TRT01P)
    SELECT AESEV, TRT01P, N, round(N * 100.0::DOUBLE / sum(N) OVER (), 6) AS PCT,
    round(N * 100.0::DOUBLE / sum(N) OVER (PARTITION BY AESEV), 6) AS PCT_ROW,
    round(N * 100.0::DOUBLE / sum(N) OVER (PARTITION BY TRT01P), 6) AS PCT_COL FROM cells""",
)
def crosstab(t: OrderTrial) -> DataFrame:
    emergent = t.adae_unsequenced.filter(F.col("TRTEMFL") == "Y")
    return round_numeric(T.crosstab(emergent, "AESEV", "TRT01P"), 6)


CONTINUOUS = ["AGE", "BMIBL", "DAS28BL", "COMPLPCT", "AENUM"]
CATEGORICAL = ["SEX", "AGEGR1", "RACE", "DAS28GRP", "COMPLFL"]


def _continuous_sql() -> str:
    parts = []
    for v in CONTINUOUS:
        for arm, flag, group in (("TRT01P", "N", "GROUP BY TRT01P"), ("'All'", "Y", "")):
            parts.append(
                f"""SELECT '{v}' AS VARIABLE, '{flag}' AS OVERALL, {arm} AS ARM, count({v}) AS N, round(avg({v}), 6) AS MEAN,
                round(stddev_samp({v}), 6) AS SD, round(median(CAST({v} AS DOUBLE)), 6) AS MEDIAN,
                CAST(min({v}) AS DOUBLE) AS MIN, CAST(max({v}) AS DOUBLE) AS MAX FROM itt {group}"""
            )
    return " UNION ALL ".join(parts).replace(
        "CAST(min(COMPLPCT) AS DOUBLE)", "round(min(COMPLPCT), 6)"
    ).replace("CAST(max(COMPLPCT) AS DOUBLE)", "round(max(COMPLPCT), 6)")


@query("continuous_summary", _continuous_sql())
def continuous_summary(t: OrderTrial) -> DataFrame:
    return round_numeric(T.continuous_summary(t.itt, CONTINUOUS), 6)


def _categorical_sql() -> str:
    complete = " AND ".join(f"{v} IS NOT NULL" for v in CATEGORICAL)
    long = " UNION ALL ".join(
        f"SELECT '{v}' AS VARIABLE, {v} AS LEVEL, TRT01P FROM itt WHERE {complete}"
        for v in CATEGORICAL
    )
    return f""", long AS ({long}),
    cells AS (SELECT VARIABLE, LEVEL, TRT01P, count(*) AS N FROM long GROUP BY ALL)
    SELECT VARIABLE, LEVEL, TRT01P, N,
    round(N * 100.0::DOUBLE / sum(N) OVER (PARTITION BY VARIABLE, LEVEL), 6) AS PCT_ROW,
    round(N * 100.0::DOUBLE / sum(N) OVER (PARTITION BY VARIABLE, TRT01P), 6) AS PCT_COL FROM cells"""


@query("categorical_summary", _categorical_sql())
def categorical_summary(t: OrderTrial) -> DataFrame:
    return round_numeric(T.categorical_summary(t.itt, CATEGORICAL), 6)


@query(
    "site_distribution",
    """SELECT SITEID, COUNTRY, """
    + ", ".join(
        f"CAST(sum(CASE WHEN TRT01PN = {a} THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
        for a, n in ((0, "N_PLC"), (1, "N_LOW"), (2, "N_HIGH"))
    )
    + " FROM itt GROUP BY SITEID, COUNTRY",
)
def site_distribution(t: OrderTrial) -> DataFrame:
    return T.site_distribution(population(t.dm, "ITT"))


@query(
    "dropout_reasons",
    "SELECT TRT01P, TRT01PN, DSDECOD, count(*) AS N FROM itt WHERE DPTFL = 'Y' GROUP BY ALL",
)
def dropout_reasons(t: OrderTrial) -> DataFrame:
    return T.dropout_reasons(t.itt)


@query(
    "kpis",
    f"""SELECT coalesce(CHOSEN, 'all') AS CHOSEN, count(*) AS N_SUBJECTS, round({PCT}, 6) AS PCT_DROPOUT,
    round(avg(COMPLPCT), 6) AS MEAN_COMPLIANCE, round(avg(AENUM), 6) AS MEAN_AE
    FROM (SELECT *, REGION AS CHOSEN FROM adsl) GROUP BY GROUPING SETS ((CHOSEN), ())
    HAVING coalesce(CHOSEN, 'all') IN ('all', 'EUROPE')""",
)
def kpis(t: OrderTrial) -> DataFrame:
    """Figures of all subjects and of one chosen region."""
    chosen = [
        T.kpis(optional_filters(t.adsl, {"SITEID": None, "TRT01P": None, "REGION": region})).select(
            F.lit(region or "all").alias("CHOSEN"), "*"
        )
        for region in (None, "EUROPE")
    ]
    return round_numeric(chosen[0].unionByName(chosen[1]), 6)


@query(
    "demographics_by_arm",
    """SELECT TRT01P, count(*) AS N, round(avg(AGE), 6) AS AGE_MEAN, round(stddev_samp(AGE), 6) AS AGE_SD,
    round(avg(CASE WHEN SEX = 'F' THEN 100.0::DOUBLE ELSE 0 END), 6) AS PCT_FEMALE,
    round(avg(DAS28BL), 6) AS DAS28_MEAN, round(avg(BMIBL), 6) AS BMI_MEAN FROM itt GROUP BY TRT01P""",
)
def demographics_by_arm(t: OrderTrial) -> DataFrame:
    return round_numeric(T.demographics_by_arm(t.itt), 6)


@query(
    "histogram",
    """SELECT TRT01P, ceil((COMPLPCT - 2.5) / 5.0::DOUBLE) * 5 + 0.0 AS BIN, count(*) AS N,
    CAST(sum(CASE WHEN COMPLPCT < 80 THEN 1 ELSE 0 END) AS BIGINT) AS N_BELOW
    FROM adsl GROUP BY ALL""",
)
def histogram(t: OrderTrial) -> DataFrame:
    return T.histogram(t.adsl, "COMPLPCT", "TRT01P")


@query(
    "arm_by_status",
    f"""SELECT TRT01P, count(*) FILTER (WHERE DPTFL = 'N') AS N, count(*) FILTER (WHERE DPTFL = 'Y') AS Y,
    round(count(*) FILTER (WHERE DPTFL = 'Y') * 100.0::DOUBLE / count(DPTFL), 6) AS PCT_DROPOUT
    FROM adsl GROUP BY TRT01P""",
)
def arm_by_status(t: OrderTrial) -> DataFrame:
    return round_numeric(T.arm_by_status(t.adsl), 6)


@query(
    "dm_summary",
    """SELECT 'DM' AS DOMAIN, count(DISTINCT USUBJID) AS N_SUBJECTS,
    count(*) FILTER (WHERE TRT01PN = 0) AS N_PLACEBO, count(*) FILTER (WHERE TRT01PN = 1) AS N_LOW_DOSE,
    count(*) FILTER (WHERE TRT01PN = 2) AS N_HIGH_DOSE FROM dm""",
)
def dm_summary(t: OrderTrial) -> DataFrame:
    return T.dm_summary(t.dm)


@query("disposition_frequency", "SELECT DSDECOD, count(*) AS N FROM ds GROUP BY DSDECOD")
def disposition_frequency(t: OrderTrial) -> DataFrame:
    return T.disposition_frequency(t.ds)


@query(
    "batch_risk_summary",
    """SELECT count(*) AS N_PATIENTS, count(*) FILTER (WHERE RISK_TIER = 'High Risk') AS N_HIGH_RISK,
    count(*) FILTER (WHERE RISK_TIER = 'Moderate Risk') AS N_MODERATE_RISK,
    count(*) FILTER (WHERE RISK_TIER = 'Low Risk') AS N_LOW_RISK,
    round(avg(DROPOUT_PROB), 6) AS MEAN_DROPOUT_PROB FROM scored""",
)
def batch_risk_summary(t: OrderTrial) -> DataFrame:
    return round_numeric(T.batch_risk_summary(t.scored), 6)


@query("mean_prediction", "SELECT round(avg(DROPOUT_PROB), 6) AS BASELINE_PROB FROM scored")
def mean_prediction(t: OrderTrial) -> DataFrame:
    return round_numeric(T.mean_prediction(t.scored), 6)


@query(
    "distinct_values",
    """SELECT DISTINCT 'SITEID' AS FILTER, SITEID AS VALUE FROM adsl UNION ALL
    SELECT DISTINCT 'TRT01P', TRT01P FROM adsl UNION ALL
    SELECT DISTINCT 'REGION', REGION FROM adsl""",
)
def distinct_values(t: OrderTrial) -> DataFrame:
    return T.distinct_values(t.adsl)

"""Projections, filters and scalar derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialspark import functions as X, schema as S
from trialspark.operators import rows as R
from trialspark.operators.reshape import union_all
from trialspark.operators.scoring import risk_table as risk_view, score
from trialspark.plans.catalog.registry import query
from trialspark.plans.order_trial import DRUG, HORIZON, REMOTE_SITES, STUDY, OrderTrial

c = F.col


@query(
    "build_usubjid",
    """SELECT USUBJID, 'TRIAL-01-' || SITEID || '-' || printf('%03d', CAST(SUBJID AS INTEGER)) AS ID FROM dm""",
)
def build_usubjid(t: OrderTrial) -> DataFrame:
    return t.dm.select(
        "USUBJID", X.build_usubjid(STUDY, c("SITEID"), c("SUBJID").cast("int")).alias("ID")
    )


@query("band", "SELECT USUBJID, AGEGR1, DAS28GRP, BMIGRP FROM adsl")
def band(t: OrderTrial) -> DataFrame:
    return t.dm.select(
        "USUBJID",
        X.band(c("AGE"), *S.AGE_BANDS).alias("AGEGR1"),
        X.band(c("DASCR"), *S.DAS28_BANDS).alias("DAS28GRP"),
        X.band(c("BMIBL"), *S.BMI_BANDS).alias("BMIGRP"),
    )


@query(
    "recode",
    """SELECT dm.USUBJID, CASE SEX WHEN 'F' THEN 1 ELSE 2 END AS SEXN,
    CASE RACE WHEN 'WHITE' THEN 1 WHEN 'BLACK OR AFRICAN AMERICAN' THEN 2 WHEN 'ASIAN' THEN 3 ELSE 4 END AS RACEN,
    CASE TRT01PN WHEN 0 THEN 'PLACEBO' WHEN 1 THEN 'DRUG 100mg' ELSE 'DRUG 200mg' END AS EXTRT,
    TRT01PN * 100 AS EXDOSE,
    CASE DSDECOD WHEN 'COMPLETED' THEN 'STUDY COMPLETION' WHEN 'WITHDRAWAL BY SUBJECT' THEN 'SUBJECT DECISION' ELSE 'OTHER' END AS DSSCAT,
    CASE DSDECOD WHEN 'COMPLETED' THEN 'Completed study as planned' WHEN 'WITHDRAWAL BY SUBJECT' THEN 'Subject withdrew consent'
      WHEN 'LOST TO FOLLOW-UP' THEN 'Subject lost to follow-up' ELSE 'Discontinued due to protocol deviation' END AS DSTERM,
    CASE DSDECOD WHEN 'COMPLETED' THEN 'COMPLETED' ELSE 'DISCONTINUED' END AS EOSSTT
    FROM dm LEFT JOIN ds ON dm.USUBJID = ds.USUBJID""",
)
def recode(t: OrderTrial) -> DataFrame:
    term = c("DSDECOD")

    def part(i: int):
        return X.recode(term, {k: v[i] for k, v in S.DISPOSITION.items()}, S.DISPOSITION_OTHER[i])

    return t.dm.join(t.ds.select("USUBJID", "DSDECOD"), "USUBJID", "left").select(
        "USUBJID",
        X.recode(c("SEX"), S.SEX_CODE, S.SEX_CODE_OTHER).alias("SEXN"),
        X.recode(c("RACE"), S.RACE_CODE, S.RACE_CODE_OTHER).alias("RACEN"),
        X.drug_label(c("TRT01PN"), DRUG).alias("EXTRT"),
        X.recode(c("TRT01PN"), {0: 0, 1: 100, 2: 200}).alias("EXDOSE"),
        part(0).alias("DSSCAT"), part(1).alias("DSTERM"), part(2).alias("EOSSTT"),
    )


@query(
    "bmi",
    """SELECT USUBJID, round(WEIGHTBL / ((HEIGHTBL / 100) * (HEIGHTBL / 100)), 1) AS BMI FROM dm""",
)
def bmi(t: OrderTrial) -> DataFrame:
    return t.dm.select("USUBJID", X.bmi(c("WEIGHTBL"), c("HEIGHTBL")).alias("BMI"))


@query(
    "clamp",
    """SELECT USUBJID, CASE WHEN DASCR IS NULL THEN NULL ELSE greatest(least(DASCR, 6.5::DOUBLE), 3::DOUBLE) END AS DAS,
    greatest(least(HEIGHTBL, 180::DOUBLE), 158::DOUBLE) AS HEIGHT FROM dm""",
)
def clamp(t: OrderTrial) -> DataFrame:
    return t.dm.select(
        "USUBJID",
        X.clamp(c("DASCR"), 3.0, 6.5).alias("DAS"),
        X.clamp(c("HEIGHTBL"), 158.0, 180.0).alias("HEIGHT"),
    )


@query(
    "indicator",
    """SELECT USUBJID, CASE WHEN DASCR >= 5.1 THEN 1 ELSE 0 END AS HIGHDAS,
    CASE WHEN BMIBL < 25 THEN 1 ELSE 0 END AS LEAN FROM dm""",
)
def indicator(t: OrderTrial) -> DataFrame:
    return t.dm.select(
        "USUBJID",
        X.indicator(c("DASCR") >= 5.1).alias("HIGHDAS"),
        X.indicator(c("BMIBL") < 25).alias("LEAN"),
    )


@query(
    "yn_flag", "SELECT USUBJID, CASE WHEN BMIBL >= 30 THEN 'Y' ELSE 'N' END AS OBESEFL FROM dm"
)
def yn_flag(t: OrderTrial) -> DataFrame:
    return t.dm.select("USUBJID", X.yn_flag(c("BMIBL") >= 30).alias("OBESEFL"))


@query(
    "default_missing",
    """SELECT dm.USUBJID, coalesce(DASCR, 0) AS DASCR, coalesce(BMIBL, 0) AS BMIBL,
    coalesce(DSDECOD, 'UNKNOWN') AS DSDECOD FROM dm LEFT JOIN ds ON dm.USUBJID = ds.USUBJID""",
)
def default_missing(t: OrderTrial) -> DataFrame:
    joined = t.dm.join(t.ds.select("USUBJID", "DSDECOD"), "USUBJID", "left")
    return R.default_missing(
        joined.select("USUBJID", "DASCR", "BMIBL", "DSDECOD"),
        {"DASCR": 0, "BMIBL": 0, "DSDECOD": "UNKNOWN"},
    )


@query("compliance_flag", "SELECT USUBJID, COMPLFL FROM adsl")
def compliance_flag(t: OrderTrial) -> DataFrame:
    return t.adsl.select("USUBJID", X.compliance_flag(c("COMPLPCT")).alias("COMPLFL"))


@query(
    "response_flag",
    """SELECT USUBJID, CASE WHEN DAS28CHG < -1.2::DOUBLE THEN 'RESPONDER' ELSE 'NON-RESPONDER' END AS RESPONSE
    FROM adsl""",
)
def response_flag(t: OrderTrial) -> DataFrame:
    return t.adsl.select("USUBJID", X.response_flag(c("DAS28CHG")).alias("RESPONSE"))


@query(
    "population",
    """SELECT 'ITT' AS POPULATION, USUBJID FROM dm WHERE ITTFL = 'Y' UNION ALL
    SELECT 'SAFETY', USUBJID FROM dm WHERE SAFFL = 'Y' UNION ALL
    SELECT 'PP', USUBJID FROM dm WHERE PPROTFL = 'Y'""",
)
def population(t: OrderTrial) -> DataFrame:
    return union_all(
        [
            R.population(t.dm, which).select(F.lit(which).alias("POPULATION"), "USUBJID")
            for which in R.POPULATION_FLAGS
        ]
    )


@query(
    "normalise_term",
    "SELECT replace(COUNTRY, '_', ' ') AS TERM, count(*) AS N FROM dm GROUP BY ALL",
)
def normalise_term(t: OrderTrial) -> DataFrame:
    return t.dm.groupBy(X.normalise_term(c("COUNTRY")).alias("TERM")).agg(
        F.count(F.lit(1)).alias("N")
    )


@query(
    "iso_date",
    """SELECT event_id, CASE WHEN TRY_CAST(d AS DATE) IS NULL THEN NULL
      ELSE strftime(TRY_CAST(d AS DATE), '%Y-%m-%d') END AS DAY
    FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'not a date'
      ELSE strftime(ts, '%Y-%m-%d') END AS d FROM events)""",
)
def iso_date(t: OrderTrial) -> DataFrame:
    """Event days parsed from text, of which some is not a date."""
    text = F.when(c("event_type") == "error", "not a date").otherwise(
        X.iso_text(c("ts").cast("date"))
    )
    return t.table("events").select("event_id", X.iso_text(X.iso_date(text)).alias("DAY"))


@query(
    "iso_text",
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS DAY FROM events",
)
def iso_text(t: OrderTrial) -> DataFrame:
    return t.table("events").select("event_id", X.iso_text(c("ts").cast("date")).alias("DAY"))


@query(
    "shift_days",
    """SELECT USUBJID, strftime(CAST(RFSTDTC AS DATE) + 168, '%Y-%m-%d') AS PLANNED_END FROM dm""",
)
def shift_days(t: OrderTrial) -> DataFrame:
    end = X.shift_days(X.iso_date(c("RFSTDTC")), 168)
    return t.dm.select("USUBJID", X.iso_text(end).alias("PLANNED_END"))


@query("treatment_emergent", "SELECT USUBJID, TRTEMFL, count(*) AS N FROM adae GROUP BY ALL")
def treatment_emergent(t: OrderTrial) -> DataFrame:
    """Events per subject and emergence."""
    return t.adae_unsequenced.groupBy("USUBJID", "TRTEMFL").agg(F.count(F.lit(1)).alias("N"))


@query(
    "time_to_event",
    f"""SELECT USUBJID, CASE WHEN DCDT IS NULL THEN {HORIZON}
      ELSE CAST(least({HORIZON}, greatest(0, date_diff('day', CAST(RFSTDTC AS DATE), CAST(DCDT AS DATE)))) AS INTEGER) END AS DAYS,
    DPTN AS EVENT FROM adsl""",
)
def time_to_event(t: OrderTrial) -> DataFrame:
    return t.adsl.select(
        "USUBJID",
        X.time_to_event(c("RFSTDTC"), c("DCDT"), HORIZON).alias("DAYS"),
        c("DPTN").alias("EVENT"),
    )


@query("select_keep", "SELECT USUBJID AS SUBJECT, SITEID AS SITE, TRT01P FROM dm")
def select_keep(t: OrderTrial) -> DataFrame:
    kept = R.select_keep(
        t.dm, ["USUBJID", "SITEID", "TRT01P", "AGE"], {"USUBJID": "SUBJECT", "SITEID": "SITE"}
    )
    return R.drop_columns(kept, ["AGE"])


@query(
    "attach_labels",
    " UNION ALL ".join(
        f"SELECT '{n}' AS COLUMN, '{S.LABELS[n]}' AS LABEL, count({n}) AS N_PRESENT FROM adsl"
        for n in S.ADSL.fieldNames() if n in S.LABELS
    ),
)
def attach_labels(t: OrderTrial) -> DataFrame:
    """Subjects per labelled column with a value, from the stored labels."""
    labels = R.column_labels(R.attach_labels(t.adsl))
    counted = t.adsl.agg(*[F.count(n).alias(n) for n in labels])
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("COLUMN"), F.lit(text).alias("LABEL"), c(n).alias("N_PRESENT")
            )
            for n, text in labels.items()
        ]
    )
    return counted.select(F.explode(rows).alias("r")).select("r.*")


@query(
    "optional_filters",
    "SELECT USUBJID, SITEID, TRT01P, REGION FROM adsl WHERE TRT01P = 'Placebo' AND REGION = 'ASIA'",
)
def optional_filters(t: OrderTrial) -> DataFrame:
    chosen = R.optional_filters(
        t.adsl, {"SITEID": None, "TRT01P": "Placebo", "REGION": "ASIA"}
    )
    return chosen.select("USUBJID", "SITEID", "TRT01P", "REGION")


@query("risk_tier", "SELECT USUBJID, DROPOUT_PROB, RISK_TIER FROM scored")
def risk_tier(t: OrderTrial) -> DataFrame:
    return t.scored.select("USUBJID", "DROPOUT_PROB", X.risk_tier(c("DROPOUT_PROB")).alias("RISK_TIER"))


@query("predicted_label", "SELECT USUBJID, DROPOUT_PREDICTED FROM scored")
def predicted_label(t: OrderTrial) -> DataFrame:
    return t.scored.select(
        "USUBJID", X.predicted_label(c("DROPOUT_PROB")).alias("DROPOUT_PREDICTED")
    )


@query(
    "filter_tiers",
    """SELECT USUBJID, DROPOUT_PROB, RISK_TIER FROM scored
    WHERE RISK_TIER IN ('High Risk', 'Moderate Risk')""",
)
def filter_tiers(t: OrderTrial) -> DataFrame:
    return R.filter_tiers(
        t.scored.select("USUBJID", "DROPOUT_PROB", "RISK_TIER"), ["High Risk", "Moderate Risk"]
    )


@query(
    "complete_cases",
    """SELECT USUBJID, SITEID, DAS28BL, DSDECOD, DCDT FROM adsl
    WHERE DAS28BL IS NOT NULL AND DSDECOD IS NOT NULL AND DCDT IS NOT NULL""",
)
def complete_cases(t: OrderTrial) -> DataFrame:
    """Subjects with a baseline score and a disposition."""
    columns = t.adsl.select("USUBJID", "SITEID", "DAS28BL", "DSDECOD", "DCDT")
    return R.complete_cases(columns, ["DAS28BL", "DSDECOD", "DCDT"])


@query(
    "adverse_event_propensity",
    """SELECT USUBJID, round(least(0.6::DOUBLE, 0.28::DOUBLE * (1 + TRT01PN * 0.18::DOUBLE)
      * (1 + greatest(0, (AGE - 45) * 0.008::DOUBLE))
      * (1 + coalesce(greatest(0, (DASCR - 4.5::DOUBLE) * 0.06::DOUBLE), 0))), 8) AS PROB
    FROM dm""",
)
def adverse_event_propensity(t: OrderTrial) -> DataFrame:
    prob = X.adverse_event_propensity(F.lit(0.28), c("TRT01PN"), c("AGE"), c("DASCR"))
    return t.dm.select("USUBJID", F.round(prob, 8).alias("PROB"))


@query("dropout_rule_score", "SELECT USUBJID, DROPOUT_PROB AS SCORE FROM scored")
def dropout_rule_score(t: OrderTrial) -> DataFrame:
    rule = X.dropout_rule_score(
        c("AENUM"), c("AESNUM"), c("AEMAXSEVN"), c("COMPLPCT"), c("SITEID"), c("TRT01PN"),
        REMOTE_SITES,
    )
    return t.adsl.select("USUBJID", rule.alias("SCORE"))


def range_sql() -> str:
    parts = []
    for name, (low, high, whole, default) in S.SCORE_RANGES.items():
        v = f"coalesce({name}, {default})" if default is not None else name
        parts.append(f"CASE WHEN {v} IS NULL THEN '{name} missing' END")
        parts.append(f"CASE WHEN {v} < {low} THEN '{name} low' END")
        parts.append(f"CASE WHEN {v} > {high} THEN '{name} high' END")
        if whole:
            parts.append(f"CASE WHEN {v} <> floor({v}) THEN '{name} fraction' END")
    return "concat_ws(';', " + ", ".join(parts) + ")"


@query(
    "risk_table",
    """SELECT USUBJID AS "Subject ID", SITEID AS Site, TRT01P AS Treatment, AGE AS Age, SEX AS Sex, AENUM AS "N AEs",
    AEMAXSEVN AS "Max Sev (N)", round(COMPLPCT, 1) AS "Compliance %", round(DROPOUT_PROB * 100, 1) AS "Dropout Prob %",
    RISK_TIER AS "Risk Tier" FROM scored WHERE RISK_TIER IN ('High Risk', 'Moderate Risk')""",
)
def risk_table(t: OrderTrial) -> DataFrame:
    """Displayed table of the subjects at moderate or high risk."""
    return risk_view(t.scored, ["High Risk", "Moderate Risk"])


@query(
    "score_without_model",
    """SELECT USUBJID, CAST(NULL AS DOUBLE) AS DROPOUT_PROB, CAST(NULL AS INTEGER) AS DROPOUT_PREDICTED,
    'Unknown' AS RISK_TIER FROM adsl""",
)
def score_without_model(t: OrderTrial) -> DataFrame:
    """All subjects while no model is fitted."""
    return score(t.adsl.select("USUBJID"), None)


@query(
    "validate_ranges",
    f"""SELECT USUBJID, REASONS, CASE WHEN REASONS = '' THEN 'valid' ELSE 'rejected' END AS VERDICT
    FROM (SELECT USUBJID, {range_sql()} AS REASONS FROM adsl)""",
)
def validate_ranges(t: OrderTrial) -> DataFrame:
    checked = R.validate_ranges(t.adsl.select("USUBJID", *S.FEATURES))
    verdict = F.when(F.size("REASONS") == 0, "valid").otherwise("rejected")
    return checked.select(
        "USUBJID", F.concat_ws(";", "REASONS").alias("REASONS"), verdict.alias("VERDICT")
    )


@query(
    "round_numeric",
    "SELECT USUBJID, AGE, round(COMPLPCT, 3) AS COMPLPCT, round(WEIGHTBL / HEIGHTBL, 3) AS RATIO FROM adsl",
)
def round_numeric(t: OrderTrial) -> DataFrame:
    wide = t.adsl.select(
        "USUBJID", "AGE", "COMPLPCT", (c("WEIGHTBL") / c("HEIGHTBL")).alias("RATIO")
    )
    return R.round_numeric(wide, 3)


@query(
    "with_constants",
    "SELECT event_id, 'TRIAL-01' AS STUDYID, 'QS' AS DOMAIN, 'ADQS' AS DATASET FROM events",
)
def with_constants(t: OrderTrial) -> DataFrame:
    return R.with_constants(
        t.table("events").select("event_id"), STUDYID=STUDY, DOMAIN="QS", DATASET="ADQS"
    )


@query(
    "result_text",
    "SELECT VSREFID, printf('%.2f', VSSTRESN) AS VSSTRESC FROM vs",
)
def result_text(t: OrderTrial) -> DataFrame:
    return t.vs.select("VSREFID", X.result_text(c("VSSTRESN"), 2).alias("VSSTRESC"))

"""Sequence numbers, ordering, top rows, sampling and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialspark import schema as S
from trialspark.operators import explain, numbering as W, reshape as G, tables as T
from trialspark.operators.evaluate import binary_metrics
from trialspark.operators.rows import population, round_numeric
from trialspark.plans.catalog.registry import query
from trialspark.plans.order_trial import OrderTrial

# Feature weights standing in for a fitted model's importances.
WEIGHTS = dict(
    zip(S.FEATURES, [0.06, 0.01, 0.02, 0.02, 0.11, 0.09, 0.05, 0.14, 0.07, 0.13, 0.04, 0.05, 0.16, 0.05])
)


@query("sequence_within", "SELECT USUBJID, AESEQ, AEDECOD, AESEV, AESTDTC, AEENDTC FROM ae")
def sequence_within(t: OrderTrial) -> DataFrame:
    return t.ae_sequenced.select("USUBJID", "AESEQ", "AEDECOD", "AESEV", "AESTDTC", "AEENDTC")


@query(
    "global_sequence",
    """SELECT USUBJID, SITEID, row_number() OVER (ORDER BY SITEID, USUBJID) AS DMSEQ FROM dm""",
)
def global_sequence(t: OrderTrial) -> DataFrame:
    site = t.subjects.select(
        F.col("c_custkey").alias("USUBJID"), F.col("c_nationkey").cast("string").alias("SITEID")
    )
    return W.global_sequence(site, "SITEID", ["USUBJID"], "DMSEQ")


@query("allocate_arms", "SELECT USUBJID, TRT01PN FROM dm")
def allocate_arms(t: OrderTrial) -> DataFrame:
    out = W.allocate_arms(t.subjects, "c_nationkey", ["c_custkey"])
    return out.select(F.col("c_custkey").alias("USUBJID"), "TRT01PN")


@query(
    "first_last",
    """SELECT USUBJID, EXREFID,
    CASE WHEN row_number() OVER (PARTITION BY USUBJID ORDER BY EXSTDTC, EXREFID) = 1 THEN 'Y' ELSE 'N' END AS FIRSTFL,
    CASE WHEN row_number() OVER (PARTITION BY USUBJID ORDER BY EXSTDTC DESC, EXREFID DESC) = 1 THEN 'Y' ELSE 'N' END AS LASTFL
    FROM ex""",
)
def first_last(t: OrderTrial) -> DataFrame:
    flagged = W.first_last(t.ex.select("USUBJID", "EXSTDTC", "EXREFID"), "USUBJID", ["EXSTDTC", "EXREFID"])
    return flagged.drop("EXSTDTC")


@query(
    "first_last_split",
    """SELECT USUBJID, EXREFID,
    CASE WHEN row_number() OVER (PARTITION BY USUBJID ORDER BY EXSTDTC, EXREFID) = 1 THEN 'Y' ELSE 'N' END AS FIRSTFL,
    CASE WHEN row_number() OVER (PARTITION BY USUBJID ORDER BY EXSTDTC DESC, EXREFID DESC) = 1 THEN 'Y' ELSE 'N' END AS LASTFL
    FROM ex""",
)
def first_last_split(t: OrderTrial) -> DataFrame:
    """The same flags with every larger subject split into date ranges."""
    flagged = W.first_last(
        t.ex.select("USUBJID", "EXSTDTC", "EXREFID"), "USUBJID", ["EXSTDTC", "EXREFID"],
        min_rows=4,
    )
    return flagged.drop("EXSTDTC")


@query("ordered", "SELECT SITEID, USUBJID, TRT01P, DPTFL FROM adsl ORDER BY SITEID, USUBJID")
def ordered(t: OrderTrial) -> DataFrame:
    return G.ordered(t.adsl.select("SITEID", "USUBJID", "TRT01P", "DPTFL"), ["SITEID", "USUBJID"])


METRICS_SQL = """
, judged AS (
  SELECT 'additive rule' AS MODEL, DPTN, DROPOUT_PROB FROM scored WHERE ITTFL = 'Y' UNION ALL
  SELECT 'missed doses', DPTN, least(1.0::DOUBLE, N_MISSED_DOSES * 0.25::DOUBLE) FROM scored WHERE ITTFL = 'Y'),
ranked AS (
  SELECT MODEL, DROPOUT_PROB, sum(DPTN) AS p, count(*) - sum(DPTN) AS q FROM judged GROUP BY ALL),
cum AS (SELECT *, sum(q) OVER (PARTITION BY MODEL ORDER BY DROPOUT_PROB) - q / 2.0::DOUBLE AS below FROM ranked),
auc AS (SELECT MODEL, round(sum(p * below) / (CAST(sum(p) AS DOUBLE) * sum(q)), 6) AS ROC_AUC FROM cum GROUP BY MODEL),
conf AS (
  SELECT MODEL, count(*) FILTER (WHERE DPTN = 1 AND DROPOUT_PROB >= 0.5::DOUBLE) AS tp,
    count(*) FILTER (WHERE DPTN = 0 AND DROPOUT_PROB >= 0.5::DOUBLE) AS fp,
    count(*) FILTER (WHERE DPTN = 1 AND DROPOUT_PROB < 0.5::DOUBLE) AS fn,
    count(*) FILTER (WHERE DPTN = 0 AND DROPOUT_PROB < 0.5::DOUBLE) AS tn FROM judged GROUP BY MODEL),
metrics AS (
  SELECT MODEL, ROC_AUC, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS ACCURACY,
    round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS F1
  FROM auc JOIN conf USING (MODEL))
"""


def rule_models(t: OrderTrial) -> dict[str, DataFrame]:
    """Two rules judged on the same subjects: the additive score, and a quarter for each missed dose."""
    scored = population(t.scored, "ITT")
    missed = F.least(F.lit(1.0), F.col("N_MISSED_DOSES") * 0.25)
    return {"additive rule": scored, "missed doses": scored.withColumn("DROPOUT_PROB", missed)}


def rule_metrics(t: OrderTrial) -> DataFrame:
    return round_numeric(
        G.union_all([binary_metrics(df, model=m) for m, df in rule_models(t).items()]), 6
    )


@query("best_model", METRICS_SQL + "SELECT * FROM metrics ORDER BY ROC_AUC DESC, MODEL LIMIT 1")
def best_model(t: OrderTrial) -> DataFrame:
    return G.best_model(rule_metrics(t))


CONTRIBUTIONS_SQL = (
    ", contrib AS ("
    + " UNION ALL ".join(
        f"""SELECT USUBJID, DROPOUT_PROB AS PREDICTION, {i} AS pos, '{f}' AS FEATURE, CAST({f} AS DOUBLE) AS VALUE,
        {w}::DOUBLE * (DROPOUT_PROB - 0.5::DOUBLE) AS CONTRIBUTION FROM scored"""
        for i, (f, w) in enumerate(WEIGHTS.items())
    )
    + "), named AS (SELECT *, CASE WHEN CONTRIBUTION > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS DIRECTION FROM contrib)\n"
)


def contributions(t: OrderTrial) -> DataFrame:
    return explain.importance_contributions(t.scored, WEIGHTS)


@query(
    "top_factors",
    CONTRIBUTIONS_SQL
    + """, shown AS (SELECT *, round(CONTRIBUTION, 4) + 0.0 AS c4 FROM named),
    big AS (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY USUBJID ORDER BY abs(c4) DESC, pos) <= 10),
    sided AS (SELECT *, row_number() OVER (PARTITION BY USUBJID, DIRECTION ORDER BY abs(c4) DESC, pos) AS rk FROM big)
    SELECT USUBJID, CASE DIRECTION WHEN 'increases_risk' THEN 'risk' ELSE 'protective' END AS SIDE,
    CAST(rk AS INTEGER) AS RANK, FEATURE, VALUE, c4 AS CONTRIBUTION FROM sided WHERE rk <= 5""",
)
def top_factors(t: OrderTrial) -> DataFrame:
    listed = explain.factor_rows(explain.top_factors(contributions(t)))
    return listed.drop("LABEL", "DIRECTION")


@query(
    "sample_subjects",
    """SELECT USUBJID, TRT01P, DPTFL FROM adsl ORDER BY md5('42' || USUBJID), USUBJID LIMIT 80""",
)
def sample_subjects(t: OrderTrial) -> DataFrame:
    return G.sample_subjects(t.adsl.select("USUBJID", "TRT01P", "DPTFL"), 80)


@query(
    "union_all",
    """SELECT 'AE' AS DOMAIN, USUBJID, AESTDTC AS DTC FROM ae UNION ALL
    SELECT 'EX', USUBJID, EXSTDTC FROM ex UNION ALL SELECT 'DS', USUBJID, DSSTDTC FROM ds""",
)
def union_all(t: OrderTrial) -> DataFrame:
    return G.union_all(
        [
            t.ae.select("DOMAIN", "USUBJID", F.col("AESTDTC").alias("DTC")),
            t.ex.select("DOMAIN", "USUBJID", F.col("EXSTDTC").alias("DTC")),
            t.ds.select("DOMAIN", "USUBJID", F.col("DSSTDTC").alias("DTC")),
        ]
    )


@query(
    "pivot_wide",
    """SELECT SITEID, coalesce(max(N) FILTER (WHERE DSDECOD = 'COMPLETED'), 0) AS COMPLETED,
    coalesce(max(N) FILTER (WHERE DSDECOD = 'WITHDRAWAL BY SUBJECT'), 0) AS "WITHDRAWAL BY SUBJECT",
    coalesce(max(N) FILTER (WHERE DSDECOD = 'LOST TO FOLLOW-UP'), 0) AS "LOST TO FOLLOW-UP"
    FROM (SELECT SITEID, DSDECOD, count(*) AS N FROM adsl GROUP BY ALL) GROUP BY SITEID""",
)
def pivot_wide(t: OrderTrial) -> DataFrame:
    counts = t.adsl.groupBy("SITEID", "DSDECOD").agg(F.count(F.lit(1)).alias("N"))
    terms = ["COMPLETED", "WITHDRAWAL BY SUBJECT", "LOST TO FOLLOW-UP"]
    return G.pivot_wide(counts, ["SITEID"], "DSDECOD", "N", terms, fill=0)


@query(
    "pivot_long",
    " UNION ALL ".join(
        f"SELECT USUBJID, '{f}' AS FEATURE, CAST({f} AS DOUBLE) AS VALUE FROM frame"
        for f in S.FEATURES
    ),
)
def pivot_long(t: OrderTrial) -> DataFrame:
    return G.pivot_long(t.frame, ["USUBJID"], S.FEATURES)

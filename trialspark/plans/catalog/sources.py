"""Sources and sinks: round trips, lookups, registration, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialspark import schema as S
from trialspark.functions import adverse_event_propensity
from trialspark.operators.reshape import head_rows
from trialspark.operators.rows import cross_with_dictionary, round_numeric
from trialspark.operators.tables import dataset_inventory, dataset_profile
from trialspark.plans.catalog.registry import query
from trialspark.plans.order_trial import STUDY, OrderTrial
from trialspark.sources import domains as D


def _without_sequence() -> "D.T.StructType":
    fields = [f for f in S.DM.fields if f.name not in ("DMSEQ",)]
    return D.T.StructType(fields)


@query(
    "read_domain",
    """SELECT * REPLACE (CAST(USUBJID AS VARCHAR) AS USUBJID), TRT01P AS ARM, TRT01P AS ACTARM FROM dm""",
)
def read_domain(t: OrderTrial) -> DataFrame:
    """Demographics written as CSV and read back with the declared schema."""
    path = D.write_domain(t.dm, D.shared_folder(t.spark, "dm") + ".csv", "csv")
    return D.read_domain(t.spark, path, _without_sequence())


@query("write_domain", "SELECT USUBJID, DSDECOD, DSSTDTC, EOSSTT, DPTFL, STUDYID, DOMAIN FROM ds")
def write_domain(t: OrderTrial) -> DataFrame:
    """Disposition written as Parquet, partitioned by status, and read back."""
    path = D.write_domain(t.ds, D.shared_folder(t.spark, "ds"), partition_by=["EOSSTT"])
    return D.read_domain(t.spark, path)


INPUTS = ["customer", "orders", "lineitem", "part", "nation", "region", "events"]


@query(
    "require_inputs",
    " UNION ALL ".join(
        f"SELECT '{n}' AS DATASET, '{n}' AS DOMAIN, count(*) AS RECORDS FROM {n}" for n in INPUTS
    ),
)
def require_inputs(t: OrderTrial) -> DataFrame:
    """Records per required input, once all inputs are known to exist."""
    found = D.require_inputs(t.spark, {n: f"{t.folder}/{n}.parquet" for n in INPUTS})
    frames = {n: t.spark.read.parquet(p) for n, p in found.items()}
    return dataset_inventory(frames, {})


@query(
    "export_risk_table",
    """SELECT CAST(USUBJID AS VARCHAR) AS USUBJID, SITEID, TRT01P, AGE, SEX, AENUM, AEMAXSEVN, COMPLPCT,
    DROPOUT_PROB, RISK_TIER FROM scored""",
)
def export_risk_table(t: OrderTrial) -> DataFrame:
    """Dated CSV export of all scored subjects, read back with types."""
    path = D.export_risk_table(t.scored, D.shared_folder(t.spark, "export"), STUDY)
    schema = D.T.StructType(
        [
            S.ADSL[c] if c in S.ADSL.fieldNames() else D.T.StructField(c, kind)
            for c, kind in zip(
                D.RISK_COLUMNS, [None] * 8 + [D.T.DoubleType(), D.T.StringType()]
            )
        ]
    )
    return D.read_domain(t.spark, path, schema)


SITE_VALUES = ", ".join(f"('{s}', '{c}', '{r}', {n})" for s, c, r, n in S.SITES)
TERM_VALUES = ", ".join(
    f"('{a.replace('_', ' ')}', '{b.replace('_', ' ')}', {p}::DOUBLE, {q}::DOUBLE)"
    for a, b, p, q in S.TERMS
)


@query(
    "site_dictionary",
    f""", sites(SITE, SITE_COUNTRY, SITE_REGION, PLANNED) AS (VALUES {SITE_VALUES})
    SELECT SITE, SITE_COUNTRY, SITE_REGION, PLANNED, count(*) AS ENROLLED
    FROM dm JOIN sites ON CAST(101 + CAST(SITEID AS INTEGER) % 8 AS VARCHAR) = SITE
    GROUP BY ALL""",
)
def site_dictionary(t: OrderTrial) -> DataFrame:
    """Subjects enrolled per dictionary site against the planned number."""
    sites = D.site_dictionary(t.spark).toDF("SITE", "SITE_COUNTRY", "SITE_REGION", "PLANNED")
    site = (F.col("SITEID").cast("int") % 8 + 101).cast("string")
    enrolled = t.dm.groupBy(site.alias("SITE")).agg(F.count(F.lit(1)).alias("ENROLLED"))
    return sites.join(enrolled, "SITE")


@query(
    "term_dictionary",
    f""", terms(AEDECOD, AEBODSYS, BASE, SEV) AS (VALUES {TERM_VALUES})
    SELECT AEDECOD, AEBODSYS, round(sum(least(0.6::DOUBLE, BASE * (1 + TRT01PN * 0.18::DOUBLE)
      * (1 + greatest(0, (AGE - 45) * 0.008::DOUBLE))
      * (1 + greatest(0, (coalesce(DASCR, 4.5) - 4.5::DOUBLE) * 0.06::DOUBLE)))), 4) AS EXPECTED
    FROM dm CROSS JOIN terms GROUP BY AEDECOD, AEBODSYS""",
)
def term_dictionary(t: OrderTrial) -> DataFrame:
    """Expected number of subjects per dictionary term."""
    pairs = cross_with_dictionary(t.dm, D.term_entries(), D.TERM_KIND)
    expected = adverse_event_propensity(
        F.col("BASE_PROB"), F.col("TRT01PN"), F.col("AGE"), F.coalesce("DASCR", F.lit(4.5))
    )
    table = pairs.groupBy("AEDECOD", "AEBODSYS").agg(F.sum(expected).alias("EXPECTED"))
    return round_numeric(table, 4)


@query(
    "register_domains",
    """SELECT dm.TRT01P, count(*) AS N, CAST(sum(CASE WHEN DPTFL = 'Y' THEN 1 ELSE 0 END) AS BIGINT) AS N_DROPOUT
    FROM dm JOIN ds ON dm.USUBJID = ds.USUBJID GROUP BY dm.TRT01P""",
)
def register_domains(t: OrderTrial) -> DataFrame:
    """Registered domains joined in SQL."""
    D.register_domains(t.spark, {"dm": t.dm, "ds": t.ds}, prefix="trial_")
    return t.spark.sql(
        """SELECT m.TRT01P, count(*) AS N, sum(if(s.DPTFL = 'Y', 1, 0)) AS N_DROPOUT
        FROM trial_dm m JOIN trial_ds s ON m.USUBJID = s.USUBJID GROUP BY m.TRT01P"""
    )


@query(
    "dataset_profile",
    f"""SELECT count(*) AS N_SUBJECTS, avg(CASE WHEN DPTFL = 'Y' THEN 100.0::DOUBLE ELSE 0 END) AS FLAG_RATE,
    '{",".join(S.ADSL.fieldNames())}' AS COLUMNS FROM adsl""",
)
def profile(t: OrderTrial) -> DataFrame:
    return dataset_profile(t.adsl)


@query("head_rows", "SELECT * FROM adsl ORDER BY USUBJID LIMIT 20")
def first_rows(t: OrderTrial) -> DataFrame:
    return head_rows(t.adsl, ["USUBJID"], 20)


@query(
    "dataset_inventory",
    """SELECT 'DM' AS DATASET, 'Demographics' AS DOMAIN, count(*) AS RECORDS FROM dm UNION ALL
    SELECT 'AE', 'Adverse Events', count(*) FROM ae UNION ALL
    SELECT 'EX', 'Exposure', count(*) FROM ex UNION ALL
    SELECT 'VS', 'Vital Signs', count(*) FROM vs UNION ALL
    SELECT 'DS', 'Disposition', count(*) FROM ds UNION ALL
    SELECT 'ADSL', 'Subject Level', count(*) FROM adsl UNION ALL
    SELECT 'ADAE', 'AE Analysis', count(*) FROM adae""",
)
def inventory(t: OrderTrial) -> DataFrame:
    frames = {
        "DM": t.dm, "AE": t.ae, "EX": t.ex, "VS": t.vs, "DS": t.ds, "ADSL": t.adsl,
        "ADAE": t.adae_unsequenced,
    }
    return dataset_inventory(frames, S.DOMAIN_TEXT)

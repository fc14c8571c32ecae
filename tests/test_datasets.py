"""Analysis datasets, tables and checks on hand-written domains."""

import pytest
from pyspark.sql import functions as F

from trialspark import schema as S
from trialspark import functions as X
from trialspark.functions import arm_text, build_usubjid
from trialspark.operators import adam, checks as H, numbering as W, rows as R, tables as T
from trialspark.sources.domains import TERM_KIND, site_dictionary, term_entries

ARMS = {0: "Placebo", 1: "DRUG 100mg", 2: "DRUG 200mg"}


def domain(spark, schema, rows):
    """Frame of a declared schema from partial rows."""
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.fixture(scope="module")
def trial(spark):
    def subject(n, arm, **more):
        base = dict(
            STUDYID="ST", DOMAIN="DM", USUBJID=f"ST-101-{n:03d}", SUBJID=f"{n:03d}", SITEID="101",
            COUNTRY="USA", REGION="Americas", AGE=50, AGEGR1="40-64", SEX="F", RACE="WHITE",
            ETHNIC="NOT HISPANIC OR LATINO", BMIBL=22.0, DASCR=5.2, DASGRP="High",
            TRT01P=ARMS[arm], TRT01PN=arm, RFSTDTC="2023-03-10", RFENDTC="2023-08-25",
            SAFFL="Y", ITTFL="Y", PPROTFL="Y", DMSEQ=n,
        )
        return {**base, **more}

    def event(n, term, sev, ser="N", start="2023-03-20", seq=1):
        return dict(
            STUDYID="ST", DOMAIN="AE", USUBJID=f"ST-101-{n:03d}", AESEQ=seq, AEDECOD=term,
            AEBODSYS="SOC", AESEV=sev, AESER=ser, AESTDTC=start, AEENDTC=start, VISITNUM=1,
        )

    dm = domain(spark, S.DM, [
        subject(1, 0), subject(2, 1, SEX="M", BMIBL=None, RACE="OTHER"),
        subject(3, 2, REGION="Europe", BMIBL=30.0), subject(4, 0, REGION="AsiaPacific"),
    ])
    ae = domain(spark, S.AE, [
        event(1, "Headache", "MILD", start="2023-03-10", seq=1),
        event(1, "ALT Increased", "SEVERE", "Y", start="2023-03-09", seq=2),
        event(1, "Nausea", "MODERATE", start="bad", seq=3),
        event(2, "Rash", None, None, seq=1),
        event(2, "Rash", "MILD", seq=2),
        event(9, "Rash", "MILD"),
    ])
    ex = domain(spark, S.EX, [
        *[dict(USUBJID="ST-101-001", EXOCCUR=v) for v in "YYYYYN"],
        *[dict(USUBJID="ST-101-002", EXOCCUR=v) for v in ["Y", "Y", "Y", "Y", "N", None]],
        dict(USUBJID="ST-101-003", EXOCCUR="N"),
    ])

    def measure(n, visit, value, test="DAS28"):
        return dict(USUBJID=f"ST-101-{n:03d}", VSTESTCD=test, VISITNUM=visit, VSSTRESN=value)

    vs = domain(spark, S.VS, [
        measure(1, 0, 6.0), measure(1, 3, 5.5), measure(1, 6, 4.5), measure(1, 7, 1.0, "TJC28"),
        measure(2, 0, 5.0),
        measure(3, 1, 5.0), measure(3, 6, 3.0),
    ])

    def end(n, term, flag, day):
        return dict(
            USUBJID=f"ST-101-{n:03d}", DSDECOD=term, DPTFL=flag, DSSTDTC=day,
            EOSSTT="COMPLETED" if flag == "N" else "DISCONTINUED",
        )

    ds = domain(spark, S.DS, [
        end(1, "ADVERSE EVENT", "Y", "2023-04-01"), end(2, "COMPLETED", "N", "2023-08-25"),
        end(3, "COMPLETED", "Y", "2023-05-01"), end(4, None, "N", None),
    ])
    adsl = adam.build_adsl(dm, ds, ae, ex, vs)
    return dict(dm=dm, ae=ae, ex=ex, vs=vs, ds=ds, adsl=adsl, adae=adam.build_adae(ae, adsl))


def by_subject(df):
    return {r["USUBJID"][-1]: r for r in df.collect()}


def test_adsl(trial):
    got = by_subject(trial["adsl"])
    assert trial["adsl"].columns == S.ADSL.fieldNames()
    a, b, c, d = (got[k] for k in "1234")
    assert (a["AENUM"], a["AESNUM"], a["AEMAXSEVN"], a["AEMAXSEV"]) == (3, 1, 3, "SEVERE")
    assert (a["N_ALT_AE"], a["N_NEURO_GI_AE"]) == (1, 2)
    assert a["COMPLPCT"] == pytest.approx(83.3333333) and a["COMPLFL"] == "Compliant"
    assert a["N_MISSED_DOSES"] == 1
    assert a["DAS28CHG"] == -1.5 and a["ACR20FL"] == "RESPONDER"
    assert (a["DPTN"], a["SEXN"], a["RACEN"], a["REGIONN"]) == (1, 1, 1, 0)
    # A missing severity or seriousness counts as mild and not serious.
    assert (b["AENUM"], b["AESNUM"], b["AEMAXSEV"]) == (2, 0, "MILD")
    assert b["COMPLPCT"] == pytest.approx(66.6666667) and b["COMPLFL"] == "Non-Compliant"
    assert b["N_MISSED_DOSES"] == 1 and b["BMIGRP"] is None
    assert b["DAS28CHG"] == 0.0 and b["ACR20FL"] == "NON-RESPONDER"
    assert (b["SEXN"], b["RACEN"]) == (2, 4)
    # No baseline measurement, no events, no doses.
    assert c["DAS28CHG"] == 0.0 and c["ACR20FL"] == "UNKNOWN" and c["BMIGRP"] == "Obese"
    assert (c["REGIONN"], d["REGIONN"]) == (1, 2)
    assert (d["AENUM"], d["AEMAXSEVN"], d["AEMAXSEV"]) == (0, 0, "NONE")
    assert d["COMPLPCT"] == 100.0 and d["COMPLFL"] == "Compliant" and d["DPTN"] == 0


def test_adae_drops_orphans_and_flags_emergence(trial):
    got = trial["adae"].collect()
    assert trial["adae"].columns == S.ADAE.fieldNames()
    assert len(got) == 5 and not [r for r in got if r["USUBJID"].endswith("9")]
    flags = {(r["USUBJID"][-1], r["AESEQ"]): r["TRTEMFL"] for r in got}
    assert flags == {("1", 1): "Y", ("1", 2): "N", ("1", 3): "N", ("2", 1): "Y", ("2", 2): "Y"}


def test_teae_tables(trial):
    rows = {r["CATEGORY"]: r for r in T.teae_overall(trial["ae"], trial["adsl"]).collect()}
    pick = lambda r: (r["N_PLC"], r["N_LOW"], r["N_HIGH"], r["N_TOTAL"])
    assert pick(rows["Any TEAE"]) == (1, 1, 0, 2)
    assert pick(rows["Any Serious TEAE"]) == (0, 0, 0, 0)
    assert pick(rows["Any TEAE Leading to Dropout"]) == (1, 0, 0, 1)
    terms = {r["AEDECOD"]: pick(r) for r in T.teae_by_term(trial["ae"], trial["adsl"], min_n=1).collect()}
    assert terms == {"Headache": (1, 0, 0, 1), "Rash": (0, 1, 0, 1)}
    assert T.teae_by_term(trial["ae"], trial["adsl"]).count() == 0
    half = T.teae_by_term(
        trial["ae"], trial["adsl"], min_pct=60.0, denominators=T.arm_denominators(trial["adsl"])
    )
    assert [r["AEDECOD"] for r in half.collect()] == ["Rash"]


def test_dropout_tables(trial):
    rows = {r["TRT01PN"]: r for r in T.dropout_by_arm(trial["adsl"]).collect()}
    assert (rows[0]["N_TOTAL"], rows[0]["N_DROPOUT"], rows[0]["PCT_DROPOUT"]) == (2, 1, 50.0)
    wide = {r["TRT01P"]: (r["N"], r["Y"]) for r in T.arm_by_status(trial["adsl"]).collect()}
    assert wide == {"Placebo": (1, 1), "DRUG 100mg": (1, 0), "DRUG 200mg": (0, 1)}
    site = T.site_summary(trial["adsl"], ("SITEID",)).first()
    assert (site["N_TOTAL"], site["PCT_DROPOUT"], site["OVER_TARGET"]) == (4, 50.0, "Y")


def test_histogram_bins(spark):
    df = spark.createDataFrame(
        [(v,) for v in (77.5, 77.6, 80.0, 82.5, 82.6, 100.0, None)], "v double"
    ).withColumn("arm", F.lit("a"))
    got = {r["BIN"]: (r["N"], r["N_BELOW"]) for r in T.histogram(df, "v", "arm").collect()}
    assert got == {75.0: (1, 1), 80.0: (3, 1), 85.0: (1, 0), 100.0: (1, 0)}


def test_categorical_summary_drops_incomplete_rows(spark):
    df = spark.createDataFrame(
        [("P", "F", "x"), ("P", "M", "x"), ("D", "F", None), ("D", "F", "y")],
        "TRT01P string, SEX string, G string",
    )
    got = {
        (r["VARIABLE"], r["LEVEL"], r["TRT01P"]): (r["N"], r["PCT_ROW"], r["PCT_COL"])
        for r in T.categorical_summary(df, ["SEX", "G"]).collect()
    }
    assert got[("SEX", "F", "P")] == (1, 50.0, 50.0)
    assert got[("SEX", "F", "D")] == (1, 50.0, 100.0)


def test_checks_find_planted_issues(spark, trial):
    log = H.validation_suite(
        spark, trial["dm"], trial["ae"], trial["adsl"].unionByName(trial["adsl"].limit(1)),
        r"^ST-\d{3}-\d{3}$",
    )
    assert log.columns == S.VALIDATION_LOG.fieldNames()
    got = {r["CHECK_ID"]: (r["STATUS"], r["N_ISSUES"]) for r in log.collect()}
    assert len(got) == 10
    assert got["CHK-01"] == ("PASS", 0) and got["CHK-02"] == ("PASS", 0)
    assert got["CHK-03"] == ("FAIL", 1)
    assert got["CHK-04"][0] == "FAIL" and got["CHK-04"][1] >= 2
    assert got["CHK-05"] == ("PASS", 0)
    assert got["CHK-06"] == ("FAIL", 1)
    assert got["CHK-07"] == ("PASS", 2) or got["CHK-07"] == ("PASS", 1)
    assert got["CHK-08"] == ("PASS", 0) and got["CHK-09"] == ("PASS", 0)
    assert got["CHK-10"] == ("FAIL", 1)
    totals = H.validation_rollup(log, trial["adsl"], trial["ae"]).first()
    assert (totals["N_PASS"], totals["N_FAIL"], totals["N_WARN"]) == (6, 4, 0)
    assert (totals["N_SUBJ"], totals["N_AE"], totals["N_DROPOUT"]) == (4, 6, 2)


def test_required_columns_lists_missing(spark, trial):
    row = H.check_required_columns(spark, trial["dm"].drop("SEX", "RACE")).first()
    assert (row["STATUS"], row["N_ISSUES"], row["DETAILS"]) == ("FAIL", 2, "absent columns: SEX RACE")


def test_unique_counts_missing_ids(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "USUBJID string")
    assert H.check_unique(df).first()["N_ISSUES"] == 3


def test_flag_clash_with_missing_term(spark):
    df = spark.createDataFrame(
        [("Y", "COMPLETED"), ("N", None), ("N", "COMPLETED"), ("Y", "OTHER"), ("Y", None)],
        "DPTFL string, DSDECOD string",
    )
    assert H.check_flag_consistency(df).first()["N_ISSUES"] == 2


def test_empty_domain_passes(spark):
    empty = spark.createDataFrame([], S.ADSL)
    assert H.check_range(empty).first()["STATUS"] == "PASS"
    assert H.check_arm_balance(empty).first()["N_ISSUES"] == 0


@pytest.fixture(scope="module")
def planned(spark):
    """The planned study: every site with its number of subjects, arms rotated within site."""
    sites = site_dictionary(spark).withColumn("n", F.explode(F.sequence(F.lit(1), "N_SUBJ")))
    dm = W.allocate_arms(sites, "SITEID", ["n"]).withColumns(
        {"USUBJID": build_usubjid("ST", F.col("SITEID"), F.col("n")),
         "TRT01P": arm_text(F.col("TRT01PN"), "DRUG"), "RFSTDTC": F.lit("2023-01-01")}
    )
    return W.global_sequence(dm, "SITEID", ["n"], "DMSEQ")


def test_planned_study_sizes(planned):
    sizes = {r["TRT01PN"]: r["count"] for r in planned.groupBy("TRT01PN").count().collect()}
    assert sizes == {0: 96, 1: 94, 2: 90}
    assert planned.agg(F.max("DMSEQ"), F.countDistinct("DMSEQ")).first()[:] == (280, 280)
    balance = H.check_arm_balance(planned).first()
    assert (balance["STATUS"], balance["N_ISSUES"]) == ("WARN", 6)


def test_planned_visits(planned):
    visits = R.expand_visits(planned, "RFSTDTC")
    assert visits.count() == 1680
    first = visits.filter("VISITNUM = 2").first()
    assert (first["VISIT"], first["EXSTDTC"], first["EXENDTC"]) == (
        "WEEK 8", "2023-01-29", "2023-02-25",
    )
    screening = R.expand_visits(planned, "RFSTDTC", 0, 6, prefix="VS").withColumns(
        {"DAS": F.lit(5.25), "TJC": F.lit(7), "SJC": F.lit(6)}
    )
    tests = [(c, n, u, v, d) for (c, n, u, d), v in zip(S.VISIT_TESTS, ["DAS", "TJC", "SJC"])]
    long = R.expand_tests(screening, tests)
    assert long.count() == 5880
    texts = {r["VSTESTCD"]: r["VSSTRESC"] for r in long.limit(3).collect()}
    assert texts["TJC28"] == "7"
    assert R.cross_with_dictionary(planned, term_entries(), TERM_KIND).count() == 2800


def test_orphans_keep_rows_without_key(spark):
    child = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    parent = spark.createDataFrame([("a",)], "k string")
    assert sorted(r["v"] for r in R.orphans(child, parent, "k").collect()) == [2, 3]


def test_validate_ranges(spark):
    good = dict(AGE=58.0, SEXN=1, RACEN=1, REGIONN=1, DAS28BL=6.2, BMIBL=28.1, TRT01PN=2,
                AENUM=5, AESNUM=1, AEMAXSEVN=3, COMPLPCT=68.0)
    rows = [good, {**good, "AGE": 17.0}, {**good, "COMPLPCT": None}, {**good, "SEXN": 3}]
    names = list(good)
    kinds = ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame(
        [tuple(None if r[n] is None else float(r[n]) for n in names) for r in rows], kinds
    )
    checked = R.validate_ranges(df)
    assert sorted(r["REASONS"][0] for r in R.rejected_rows(checked).collect()) == [
        "AGE low", "COMPLPCT missing", "SEXN high",
    ]
    valid = R.valid_rows(checked).collect()
    assert len(valid) == 1 and valid[0]["N_MISSED_DOSES"] == 0.0


def test_labels(spark, trial):
    labels = R.column_labels(R.attach_labels(trial["adsl"]))
    assert labels["AENUM"] == "Total AE Count" and "COUNTRY" not in labels


def test_missing_measurement_has_no_text(spark):
    df = spark.createDataFrame([("1", 2.25, None)], "USUBJID string, a double, b double")
    tests = [("A", "Test A", "u", "a", 1), ("B", "Test B", "u", "b", 0)]
    got = {r["VSTESTCD"]: (r["VSSTRESN"], r["VSSTRESC"]) for r in R.expand_tests(df, tests).collect()}
    assert got["B"] == (None, None) and got["A"][0] == 2.25 and got["A"][1] in ("2.2", "2.3")


def test_arm_named_like_the_overall_row_and_missing_arm(spark):
    rows = [("All", 1.0), ("All", 3.0), (None, 10.0), (None, 20.0)]
    df = spark.createDataFrame(rows, "TRT01P string, x double")
    got = {(r["OVERALL"], r["ARM"]): (r["N"], r["MEDIAN"]) for r in T.continuous_summary(df, ["x"]).collect()}
    assert got == {("N", "All"): (2, 2.0), ("N", None): (2, 15.0), ("Y", "All"): (4, 6.5)}


def test_emergence_without_dates(spark):
    df = spark.createDataFrame(
        [("2023-01-05", "2023-01-01"), ("2023-01-05", None), (None, "2023-01-01"), (None, None)], "a string, b string"
    )
    got = [r[0] for r in df.select(X.treatment_emergent(F.col("a"), F.col("b"))).collect()]
    assert got == ["Y", "Y", "N", "N"]

"""The whole pipeline on generated CSV domains of a small study."""

import pytest
from pyspark.sql import functions as F

from trialspark import schema as S
from trialspark.functions import arm_text, band, bmi, build_usubjid, iso_text, shift_days
from trialspark.operators import numbering as W, rows as R
from trialspark.plans.study import run_study
from trialspark.sources.domains import TERM_KIND, site_dictionary, term_entries, write_domain


def pick(key, n):
    """Number below n from a hash of the key columns: a fixed choice for each row."""
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("study")
    sites = site_dictionary(spark).withColumn("n", F.explode(F.sequence(F.lit(1), "N_SUBJ")))
    dm = W.global_sequence(W.allocate_arms(sites, "SITEID", ["n"]), "SITEID", ["n"], "DMSEQ")
    c, key = F.col, ["SITEID", "n"]
    start = shift_days(F.lit("2023-01-01").cast("date"), pick(key, 180))
    dm = dm.withColumns({
        "USUBJID": build_usubjid("ST", c("SITEID"), c("n")), "STUDYID": F.lit("ST"),
        "DOMAIN": F.lit("DM"), "SUBJID": F.format_string("%03d", "n"),
        "AGE": pick(["n", "SITEID"], 46) + 25, "SEX": F.when(pick(key, 5) < 3, "F").otherwise("M"),
        "RACE": F.lit("WHITE"), "ETHNIC": F.lit("NOT HISPANIC OR LATINO"),
        "HEIGHTBL": (pick(key, 30) + 155).cast("double"),
        "WEIGHTBL": (pick(["n"], 50) + 50).cast("double"),
        "DASCR": pick([*key, "REGION"], 60) / 10 + 2.0,
        "TRT01P": arm_text(c("TRT01PN"), "DRUG"),
        "RFSTDTC": iso_text(start), "RFENDTC": iso_text(shift_days(start, 168)),
        "SAFFL": F.lit("Y"), "ITTFL": F.lit("Y"), "PPROTFL": F.lit("Y"),
    })
    dm = dm.withColumns({
        "AGEGR1": band(c("AGE"), *S.AGE_BANDS), "BMIBL": bmi(c("WEIGHTBL"), c("HEIGHTBL")),
        "DASGRP": band(c("DASCR"), *S.DAS28_BANDS), "ARM": c("TRT01P"), "ACTARM": c("TRT01P"),
    })
    id_term = ["USUBJID", "AEDECOD"]
    ae = R.cross_with_dictionary(dm, term_entries(), TERM_KIND).filter(pick(id_term, 4) == 0)
    ae = ae.withColumns({
        "AESEV": F.element_at(F.array(*map(F.lit, S.SEVERITIES)), pick(["AEDECOD", "n"], 3) + 1),
        "AESER": F.when(pick(["n", "AEDECOD"], 9) == 0, "Y").otherwise("N"),
        "AESTDTC": iso_text(shift_days(F.to_date("RFSTDTC"), pick(id_term, 150) - 5)),
        "AEENDTC": c("RFENDTC"), "VISITNUM": F.lit(1),
    })
    ex = R.expand_visits(dm.select("USUBJID", "SITEID", "RFSTDTC"), "RFSTDTC").withColumns({
        "EXOCCUR": F.when(pick(["USUBJID", "VISITNUM"], 6) == 0, "N").otherwise("Y"),
        "EXSEQ": c("VISITNUM"),
    })
    visits = R.expand_visits(dm.select("USUBJID", "RFSTDTC", "DASCR"), "RFSTDTC", 0, 6, prefix="VS")
    visits = visits.withColumns({"VSDTC": c("VSSTDTC"), "DAS": c("DASCR") - c("VISITNUM") * 0.3})
    vs = R.expand_tests(visits, [("DAS28", "DAS28", "score", "DAS", 1)])
    dropped = pick(["USUBJID"], 4) == 0
    ds = dm.select("USUBJID", "RFSTDTC", "RFENDTC").withColumns({
        "DSDECOD": F.when(dropped, "ADVERSE EVENT").otherwise("COMPLETED"),
        "DPTFL": F.when(dropped, "Y").otherwise("N"),
        "EOSSTT": F.when(dropped, "DISCONTINUED").otherwise("COMPLETED"),
        "DSSTDTC": F.when(dropped, iso_text(shift_days(F.to_date("RFSTDTC"), 60)))
        .otherwise(c("RFENDTC")),
    })
    out = {}
    for name, df, schema in [("DM", dm, S.DM), ("AE", ae, S.AE), ("EX", ex, S.EX),
                             ("VS", vs, S.VS), ("DS", ds, S.DS)]:
        full = df.select(*[
            (c(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ])
        out[name] = write_domain(full, str(folder / f"{name.lower()}.csv"), "csv")
    return out


def test_study(spark, paths, tmp_path):
    result = run_study(
        spark, paths, str(tmp_path / "out"), r"^ST-\d{3}-\d{3}$",
        forest_grid={"numTrees": [5], "maxDepth": [3]},
        boost_grid={"maxIter": [2], "maxDepth": [2]}, folds=2,
    )
    assert result["ADSL"].count() == 280
    status = {r["CHECK_ID"]: (r["STATUS"], r["N_ISSUES"]) for r in result["validation_log"].collect()}
    assert status.pop("CHK-07") == ("WARN", 6)
    assert len(status) == 9 and set(status.values()) == {("PASS", 0)}
    arms = {r["TRT01PN"]: r["N_TOTAL"] for r in result["arm_dropout"].collect()}
    assert arms == {0: 96, 1: 94, 2: 90}
    assert result["scored"].count() == 280
    test_rows = result["split_summary"].filter("PART = 'test'").first()["N"]
    assert result["explanations"].count() == test_rows
    assert result["model_comparison"].filter("IS_BEST = 'Y'").count() == 1
    sequence = result["ADAE"].groupBy("USUBJID").agg(
        F.max("AESEQ").alias("top"), F.countDistinct("AESEQ").alias("n"), F.count("*").alias("c")
    )
    assert sequence.filter("top <> n or n <> c").count() == 0

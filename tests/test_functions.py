"""Scalar rules at their edges and with missing values."""

from pyspark.sql import functions as F

from trialspark import functions as X, schema as S


def one(spark, expr, **values):
    """Value of an expression over one row of typed literals."""
    df = spark.range(1)
    for name, (value, kind) in values.items():
        df = df.withColumn(name, F.lit(value).cast(kind))
    return df.select(expr.alias("v")).first()["v"]


def many(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["v"] for r in df.withColumn("v", expr).orderBy("i").collect()]


x = lambda: F.col("x")


def test_bands_are_right_open(spark):
    assert many(spark, [18.4, 18.5, 25.0, 30.0, None], "double", X.band(x(), *S.BMI_BANDS)) == [
        "Underweight", "Normal", "Overweight", "Obese", None,
    ]
    assert many(spark, [3.1, 3.2, 3.7, 5.1], "double", X.band(x(), *S.DAS28_BANDS)) == [
        "Remission", "Low", "Moderate", "High",
    ]
    assert many(spark, [39, 40, 64, 65], "int", X.band(x(), *S.AGE_BANDS)) == [
        "<40", "40-64", "40-64", ">=65",
    ]


def test_recode_uses_default_for_unknown_and_null(spark):
    expr = X.recode(x(), S.RACE_CODE, S.RACE_CODE_OTHER)
    assert many(spark, ["WHITE", "ASIAN", "UNKNOWN", None], "string", expr) == [1, 3, 4, 4]
    assert many(spark, ["SEVERE", "MILD", None], "string", X.severity_code(x())) == [3, 1, 1]


def test_risk_tiers_and_label(spark):
    tiers = many(spark, [0.3499, 0.35, 0.5999, 0.60, None], "double", X.risk_tier(x()))
    assert tiers == ["Low Risk", "Moderate Risk", "Moderate Risk", "High Risk", "Unknown"]
    assert many(spark, [0.49, 0.5, None], "double", X.predicted_label(x())) == [0, 1, None]


def test_response_edge(spark):
    assert many(spark, [-1.2, -1.3, 0.0, None], "double", X.response_flag(x())) == [
        "NON-RESPONDER", "RESPONDER", "NON-RESPONDER", "UNKNOWN",
    ]


def test_compliance_edge(spark):
    assert many(spark, [79.99, 80.0, None], "double", X.compliance_flag(x())) == [
        "Non-Compliant", "Compliant", "Compliant",
    ]


def test_identifiers_keep_long_numbers(spark):
    expr = X.build_usubjid("ST", F.lit("007"), x())
    assert many(spark, [5, 1234], "int", expr) == ["ST-007-005", "ST-007-1234"]


def test_bmi_clamp_and_text(spark):
    assert one(spark, X.bmi(F.lit(80.0), F.lit(180.0))) == 24.7
    assert many(spark, [1.0, 9.0, None], "double", X.clamp(x(), 2.0, 8.5)) == [2.0, 8.5, None]
    assert many(spark, [4.0, None], "double", X.result_text(x())) == ["4.0", None]
    assert many(spark, ["A_B_C"], "string", X.normalise_term(x())) == ["A B C"]
    assert many(spark, [0, 3], "int", X.visit_text(x())) == ["SCREENING", "WEEK 12"]


def test_missing_never_gives_null(spark):
    d = {"x": (None, "double")}
    assert one(spark, X.indicator(F.col("x") > 1), **d) == 0
    assert one(spark, X.yn_flag(F.col("x") > 1), **d) == "N"
    assert one(spark, X.outside(F.col("x"), 0, 100), **d) is True
    assert one(spark, X.not_in_set(F.col("x"), [1.0]), **d) is True
    assert one(spark, X.differs(F.col("x"), 1.0), **d) is True


def test_date_order_with_missing_dates(spark):
    rows = [("2024-01-01", None), (None, "2024-01-01"), ("2024-01-01", "2024-01-01"),
            ("2024-01-01", "2024-01-02"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    bad = X.not_before(X.iso_date(F.col("a")), X.iso_date(F.col("b")))
    got = [r["v"] for r in df.withColumn("v", bad).orderBy("i").collect()]
    assert got == [True, False, True, False, True]


def test_treatment_emergence_edge(spark):
    expr = X.treatment_emergent(x(), F.lit("2023-03-10"))
    days = ["2023-03-10", "2023-03-09", "bad", None]
    assert many(spark, days, "string", expr) == ["Y", "N", "N", "N"]


def test_time_to_event(spark):
    ends = ["2023-01-11", None, " ", "2024-01-01", "2022-12-01", "bad"]
    got = many(spark, ends, "string", X.time_to_event(F.lit("2023-01-01"), x()))
    assert got == [10, 168, 168, 168, 0, 0]


def test_rule_score_of_documented_row(spark):
    got = one(
        spark,
        X.dropout_rule_score(F.lit(5), F.lit(1), F.lit(3), F.lit(68.0), F.lit("105"), F.lit(2)),
    )
    assert got == 0.61
    capped = one(
        spark,
        X.dropout_rule_score(F.lit(5), F.lit(1), F.lit(3), F.lit(68.0), F.lit("107"), F.lit(2)),
    )
    assert capped == 0.65


def test_propensity_is_capped(spark):
    low = one(spark, X.adverse_event_propensity(F.lit(0.1), F.lit(0), F.lit(40), F.lit(4.0)))
    assert low == 0.1
    high = one(spark, X.adverse_event_propensity(F.lit(0.5), F.lit(2), F.lit(80), F.lit(8.0)))
    assert high == 0.6

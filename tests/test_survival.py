"""Time-to-event results against hand and brute-force values."""

import math
import random

import numpy as np
import pytest

from trialspark.operators import survival as V

SPLIT = {"min_rows": 1, "slices": 100}


def frame(spark, rows):
    return spark.createDataFrame(rows, "TRT01P string, DAYS int, EVENT int")


@pytest.mark.parametrize("limits", [{}, SPLIT])
def test_curve_by_hand(spark, limits):
    df = frame(spark, [("a", 5, 1), ("a", 5, 0), ("a", 10, 1), ("a", 168, 0)])
    rows = {r["DAYS"]: r for r in V.km_curve(df, **limits).collect()}
    assert [rows[t]["N_RISK"] for t in (5, 10, 168)] == [4, 2, 1]
    assert [rows[t]["N_CENSOR"] for t in (5, 10, 168)] == [1, 0, 1]
    assert [rows[t]["SURVIVAL"] for t in (5, 10, 168)] == pytest.approx([0.75, 0.375, 0.375])
    assert rows[5]["SE"] == pytest.approx(0.75 * math.sqrt(1 / 12))


def test_curve_reaches_zero(spark):
    df = frame(spark, [("a", 5, 1), ("a", 9, 1)])
    last = {r["DAYS"]: r for r in V.km_curve(df).collect()}[9]
    assert last["SURVIVAL"] == 0.0 and last["SE"] is None


def test_curve_is_monotone_and_split_invariant(spark):
    rng = random.Random(3)
    df = frame(spark, [(rng.choice("ab"), rng.randrange(200), rng.randrange(2)) for _ in range(900)])
    plain = sorted(V.km_curve(df).collect())
    split = sorted(V.km_curve(df, **SPLIT).collect())
    for p, s in zip(plain, split, strict=True):
        assert p[:5] == s[:5]
        assert p["SURVIVAL"] == pytest.approx(s["SURVIVAL"])
    for arm in "ab":
        values = [r["SURVIVAL"] for r in plain if r["TRT01P"] == arm]
        assert all(0 <= b <= a <= 1 for a, b in zip(values, values[1:]))


def test_at_risk(spark):
    df = frame(spark, [("a", 5, 1), ("a", 10, 0), ("b", 0, 1)])
    got = {(r["TRT01P"], r["TIME"]): r["N_RISK"] for r in V.at_risk_table(df, [0, 5, 6]).collect()}
    assert got == {("a", 0): 2, ("a", 5): 2, ("a", 6): 1, ("b", 0): 1, ("b", 5): 0, ("b", 6): 0}


def brute(rows, strata, weight):
    k = len(strata)
    gap, cov = np.zeros(k), np.zeros((k, k))
    for t in sorted({d for _, d, e in rows if e}):
        risk = np.array([sum(1 for s, d, _ in rows if s == a and d >= t) for a in strata], float)
        dead = np.array([sum(1 for s, d, e in rows if s == a and d == t and e) for a in strata], float)
        n, d = risk.sum(), dead.sum()
        w = n if weight else 1.0
        gap += w * (dead - d * risk / n)
        if n > 1:
            p = risk / n
            cov += w * w * d * (n - d) / (n - 1) * (np.diag(p) - np.outer(p, p))
    x = gap[:-1] @ np.linalg.solve(cov[:-1, :-1], gap[:-1])
    return x


@pytest.mark.parametrize("strata", [["a", "b"], ["a", "b", "c"]])
def test_logrank_against_brute_force(spark, strata):
    rng = random.Random(len(strata))
    rows = [
        (s, min(40, int(rng.expovariate(0.05 * (i + 1)))), int(rng.random() < 0.7))
        for i, s in enumerate(strata)
        for _ in range(60)
    ]
    got = {r["TEST"]: r for r in V.logrank_test(frame(spark, rows), strata).collect()}
    assert got["Log-Rank"]["CHISQ"] == pytest.approx(brute(rows, strata, False))
    assert got["Wilcoxon"]["CHISQ"] == pytest.approx(brute(rows, strata, True))
    assert got["Log-Rank"]["DF"] == len(strata) - 1


def test_chi_square_tail():
    assert V.chi_square_tail(5.991464547, 2) == pytest.approx(0.05)
    assert V.chi_square_tail(3.841458821, 1) == pytest.approx(0.05)
    assert V.chi_square_tail(7.814727903, 3) == pytest.approx(0.05)
    assert V.chi_square_tail(9.487729037, 4) == pytest.approx(0.05)
    assert V.chi_square_tail(0, 2) == 1.0


def test_rows_without_time_event_or_arm_are_left_out(spark):
    rows = [("A", 1, 1), ("A", 2, 0), ("A", 3, 1), ("B", 2, 1), ("B", 4, 1), ("B", 5, 0)]
    kind = "TRT01P string, DAYS int, EVENT int"
    clean = spark.createDataFrame(rows, kind)
    more = spark.createDataFrame([*rows, ("A", None, 1), ("B", 3, None), (None, 1, 1)], kind)
    key = lambda r: (r["TRT01P"], r["DAYS"])
    assert sorted(V.km_curve(more).collect(), key=key) == sorted(V.km_curve(clean).collect(), key=key)
    first = min(V.km_curve(more).filter("TRT01P = 'A'").collect(), key=key)
    assert first["SURVIVAL"] == pytest.approx(2 / 3)
    assert V.logrank_test(more, ["A", "B"]).collect() == V.logrank_test(clean, ["A", "B"]).collect()
    got = {r["TRT01P"]: r for r in V.survival_summary(more).collect()}
    assert (got["A"]["N"], got["A"]["N_EVENT"], got["A"]["MEDIAN"], got["B"]["MEDIAN"]) == (3, 2, 3, 4)


def test_likelihood_ratio(spark):
    df = spark.createDataFrame([("A", 2, 1), ("A", 2, 1), ("B", 8, 1)], "TRT01P string, DAYS int, EVENT int")
    row = V.likelihood_ratio_test(df, ["A", "B"]).first()
    want = 2 * (2 * math.log(2 / 4) + math.log(1 / 8) - 3 * math.log(3 / 12))
    assert (row["CHISQ"], row["DF"]) == (pytest.approx(want), 1)
    assert V.likelihood_ratio_test(df.filter("TRT01P = 'A'"), ["A", "B"]).first()["CHISQ"] is None


def test_quartile_limits_and_mean_by_hand(spark):
    # A: events at 1, 2, 4, 5, one censored at 3 and one at 6. B: all have the event. C: no event. D: a single one.
    rows = [("A", 1, 1), ("A", 2, 1), ("A", 3, 0), ("A", 4, 1), ("A", 5, 1), ("A", 6, 0),
            ("B", 2, 1), ("B", 2, 1), ("B", 6, 1), ("C", 9, 0), ("D", 3, 1), ("D", 5, 0), ("A", None, 1)]
    df = spark.createDataFrame(rows, "TRT01P string, DAYS int, EVENT int")
    got = {r["TRT01P"]: r for r in V.restricted_mean(df).collect()}
    s = [5 / 6, 4 / 6, 4 / 9, 2 / 9]  # after 1, 2, 4, 5
    areas = [s[0] + 2 * s[1] + s[2], 2 * s[1] + s[2], s[2], 0]  # from each event to 5
    var = 4 / 3 * sum(a * a / (n * (n - 1)) for a, n in zip(areas, [6, 5, 3, 2]))
    assert got["A"]["UNTIL"] == 5 and got["A"]["MEAN"] == pytest.approx(1 + areas[0])
    assert got["A"]["SE"] == pytest.approx(math.sqrt(var))
    assert got["B"]["MEAN"] == pytest.approx((2 + 2 + 6) / 3)  # without censoring the plain mean
    assert got["B"]["SE"] == pytest.approx(math.sqrt(3 / 2 * (4 / 3) ** 2 * 2 / (3 * 1)))
    assert (got["C"]["MEAN"], got["D"]["MEAN"], got["D"]["SE"]) == (None, 3.0, None)

    def end(s, g, sign):
        return s ** math.exp(sign * 1.959963984540054 * math.sqrt(g) / abs(math.log(s)))

    g = np.cumsum([1 / (n * (n - 1)) for n in (6, 5, 3, 2)])
    times = [1, 2, 4, 5]
    limits = {(r["TRT01P"], r["PERCENT"]): r for r in V.survival_quartiles(df).collect()}
    assert len(limits) == 12
    for percent, left in ((25, 0.75), (50, 0.5), (75, 0.25)):
        first = lambda values: next((t for t, v in zip(times, values) if v <= left), None)
        row = limits["A", percent]
        assert row["ESTIMATE"] == first(s)
        assert row["LOWER"] == first([end(x, v, 1) for x, v in zip(s, g)])
        assert row["UPPER"] == first([end(x, v, -1) for x, v in zip(s, g)])
        assert all(limits["C", percent][c] is None for c in ("ESTIMATE", "LOWER", "UPPER"))
    assert (limits["B", 50]["ESTIMATE"], limits["B", 50]["UPPER"]) == (2, None)


def test_mean_is_the_same_when_strata_are_split(spark):
    rows = [("A", i % 97, int(i % 3 > 0)) for i in range(400)] + [("B", i % 31, int(i % 2 > 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "TRT01P string, DAYS int, EVENT int")
    whole = sorted(map(tuple, V.restricted_mean(df).collect()))
    parted = sorted(map(tuple, V.restricted_mean(df, min_rows=10, slices=8).collect()))
    assert [x[:2] for x in whole] == [x[:2] for x in parted]
    assert np.allclose([x[2:] for x in whole], [x[2:] for x in parted])


def test_no_rows_give_no_quartiles_and_no_mean(spark):
    none = spark.createDataFrame([], "TRT01P string, DAYS int, EVENT int")
    assert V.restricted_mean(none).collect() == [] and V.survival_quartiles(none).collect() == []

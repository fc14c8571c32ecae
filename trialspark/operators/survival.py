"""Time-to-event analysis.

Subjects are first counted per (stratum, time), with partial aggregation before the shuffle.
Everything else works on those counts: numbers at risk and the product-limit estimate are
running totals and running products, formed in time ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trialspark.functions import indicator, time_to_event
from trialspark.operators.numbering import accumulate, running, split_ranges
from trialspark.sources.workspace import settle


def survival_input(adsl: DataFrame, horizon: int = 168) -> DataFrame:
    """Time on study and dropout event per subject."""
    return adsl.select(
        "USUBJID", "TRT01P", "TRT01PN",
        time_to_event(F.col("RFSTDTC"), F.col("DCDT"), horizon).alias("DAYS"),
        indicator(F.col("DPTFL") == "Y").alias("EVENT"),
    )


def _complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a time, an event mark and a stratum; others say nothing about survival."""
    return df.dropna(subset=list(columns))


def _counts(df: DataFrame, keys: Sequence[str], event: str) -> DataFrame:
    counts = _complete(df, *keys, event).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(indicator(F.col(event) == 1)).alias("N_EVENT")
    )
    return settle(counts)


def km_curve(
    df: DataFrame, time: str = "DAYS", event: str = "EVENT", stratum: str = "TRT01P", **limits
) -> DataFrame:
    """Product-limit estimate per stratum and time, with Greenwood standard error.

    Rows without a time, event mark or stratum are left out. The standard error is null from the time at which every subject at risk has the event.
    """
    counts = _counts(df, [stratum, time], event).withColumn(
        "N_CENSOR", F.col("__n") - F.col("N_EVENT")
    )
    # At risk at t: everybody with a time of t or later.
    ranges = split_ranges(counts, [stratum], [time], **limits)
    at_risk = accumulate(ranges, [stratum], time, {"N_RISK": F.col("__n")}, descending=True)
    d, n = F.col("N_EVENT").cast("double"), F.col("N_RISK").cast("double")
    steps = at_risk.withColumns(
        {
            "__keep": (n - d) / n,
            "__var": F.coalesce(F.try_divide(d, n * (n - d)), F.lit(0.0)),
            "__end": indicator(n == d),
        }
    )
    curve = accumulate(
        steps, [stratum], time,
        {"SURVIVAL": F.col("__keep"), "__g": F.col("__var"), "__dead": F.col("__end")},
        products=["SURVIVAL"],
    )
    se = F.when(F.col("__dead") == 0, F.col("SURVIVAL") * F.sqrt("__g"))
    return curve.select(
        stratum, time, "N_RISK", "N_EVENT", "N_CENSOR", "SURVIVAL", se.alias("SE")
    )


def at_risk_table(
    df: DataFrame, times: Sequence[int], time: str = "DAYS", stratum: str = "TRT01P"
) -> DataFrame:
    """Subjects at risk per stratum at chosen times; rows without a time or stratum are left out."""
    wide = _complete(df, time, stratum).groupBy(stratum).agg(
        *[F.sum(indicator(F.col(time) >= t)).alias(f"__{i}") for i, t in enumerate(times)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("TIME"), F.col(f"__{i}").alias("N_RISK"))
            for i, t in enumerate(times)
        ]
    )
    return wide.select(stratum, F.explode(rows).alias("r")).select(stratum, "r.*")


def survival_summary(
    df: DataFrame, time: str = "DAYS", event: str = "EVENT", stratum: str = "TRT01P", **limits
) -> DataFrame:
    """Subjects, events, censored, and the quartiles of the survival time per stratum.

    A quartile is the first time at which survival is at most 0.75, 0.5 or 0.25; null if it stays above.
    """
    def first(level: float):
        # Running products may miss a level by rounding only.
        return F.min(F.when(F.col("SURVIVAL") <= level + 1e-12, F.col(time)))

    return km_curve(df, time, event, stratum, **limits).groupBy(stratum).agg(
        F.sum(F.col("N_EVENT") + F.col("N_CENSOR")).alias("N"), F.sum("N_EVENT").alias("N_EVENT"),
        F.sum("N_CENSOR").alias("N_CENSOR"), first(0.75).alias("Q25"), first(0.5).alias("MEDIAN"),
        first(0.25).alias("Q75"),
    )


def survival_quartiles(
    df: DataFrame, time: str = "DAYS", event: str = "EVENT", stratum: str = "TRT01P", level: float = 0.95, **limits
) -> DataFrame:
    """Quartiles of the survival time per stratum with confidence limits: PERCENT, ESTIMATE, LOWER, UPPER.

    The limits are the first times at which the lower and the upper end of the log-log band of the curve are at most
    0.75, 0.5 or 0.25. The band exists where survival is below 1 and has a standard error. What is not reached is null.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2)
    s = F.col("SURVIVAL")
    width = F.exp(F.lit(z) * F.col("SE") / (s * F.abs(F.log(s))))
    banded = km_curve(df, time, event, stratum, **limits).withColumns(
        {"__low": F.when(s < 1, F.pow(s, width)), "__high": F.when(s < 1, F.pow(s, 1 / width))})
    percents = {25: 0.75, 50: 0.5, 75: 0.25}
    curves = {"ESTIMATE": "SURVIVAL", "LOWER": "__low", "UPPER": "__high"}
    wide = banded.groupBy(stratum).agg(*[
        F.min(F.when(F.col(c) <= left + 1e-12, F.col(time))).alias(f"__{name}{p}")
        for p, left in percents.items() for name, c in curves.items()
    ])
    rows = F.array(*[
        F.struct(F.lit(p).alias("PERCENT"), *[F.col(f"__{name}{p}").alias(name) for name in curves]) for p in percents
    ])
    return wide.select(stratum, F.explode(rows).alias("r")).select(stratum, "r.*")


def restricted_mean(
    df: DataFrame, time: str = "DAYS", event: str = "EVENT", stratum: str = "TRT01P", **limits
) -> DataFrame:
    """Mean survival time per stratum up to its last event: UNTIL, MEAN, SE.

    The area under the curve, and the standard error with the factor events / (events - 1). Both come from one running
    total of time times drop: the area right of an event is what that total still gains, plus what is left at the end,
    minus time times survival there. Without an event the mean is null, with a single one the standard error.
    """
    d, n, s, t = (F.col(c).cast("double") for c in ("N_EVENT", "N_RISK", "SURVIVAL", time))
    events = km_curve(df, time, event, stratum, **limits).filter("N_EVENT > 0")
    # Events that leave nobody at risk end the curve; the rest of the mass falls there.
    falls = events.withColumn("__fall", F.when(n > d, s * d / (n - d) * t).otherwise(F.lit(0.0)))
    summed = running(falls, [stratum], time, {"__upto": F.col("__fall")}, group_totals={"__all": "__upto"}, **limits)
    ends = settle(events.groupBy(stratum).agg(
        F.max(time).alias("UNTIL"), F.coalesce(F.min(F.when(n > d, s)), F.lit(1.0)).alias("__left"),
        F.sum("N_EVENT").alias("__events")))
    left = F.col("__left") * F.col("UNTIL")
    area = F.col("__all") - F.col("__upto") + left - t * s
    told = summed.join(ends, stratum).groupBy(stratum, "UNTIL", "__left", "__events", "__all").agg(
        F.sum(F.when(n > d, area * area * d / (n * (n - d)))).alias("__var"))
    factor = F.try_divide(F.col("__events").cast("double"), F.col("__events") - 1.0)
    known = told.select(stratum, "UNTIL", (F.col("__all") + left).alias("MEAN"),
                        F.sqrt(F.coalesce("__var", F.lit(0.0)) * factor).alias("SE"))
    strata = _complete(df, time, event, stratum).select(stratum).distinct()
    return strata.join(known, stratum, "left")


def likelihood_ratio_test(
    df: DataFrame, strata: Sequence, time: str = "DAYS", event: str = "EVENT", stratum: str = "TRT01P"
) -> DataFrame:
    """Likelihood-ratio test of equal event rates under exponential survival, in one row.

    Null where a stratum, or all of them, has no event or no time.
    """
    sums = _complete(df, time, event).filter(F.col(stratum).isin(*strata)).groupBy(stratum).agg(
        F.sum(indicator(F.col(event) == 1)).cast("double").alias("d"), F.sum(time).cast("double").alias("t")
    )
    known = [(r["d"], r["t"]) for r in sums.collect()]
    d, t = sum(x for x, _ in known), sum(y for _, y in known)
    usable = len(known) == len(strata) and all(x > 0 and y > 0 for x, y in known)
    gain = sum(x * math.log(x / y) for x, y in known) - d * math.log(d / t) if usable else None
    k = len(strata) - 1
    row = ("-2Log(LR)", None, k, None) if gain is None else ("-2Log(LR)", 2 * gain, k, chi_square_tail(2 * gain, k))
    return df.sparkSession.createDataFrame([row], "TEST string, CHISQ double, DF int, P_VALUE double")


def _pooled(df: DataFrame, strata: Sequence, time: str, event: str, stratum: str) -> DataFrame:
    """One row per time: events and at-risk numbers of each stratum and of all."""
    cells = []
    for j, s in enumerate(strata):
        mine = F.col(stratum) == F.lit(s)
        cells += [
            F.sum(indicator(mine)).alias(f"__m{j}"),
            F.sum(indicator(mine & (F.col(event) == 1))).alias(f"d{j}"),
        ]
    mine = _complete(df, time, event).filter(F.col(stratum).isin(*strata))
    by_time = settle(mine.groupBy(time).agg(*cells))
    k = range(len(strata))
    totals = {f"n{j}": F.col(f"__m{j}") for j in k}
    risk = running(by_time.withColumn("__all", F.lit(0)), ["__all"], time, totals, descending=True)
    return risk.withColumns(
        {
            "d": sum((F.col(f"d{j}") for j in k), F.lit(0)).cast("double"),
            "n": sum((F.col(f"n{j}") for j in k), F.lit(0)).cast("double"),
        }
    ).filter("d > 0")


def logrank_components(
    df: DataFrame,
    strata: Sequence,
    time: str = "DAYS",
    event: str = "EVENT",
    stratum: str = "TRT01P",
) -> DataFrame:
    """Observed and expected events and the covariance row of each stratum.

    One row per (test, stratum); the tests are the unweighted log-rank and the one weighted by
    the number at risk. Columns V0, V1, ... are the covariances with each stratum in order.
    """
    pooled = _pooled(df, strata, time, event, stratum)
    k = range(len(strata))
    d, n = F.col("d"), F.col("n")
    tests = {"Log-Rank": F.lit(1.0), "Wilcoxon": n}
    sums = []
    for t, w in enumerate(tests.values()):
        for j in k:
            nj = F.col(f"n{j}").cast("double")
            sums.append(F.sum(w * F.col(f"d{j}")).alias(f"o{t}_{j}"))
            sums.append(F.sum(w * d * nj / n).alias(f"e{t}_{j}"))
            for m in k:
                nm = F.col(f"n{m}").cast("double")
                own = 1.0 if j == m else 0.0
                spread = F.when(
                    n > 1, w * w * d * (n - d) / (n - 1) * (nj / n) * (F.lit(own) - nm / n)
                ).otherwise(0.0)
                sums.append(F.sum(spread).alias(f"v{t}_{j}_{m}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("TEST"),
                F.lit(j).alias("POSITION"),
                F.lit(s).cast("string").alias("STRATUM"),
                F.col(f"o{t}_{j}").alias("OBSERVED"),
                F.col(f"e{t}_{j}").alias("EXPECTED"),
                *[F.col(f"v{t}_{j}_{m}").alias(f"V{m}") for m in k],
            )
            for t, name in enumerate(tests)
            for j, s in enumerate(strata)
        ]
    )
    return pooled.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def chi_square_tail(x: float, df: int) -> float:
    """Probability that a chi-square variable with df degrees of freedom exceeds x."""
    if x <= 0:
        return 1.0
    # Q(a, z) rises by z^a e^-z / Gamma(a + 1) per unit of a; start at a = 1/2 or a = 1.
    z, a = x / 2, (0.5 if df % 2 else 1.0)
    tail = math.erfc(math.sqrt(z)) if df % 2 else math.exp(-z)
    while a < df / 2:
        tail += math.exp(a * math.log(z) - z - math.lgamma(a + 1))
        a += 1
    return min(tail, 1.0)


def logrank_test(
    df: DataFrame,
    strata: Sequence,
    time: str = "DAYS",
    event: str = "EVENT",
    stratum: str = "TRT01P",
) -> DataFrame:
    """Chi-square test of equal survival in all strata: one row per test.

    Only the strata-by-strata sums reach the driver, which solves the small linear system.
    """
    k = len(strata)
    parts = logrank_components(df, strata, time, event, stratum).collect()
    out = []
    for test in dict.fromkeys(r["TEST"] for r in parts):
        rows = sorted((r for r in parts if r["TEST"] == test), key=lambda r: r["POSITION"])
        gap = np.array([(r["OBSERVED"] or 0) - (r["EXPECTED"] or 0) for r in rows])
        cov = np.array([[r[f"V{m}"] or 0.0 for m in range(k)] for r in rows])
        statistic = float(gap @ np.linalg.pinv(cov) @ gap)
        out.append((test, statistic, k - 1, chi_square_tail(statistic, k - 1)))
    return df.sparkSession.createDataFrame(
        out, "TEST string, CHISQ double, DF int, P_VALUE double"
    )

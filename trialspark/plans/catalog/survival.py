"""Time-to-dropout analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialspark.operators import survival as V
from trialspark.operators.rows import round_numeric
from trialspark.plans.catalog.registry import query
from trialspark.plans.order_trial import DRUG, HORIZON, OrderTrial

ARMS = ["Placebo", f"{DRUG} 100mg", f"{DRUG} 200mg"]
TIMES = [0, 28, 84, 168, 500, 1000, 1500, 2000]

KM_INPUT = f"""
, km AS (
  SELECT USUBJID, TRT01P, DPTN AS EVENT, CASE WHEN DCDT IS NULL THEN {HORIZON}
    ELSE CAST(least({HORIZON}, greatest(0, date_diff('day', CAST(RFSTDTC AS DATE), CAST(DCDT AS DATE)))) AS INTEGER) END AS DAYS
  FROM itt)
"""


def _input(t: OrderTrial) -> DataFrame:
    return V.survival_input(t.itt, HORIZON)


@query(
    "km_curve",
    KM_INPUT
    + """, steps AS (SELECT TRT01P, DAYS, count(*) AS n, CAST(sum(EVENT) AS BIGINT) AS d FROM km GROUP BY TRT01P, DAYS),
    risk AS (SELECT *, CAST(sum(n) OVER (PARTITION BY TRT01P ORDER BY DAYS DESC) AS BIGINT) AS r FROM steps),
    curve AS (SELECT *, product((r - d) / CAST(r AS DOUBLE)) OVER w AS s,
      sum(CASE WHEN r = d THEN 0 ELSE d / (CAST(r AS DOUBLE) * (r - d)) END) OVER w AS g,
      max(CASE WHEN r = d THEN 1 ELSE 0 END) OVER w AS dead
      FROM risk WINDOW w AS (PARTITION BY TRT01P ORDER BY DAYS))
    SELECT TRT01P, DAYS, r AS N_RISK, d AS N_EVENT, n - d AS N_CENSOR, round(s, 8) AS SURVIVAL,
    CASE WHEN dead = 0 THEN round(s * sqrt(g), 8) END AS SE FROM curve""",
)
def km_curve(t: OrderTrial) -> DataFrame:
    return round_numeric(V.km_curve(_input(t)), 8)


@query(
    "survival_summary",
    KM_INPUT
    + """, steps AS (SELECT TRT01P, DAYS, count(*) AS n, sum(EVENT) AS d FROM km GROUP BY TRT01P, DAYS),
    risk AS (SELECT *, sum(n) OVER (PARTITION BY TRT01P ORDER BY DAYS DESC) AS r FROM steps),
    curve AS (SELECT *, product((r - d) / CAST(r AS DOUBLE)) OVER (PARTITION BY TRT01P ORDER BY DAYS) AS s FROM risk)
    SELECT TRT01P, CAST(sum(n) AS BIGINT) AS N, CAST(sum(d) AS BIGINT) AS N_EVENT,
    CAST(sum(n - d) AS BIGINT) AS N_CENSOR, min(DAYS) FILTER (WHERE s <= 0.75 + 1e-12) AS Q25,
    min(DAYS) FILTER (WHERE s <= 0.5 + 1e-12) AS MEDIAN, min(DAYS) FILTER (WHERE s <= 0.25 + 1e-12) AS Q75
    FROM curve GROUP BY TRT01P""",
)
def survival_summary(t: OrderTrial) -> DataFrame:
    return V.survival_summary(_input(t))


BANDED = (
    KM_INPUT
    + """, steps AS (SELECT TRT01P, DAYS, count(*) AS n, sum(EVENT) AS d FROM km GROUP BY TRT01P, DAYS),
    risk AS (SELECT *, sum(n) OVER (PARTITION BY TRT01P ORDER BY DAYS DESC) AS r FROM steps),
    curve AS (SELECT *, product((r - d) / CAST(r AS DOUBLE)) OVER w AS s,
      sum(d / nullif(CAST(r AS DOUBLE) * (r - d), 0)) OVER w AS g, bool_or(r = d) OVER w AS dead
      FROM risk WINDOW w AS (PARTITION BY TRT01P ORDER BY DAYS))"""
)


@query(
    "survival_quartiles",
    BANDED
    + """, band AS (SELECT *, CASE WHEN s < 1 AND NOT dead THEN exp(1.959963984540054 * sqrt(g) / abs(ln(s))) END AS w FROM curve),
    levels(PERCENT, keep) AS (VALUES (25, 0.75), (50, 0.5), (75, 0.25))
    SELECT TRT01P, CAST(PERCENT AS INTEGER) AS PERCENT, min(DAYS) FILTER (WHERE s <= keep + 1e-12) AS ESTIMATE,
    min(DAYS) FILTER (WHERE pow(s, w) <= keep + 1e-12) AS LOWER, min(DAYS) FILTER (WHERE pow(s, 1 / w) <= keep + 1e-12) AS UPPER
    FROM band CROSS JOIN levels GROUP BY TRT01P, PERCENT""",
)
def survival_quartiles(t: OrderTrial) -> DataFrame:
    return V.survival_quartiles(_input(t))


@query(
    "restricted_mean",
    BANDED
    + """, events AS (SELECT *, lead(DAYS) OVER w AS following FROM curve WHERE d > 0 WINDOW w AS (PARTITION BY TRT01P ORDER BY DAYS)),
    areas AS (SELECT *, coalesce(sum(s * (following - DAYS)) OVER (PARTITION BY TRT01P ORDER BY DAYS DESC), 0) AS a FROM events)
    SELECT TRT01P, max(DAYS) AS UNTIL, round(min(DAYS) + max(a), 5) AS MEAN,
    round(sqrt(coalesce(sum(a * a * d / nullif(CAST(r AS DOUBLE) * (r - d), 0)), 0) * sum(d) / nullif(sum(d) - 1, 0)), 5) AS SE
    FROM areas GROUP BY TRT01P""",
)
def restricted_mean(t: OrderTrial) -> DataFrame:
    return round_numeric(V.restricted_mean(_input(t)), 5)


@query(
    "likelihood_ratio_test",
    KM_INPUT
    + """, rates AS (SELECT TRT01P, CAST(sum(EVENT) AS DOUBLE) AS d, CAST(sum(DAYS) AS DOUBLE) AS t FROM km GROUP BY TRT01P),
    stat AS (SELECT 2 * (sum(d * ln(d / t)) - sum(d) * ln(sum(d) / sum(t))) AS x FROM rates)
    SELECT '-2Log(LR)' AS TEST, round(x, 6) AS CHISQ, 2 AS DF, round(exp(-x / 2), 6) AS P_VALUE FROM stat""",
)
def likelihood_ratio_test(t: OrderTrial) -> DataFrame:
    return round_numeric(V.likelihood_ratio_test(_input(t), ARMS), 6)


@query(
    "at_risk_table",
    KM_INPUT
    + f"""SELECT TRT01P, CAST(TIME AS INTEGER) AS TIME, count(*) FILTER (WHERE DAYS >= TIME) AS N_RISK
    FROM km CROSS JOIN (VALUES {", ".join(f"({x})" for x in TIMES)}) v(TIME) GROUP BY TRT01P, TIME""",
)
def at_risk_table(t: OrderTrial) -> DataFrame:
    return V.at_risk_table(_input(t), TIMES)


LOGRANK = (
    KM_INPUT
    + ", strata(POSITION, STRATUM) AS (VALUES "
    + ", ".join(f"({i}, '{a}')" for i, a in enumerate(ARMS))
    + """),
    times AS (SELECT DAYS AS t, CAST(sum(EVENT) AS DOUBLE) AS d FROM km GROUP BY DAYS HAVING sum(EVENT) > 0),
    cells AS (
      SELECT t, d, POSITION, STRATUM, CAST(count(*) FILTER (WHERE TRT01P = STRATUM AND DAYS >= t) AS DOUBLE) AS nj,
        CAST(count(*) FILTER (WHERE TRT01P = STRATUM AND DAYS = t AND EVENT = 1) AS DOUBLE) AS dj
      FROM times CROSS JOIN strata JOIN km ON DAYS >= t GROUP BY ALL),
    full_cells AS (SELECT *, sum(nj) OVER (PARTITION BY t) AS n FROM cells),
    weighted AS (
      SELECT 'Log-Rank' AS TEST, 1.0::DOUBLE AS w, * FROM full_cells UNION ALL
      SELECT 'Wilcoxon', n, * FROM full_cells),
    oe AS (SELECT TEST, POSITION, STRATUM, sum(w * dj) AS OBSERVED, sum(w * d * nj / n) AS EXPECTED
      FROM weighted GROUP BY ALL),
    cov AS (
      SELECT a.TEST, a.POSITION, b.POSITION AS m, sum(CASE WHEN a.n > 1 THEN a.w * a.w * a.d * (a.n - a.d) / (a.n - 1)
        * (a.nj / a.n) * ((CASE WHEN a.POSITION = b.POSITION THEN 1 ELSE 0 END) - b.nj / a.n) ELSE 0 END) AS v
      FROM weighted a JOIN weighted b ON a.TEST = b.TEST AND a.t = b.t GROUP BY ALL),
    wide AS (SELECT TEST, POSITION, max(v) FILTER (WHERE m = 0) AS V0, max(v) FILTER (WHERE m = 1) AS V1,
      max(v) FILTER (WHERE m = 2) AS V2 FROM cov GROUP BY ALL)
    """
)


@query(
    "logrank_components",
    LOGRANK
    + """SELECT TEST, CAST(POSITION AS INTEGER) AS POSITION, STRATUM, round(OBSERVED, 4) AS OBSERVED,
    round(EXPECTED, 4) AS EXPECTED, round(V0, 2) AS V0, round(V1, 2) AS V1, round(V2, 2) AS V2
    FROM oe JOIN wide USING (TEST, POSITION)""",
)
def logrank_components(t: OrderTrial) -> DataFrame:
    """Sums of both tests. The weighted ones are large, so fewer decimals are compared."""
    parts = V.logrank_components(_input(t), ARMS)
    covariances = {f"V{i}": F.round(f"V{i}", 2) for i in range(len(ARMS))}
    return round_numeric(parts.withColumns(covariances), 4)


@query(
    "logrank_test",
    LOGRANK
    + """, gap AS (SELECT a.TEST, a.OBSERVED - a.EXPECTED AS g0, b.OBSERVED - b.EXPECTED AS g1
      FROM oe a JOIN oe b ON a.TEST = b.TEST AND a.POSITION = 0 AND b.POSITION = 1),
    mat AS (SELECT a.TEST, a.V0 AS a11, a.V1 AS a12, b.V1 AS a22 FROM wide a JOIN wide b
      ON a.TEST = b.TEST AND a.POSITION = 0 AND b.POSITION = 1),
    stat AS (SELECT TEST, (g0 * g0 * a22 - 2 * g0 * g1 * a12 + g1 * g1 * a11) / (a11 * a22 - a12 * a12) AS x
      FROM gap JOIN mat USING (TEST))
    SELECT TEST, round(x, 6) AS CHISQ, 2 AS DF, round(exp(-x / 2), 6) AS P_VALUE FROM stat""",
)
def logrank_test(t: OrderTrial) -> DataFrame:
    return round_numeric(V.logrank_test(_input(t), ARMS), 6)

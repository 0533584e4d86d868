"""Rank and normality tests, autocorrelation, unit roots, spectra, decomposition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pluvia.functions.storage import materialise
from pluvia.operators import autocorrelation as ac
from pluvia.operators import decomposition as dc
from pluvia.operators import loess
from pluvia.operators import profile as pf
from pluvia.operators import spectrum as sp
from pluvia.operators import stat_tests as st
from pluvia.operators import stationarity as sy
from pluvia.operators.clean import to_long
from pluvia.operators.features import detrend_centred
from pluvia.plans import reports
from pluvia.plans.catalog.registry import LONG, PANEL, RAW, TOTAL, query, rounded
from pluvia.sources.panel import CALENDAR_DAYS, PREDICTORS, daily_total, panel, site_series, table

SITE = site_series()


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def lines_long(spark, sf_dir):
    return to_long(lines(spark, sf_dir), [], RAW, "Feature", "v")


# --- normality ----------------------------------------------------------------

JB = LONG + """
, m AS (SELECT feature, COUNT(v) AS n, AVG(v) AS mu FROM long GROUP BY feature),
c AS (SELECT long.feature, n, AVG(POW(v - mu, 2)) AS m2, AVG(POW(v - mu, 3)) AS m3, AVG(POW(v - mu, 4)) AS m4
      FROM long JOIN m ON long.feature = m.feature GROUP BY long.feature, n),
g AS (SELECT feature, CAST(n AS DOUBLE) AS n, m3 / POW(m2, 1.5) AS g1, m4 / (m2 * m2) - 3 AS g2 FROM c),
s AS (SELECT *, g1 * SQRT((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
        SQRT(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
        (g2 + 3 - 3 * (n - 1) / (n + 1)) / SQRT(24 * n * (n - 2) * (n - 3) / (POW(n + 1, 2) * (n + 3) * (n + 5))) AS x,
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * SQRT(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM g),
z AS (SELECT *, LN(y / SQRT(2 / (w2 - 1)) + SQRT(POW(y / SQRT(2 / (w2 - 1)), 2) + 1)) / SQRT(0.5 * LN(w2)) AS zs,
        6 + 8 / b * (2 / b + SQRT(1 + 4 / (b * b))) AS a FROM s),
k AS (SELECT *, 1 + x * SQRT(2 / (a - 4)) AS den FROM z),
f AS (SELECT *, (1 - 2 / (9 * a) - SIGN(den) * POW((1 - 2 / a) / ABS(den), 1.0 / 3)) / SQRT(2 / (9 * a)) AS zk FROM k)
"""


@query(JB + """
SELECT feature AS "Feature", CAST(n AS BIGINT) AS "Sample_Size", ROUND(n / 6 * (g1 * g1 + g2 * g2 / 4), 4) AS "JB_Stat",
       ROUND(EXP(-n / 12 * (g1 * g1 + g2 * g2 / 4)), 8) AS "JB_P", ROUND(zs, 6) AS "Skew_Stat", ROUND(zk, 5) AS "Kurt_Stat",
       ROUND(zs * zs + zk * zk, 4) AS "DAgostino_Stat", ROUND(EXP(-(zs * zs + zk * zk) / 2), 8) AS "DAgostino_P" FROM f
""")
def moment_tests(spark, sf_dir):
    out = st.moment_tests(lines_long(spark, sf_dir)).drop("Skew_P", "Kurt_P")
    out = rounded(rounded(out, 4, "JB_Stat", "DAgostino_Stat"), 8, "JB_P", "DAgostino_P")
    return rounded(rounded(out, 6, "Skew_Stat"), 5, "Kurt_Stat")


@query()
def normality_battery(spark, sf_dir):
    return st.normality_battery(lines(spark, sf_dir), RAW)


@query()
def normality_sample(spark, sf_dir):
    """The sampled variant: 5000 seeded rows per feature."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return st.normality_battery(rows, ["o_totalprice"], sample_rows=5000, id_col="o_orderkey")


# --- rank tests ---------------------------------------------------------------

ALIGNED = PANEL + ", al AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS v, rain AS t FROM panel WHERE {c} IS NOT NULL" for c in ["n_obs", *PREDICTORS]
).replace("SELECT 'n_obs' AS feature, n_obs AS v", "SELECT 'n_obs' AS feature, CAST(n_obs AS DOUBLE) AS v") + """),
rk AS (SELECT feature, v, t, RANK() OVER (PARTITION BY feature ORDER BY v) + (COUNT(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r,
  RANK() OVER (PARTITION BY feature ORDER BY t) + (COUNT(*) OVER (PARTITION BY feature, t) - 1) / 2.0 AS rt,
  CASE WHEN t = 0 THEN 0 WHEN t <= 2.5 THEN 1 WHEN t <= 7.5 THEN 2 ELSE 3 END AS g FROM al),
u AS (SELECT feature, COUNT(*) FILTER (t = 0) AS n1, COUNT(*) FILTER (t > 0) AS n2, SUM(r) FILTER (t = 0) AS r1, COUNT(*) AS n,
  CORR(r, rt) AS rho FROM rk GROUP BY feature),
tie AS (SELECT feature, SUM(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT feature, v, COUNT(*) AS c FROM al GROUP BY 1, 2) GROUP BY feature),
gs AS (SELECT feature, g, COUNT(*) AS c, SUM(r) AS s FROM rk GROUP BY 1, 2),
h AS (SELECT gs.feature, (12.0 / (CAST(n AS DOUBLE) * (n + 1)) * SUM(s * s / c) - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) * n * n - n)) AS h,
  MIN(c) AS smallest FROM gs JOIN u ON gs.feature = u.feature JOIN tie ON tie.feature = gs.feature GROUP BY gs.feature, n, ties)
"""
# The panel's measures are missing exactly on dry days, so the two-sample and
# group tests use the line count next to them.


@query(ALIGNED + """
SELECT u.feature AS "Feature", u.n AS "Aligned_Rows", ROUND(rho, 8) AS "Spearman_Corr",
       CASE WHEN n1 > 5 AND n2 > 5 THEN r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 END AS "MW_Statistic"
FROM u
""")
def rank_tests(spark, sf_dir):
    out = st.non_parametric_tests(panel(spark, sf_dir), "rain", ["n_obs", *PREDICTORS])
    return rounded(out.select("Feature", "Aligned_Rows", "Spearman_Corr", "MW_Statistic"), 8, "Spearman_Corr")


@query(ALIGNED + """
SELECT feature AS "Feature", ROUND(h, 5) AS "KW_Statistic" FROM h
""")
def kruskal_wallis(spark, sf_dir):
    cells = st.aligned_cells(panel(spark, sf_dir), "rain", ["n_obs", *PREDICTORS])
    return rounded(st.kruskal_wallis(st.ranked_values(cells)).select("Feature", "KW_Statistic"), 5, "KW_Statistic")


VERDICTS = ALIGNED + """
, k AS (SELECT feature, COUNT(*) AS k FROM gs GROUP BY feature),
w AS (SELECT u.feature, u.n, rho, n1, n2, ties, h, k, CASE WHEN n1 > 5 AND n2 > 5 THEN r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 END AS mw
      FROM u JOIN tie ON tie.feature = u.feature JOIN h ON h.feature = u.feature JOIN k ON k.feature = u.feature),
z AS (SELECT *, (GREATEST(mw, CAST(n1 AS DOUBLE) * n2 - mw) - CAST(n1 AS DOUBLE) * n2 / 2 - 0.5)
        / SQRT(CAST(n1 AS DOUBLE) * n2 / 12 * ((n + 1) - ties / (CAST(n AS DOUBLE) * (n - 1)))) AS z,
        ABS(rho) * SQRT((n - 2) / (1 - rho * rho)) AS t FROM w)
{select} feature AS "Feature", n AS "Aligned_Rows", ROUND(rho, 8) AS "Spearman_Corr", CASE WHEN t > 1.96 THEN 'Yes' ELSE 'No' END AS "Spearman_Significant",
       mw AS "MW_Statistic", CASE WHEN mw IS NULL THEN 'N/A' WHEN z > 1.959963985 THEN 'Yes' ELSE 'No' END AS "MW_Significant",
       CASE WHEN k >= 3 THEN ROUND(h, 5) END AS "KW_Statistic",
       CASE WHEN k < 3 THEN 'N/A' WHEN h > CASE k WHEN 3 THEN 5.991464547 ELSE 7.814727903 END THEN 'Yes' ELSE 'No' END AS "KW_Significant" FROM z
"""


@query(VERDICTS.replace("{select}", "SELECT"))
def non_parametric_tests(spark, sf_dir):
    """Statistics and verdicts of the three tests; the SQL holds them against the tests' 5 % points."""
    out = st.non_parametric_tests(panel(spark, sf_dir), "rain", ["n_obs", *PREDICTORS])
    return rounded(rounded(out.drop("Spearman_P_Value", "MW_P_Value", "KW_P_Value"), 8, "Spearman_Corr"), 5, "KW_Statistic")


INSIGHTS = VERDICTS.replace("{select}", ", verdicts AS (SELECT") + """),
lg AS (SELECT 'rain' AS feature, rain AS v FROM panel UNION ALL SELECT 'temp', temp FROM panel WHERE temp IS NOT NULL UNION ALL SELECT 'n_obs', CAST(n_obs AS DOUBLE) FROM panel),
mu AS (SELECT feature, COUNT(v) AS n, AVG(v) AS mu FROM lg GROUP BY feature),
mo AS (SELECT lg.feature, CAST(n AS DOUBLE) AS n, AVG(POW(v - mu, 2)) AS m2, AVG(POW(v - mu, 3)) AS m3, AVG(POW(v - mu, 4)) AS m4 FROM lg JOIN mu ON lg.feature = mu.feature GROUP BY 1, 2),
jb AS (SELECT feature, EXP(-n / 12 * (POW(m3 / POW(m2, 1.5), 2) + POW(m4 / (m2 * m2) - 3, 2) / 4)) AS p FROM mo),
rb AS (SELECT COUNT(*) FILTER (rain = 0) * 100.0 / COUNT(*) AS a, COUNT(*) FILTER (rain > 0.6 AND rain <= 16) * 100.0 / COUNT(*) AS b,
       COUNT(*) FILTER (rain > 16 AND rain <= 100) * 100.0 / COUNT(*) AS c FROM panel)
SELECT ROUND(a, 6) AS zero_rain_pct, ROUND(b, 6) AS light_moderate_pct, ROUND(c, 6) AS heavy_pct,
       (SELECT COUNT(*) FROM jb WHERE p > 0.05) AS normal_features, (SELECT COUNT(*) FROM jb) AS tested_features,
       (SELECT COUNT(*) FROM verdicts WHERE "MW_Significant" = 'Yes' AND "Feature" IN ('temp', 'n_obs')) AS significant_rain_difference,
       (SELECT COUNT(*) FROM verdicts WHERE "KW_Significant" = 'Yes' AND "Feature" IN ('temp', 'n_obs')) AS significant_group_difference,
       (SELECT COUNT(*) FROM verdicts WHERE "Spearman_Significant" = 'Yes' AND "Feature" IN ('temp', 'n_obs')) AS significant_rank_correlation FROM rb
"""


@query(INSIGHTS)
def distribution_insights(spark, sf_dir):
    """Rain shares, features that look normal, significant rank tests: one row."""
    rows = materialise(panel(spark, sf_dir).select("rain", "temp", "n_obs"))
    columns = ["rain", "temp", "n_obs"]
    out = reports.distribution_insights(
        pf.rain_band_counts(rows, "rain"), st.normality_battery(rows, columns),
        st.non_parametric_tests(rows, "rain", columns),
    )
    return rounded(out, 6, "zero_rain_pct", "light_moderate_pct", "heavy_pct")


# --- autocorrelation ----------------------------------------------------------

ACF = PANEL + """
, c AS (SELECT site, day, rain - AVG(rain) OVER (PARTITION BY site) AS x, COUNT(*) OVER (PARTITION BY site) AS n,
        ROW_NUMBER() OVER (PARTITION BY site ORDER BY day) AS pos FROM panel),
p AS (SELECT a.site, a.n, lag, SUM(a.x * b.x) AS product FROM c a CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(0, {lags})) AS lag) l
      JOIN c b ON b.site = a.site AND b.pos = a.pos - lag GROUP BY 1, 2, 3),
r AS (SELECT site, n, lag, product / FIRST_VALUE(product) OVER (PARTITION BY site ORDER BY lag) AS r FROM p)
"""


@query(ACF.format(lags=40) + """
, b AS (SELECT *, CASE WHEN lag = 0 THEN 0.0 ELSE 1.959963984540054 * SQRT((1 + 2 * COALESCE(SUM(CASE WHEN lag > 0 THEN r * r ELSE 0 END)
  OVER (PARTITION BY site ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS half FROM r)
SELECT site, lag, n, ROUND(r, 8) AS r, ROUND(half, 8) AS half_band, lag > 0 AND ABS(r) > half AS significant FROM b
""")
def acf(spark, sf_dir):
    return rounded(ac.acf(panel(spark, sf_dir), "rain", 40, by=SITE), 8, "r", "half_band")


@query(ACF.format(lags=20) + """
, q AS (SELECT site, lag, n, CAST(n AS DOUBLE) * (n + 2) * SUM(CASE WHEN lag > 0 THEN r * r / (n - lag) ELSE 0 END) OVER (PARTITION BY site ORDER BY lag) AS lb FROM r)
SELECT site, lag, n, ROUND(lb, 5) AS lb_stat FROM q WHERE lag > 0
""")
def ljung_box(spark, sf_dir):
    lags = ac.ljung_box_legacy_lags(2557)
    return rounded(ac.ljung_box(panel(spark, sf_dir), "rain", lags, by=SITE).drop("lb_pvalue"), 5, "lb_stat")


# 95 % points of the chi-square distribution with 1 to 10 degrees of freedom.
CHI2_95 = [3.841458821, 5.991464547, 7.814727903, 9.487729037, 11.070497694, 12.591587244, 14.067140449, 15.507313056,
           16.918977605, 18.307038053]


@query(ACF.format(lags=10) + f"""
, q AS (SELECT site, lag, CAST(n AS DOUBLE) * (n + 2) * SUM(CASE WHEN lag > 0 THEN r * r / (n - lag) ELSE 0 END) OVER (PARTITION BY site ORDER BY lag) AS lb FROM r),
h AS (SELECT site, lag, lb > ({CHI2_95}::DOUBLE[])[lag] AS hit FROM q WHERE lag > 0)
SELECT site, COUNT(*) FILTER (hit) AS significant_lags, MIN(lag) FILTER (hit) AS first_significant_lag, NOT BOOL_OR(hit) AS autocorr_clean,
       NOT BOOL_OR(hit) AS is_random FROM h GROUP BY site
""")
def ljung_box_summary(spark, sf_dir):
    return ac.ljung_box_summary(ac.ljung_box(panel(spark, sf_dir), "rain", 10, by=SITE), ["site"]).drop("min_pvalue")


# The chi-square tail is a finite sum at even degrees of freedom; at odd ones another finite sum follows the error function,
# whose series of positive terms is added up (beyond six standard deviations its complement is below 1e-16).
@query(ACF.format(lags=20) + """
, q AS MATERIALIZED (SELECT site, lag, CAST(n AS DOUBLE) * (n + 2) * SUM(CASE WHEN lag > 0 THEN r * r / (n - lag) ELSE 0 END) OVER (PARTITION BY site ORDER BY lag) AS lb FROM r),
t AS (SELECT site, lag, lb, UNNEST(GENERATE_SERIES(0, lag // 2 - 1)) AS i FROM q WHERE lag > 0 AND lag % 2 = 0),
z AS (SELECT site, lag, lb, SQRT(lb / 2) AS z FROM q WHERE lag % 2 = 1),
e AS (SELECT site, lag, z, UNNEST(GENERATE_SERIES(0, 150)) AS i FROM z WHERE z < 6),
f AS (SELECT site, lag, SUM(EXP((2 * i + 1) * LN(z) - z * z - LGAMMA(i + 1.5))) AS erf FROM e GROUP BY site, lag),
o AS (SELECT site, lag, lb, UNNEST(GENERATE_SERIES(1, lag // 2)) AS i FROM z WHERE lag > 1),
g AS (SELECT site, lag, SUM(EXP((i - 0.5) * LN(lb) - lb / 2 - i * LN(2) - LGAMMA(i + 0.5) + 0.5 * LN(2))) AS rest FROM o GROUP BY site, lag)
SELECT site, lag, ROUND(EXP(-lb / 2) * SUM(POW(lb / 2, i) / GAMMA(i + 1)), 9) AS p_value FROM t GROUP BY site, lag, lb
UNION ALL SELECT z.site, z.lag, ROUND(1 - COALESCE(erf, 1) + COALESCE(rest, 0), 9) FROM z LEFT JOIN f ON f.site = z.site AND f.lag = z.lag
  LEFT JOIN g ON g.site = z.site AND g.lag = z.lag
""")
def ljung_box_p_values(spark, sf_dir):
    out = ac.ljung_box(panel(spark, sf_dir), "rain", 20, by=SITE)
    return out.select("site", "lag", F.round("lb_pvalue", 9).alias("p_value"))


@query(ACF.format(lags=3) + """
, g AS (SELECT site, n, MAX(CASE WHEN lag = 1 THEN r * n / (n - 1) END) AS a, MAX(CASE WHEN lag = 2 THEN r * n / (n - 2) END) AS b,
        MAX(CASE WHEN lag = 3 THEN r * n / (n - 3) END) AS c FROM r GROUP BY site, n)
SELECT site, 1 AS lag, ROUND(a, 8) AS r FROM g UNION ALL
SELECT site, 2, ROUND((b - a * a) / (1 - a * a), 8) FROM g UNION ALL
SELECT site, 3, ROUND((c * (1 - a * a) - 2 * a * b + a * a * a + a * b * b) / (1 - 2 * a * a - b * b + 2 * a * a * b), 8) FROM g
""")
def pacf_low_lags(spark, sf_dir):
    """The first three partial autocorrelations, which have closed forms in the first three autocorrelations."""
    out = ac.pacf(panel(spark, sf_dir), "rain", 3, by=SITE).filter("lag > 0")
    return rounded(out.select("site", "lag", "r"), 8, "r")


@query()
def pacf(spark, sf_dir):
    return ac.pacf(panel(spark, sf_dir), "rain", 40, by=SITE)


PERIODS = [7, 30]
BUDGET = ac.lag_budget(PERIODS)["max_lags"]


@query(ACF.format(lags=BUDGET) + """
, b AS (SELECT *, CASE WHEN lag = 0 THEN 0.0 ELSE 1.959963984540054 * SQRT((1 + 2 * COALESCE(SUM(CASE WHEN lag > 0 THEN r * r ELSE 0 END)
  OVER (PARTITION BY site ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS half FROM r)
SELECT site, lag, ROUND(r, 8) AS r FROM b WHERE lag > 0 AND ABS(r) > half AND (ABS(lag - 7) <= 5 OR ABS(lag - 30) <= 5)
""")
def lags_near_periods(spark, sf_dir):
    found = ac.acf(panel(spark, sf_dir), "rain", BUDGET, by=SITE)
    return rounded(ac.lags_near_periods(found, PERIODS).select("site", "lag", "r"), 8, "r")


@query()
def order_suggestions(spark, sf_dir):
    rows = panel(spark, sf_dir)
    return ac.suggest_orders(
        ac.acf(rows, "rain", BUDGET, by=SITE), ac.pacf(rows, "rain", BUDGET, by=SITE), PERIODS, ["site"]
    )


@query(ACF.format(lags=BUDGET) + """
, b AS (SELECT *, 1.959963984540054 * SQRT((1 + 2 * COALESCE(SUM(CASE WHEN lag > 0 THEN r * r ELSE 0 END)
  OVER (PARTITION BY site ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) AS half FROM r),
m AS (SELECT site, COUNT(*) FILTER (lag > 0 AND ABS(r) > half AND lag <= n // 4) AS hits FROM b GROUP BY site)
SELECT site, CAST(CASE WHEN hits > 0 THEN LEAST(hits, 3) ELSE 1 END AS INT) AS ma_order, 1 AS seasonal_ar, 1 AS seasonal_ma, 30 AS season_length FROM m
""")
def moving_average_orders(spark, sf_dir):
    """The part of the order suggestions that follows from the autocorrelations and the given periods."""
    return order_suggestions(spark, sf_dir).select("site", "ma_order", "seasonal_ar", "seasonal_ma", "season_length")


@query(ACF.format(lags=10) + f"""
, q AS (SELECT site, lag, CAST(n AS DOUBLE) * (n + 2) * SUM(CASE WHEN lag > 0 THEN r * r / (n - lag) ELSE 0 END) OVER (PARTITION BY site ORDER BY lag) AS lb FROM r),
h AS (SELECT site, COUNT(*) FILTER (lb > ({CHI2_95}::DOUBLE[])[lag]) AS hits FROM q WHERE lag > 0 GROUP BY site)
SELECT site, CASE WHEN hits = 0 THEN 'Good' WHEN hits < 10 THEN 'Moderate' ELSE 'Poor' END AS overall_quality FROM h
""")
def series_quality(spark, sf_dir):
    """The quality label of a decomposition, here of the undecomposed series."""
    summary = ac.ljung_box_summary(ac.ljung_box(panel(spark, sf_dir), "rain", 10, by=SITE), ["site"])
    return sy.decomposition_quality(summary).select("site", "overall_quality")


# --- unit roots ---------------------------------------------------------------

KPSS = PANEL + """
, o AS (SELECT site, rain AS y, CAST(ROW_NUMBER() OVER (PARTITION BY site ORDER BY day) - 1 AS DOUBLE) AS t FROM panel),
f AS (SELECT site, COUNT(*) AS n, REGR_SLOPE(y, t) AS b, REGR_INTERCEPT(y, t) AS a FROM o GROUP BY site),
e AS (SELECT o.site, t, n, y - a - b * t AS e FROM o JOIN f ON o.site = f.site),
g AS (SELECT x.site, x.n, lag, SUM(x.e * y.e) AS p FROM e x CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(0, 8)) AS lag) l
      JOIN e y ON y.site = x.site AND y.t = x.t - lag GROUP BY 1, 2, 3),
w AS (SELECT site, n, SUM(CASE WHEN lag = 0 THEN p / n WHEN lag <= FLOOR(POW(n, 2.0 / 9)) THEN p / (n / 2.0) ELSE 0 END) AS s0,
      SUM(CASE WHEN lag BETWEEN 1 AND FLOOR(POW(n, 2.0 / 9)) THEN lag * p / (n / 2.0) ELSE 0 END) AS s1 FROM g GROUP BY 1, 2),
m AS (SELECT site, n, CAST(FLOOR(1.1447 * POW(POW(s1 / s0, 2), 1.0 / 3) * POW(n, 1.0 / 3)) AS BIGINT) AS m FROM w),
ml AS (SELECT site, n, m, UNNEST(GENERATE_SERIES(0, m)) AS lag FROM m),
g2 AS (SELECT ml.site, ml.n, m, lag, SUM(x.e * y.e) AS p FROM ml JOIN e x ON x.site = ml.site
       JOIN e y ON y.site = x.site AND y.t = x.t - lag GROUP BY 1, 2, 3, 4),
v AS (SELECT site, n, m, SUM(CASE WHEN lag = 0 THEN p ELSE 2 * p * (1 - lag / (m + 1)) END) / n AS s2 FROM g2 GROUP BY 1, 2, 3),
h AS (SELECT site, n, SUM(e) OVER (PARTITION BY site ORDER BY t) AS s FROM e),
eta AS (SELECT site, SUM(s * s) / (CAST(MAX(n) AS DOUBLE) * MAX(n)) AS eta FROM h GROUP BY site)
"""


KPSS_ROWS = KPSS + """
, st AS (SELECT v.site, eta / s2 AS stat, m FROM v JOIN eta ON v.site = eta.site),
kp AS (SELECT site, stat, m, CASE WHEN stat <= 0.119 THEN 0.1 WHEN stat <= 0.146 THEN 0.1 + (stat - 0.119) / 0.027 * -0.05
  WHEN stat <= 0.176 THEN 0.05 + (stat - 0.146) / 0.03 * -0.025 WHEN stat <= 0.216 THEN 0.025 + (stat - 0.176) / 0.04 * -0.015 ELSE 0.01 END AS p FROM st)
"""


@query(KPSS_ROWS + "SELECT site, ROUND(stat, 7) AS kpss_stat, ROUND(p, 6) AS kpss_pvalue, m AS kpss_lags, p > 0.05 AS kpss_stationary FROM kp")
def kpss(spark, sf_dir):
    out = sy.kpss_test(panel(spark, sf_dir), "rain", "ct", by=SITE)
    return rounded(rounded(out, 7, "kpss_stat"), 6, "kpss_pvalue").select("site", "kpss_stat", "kpss_pvalue", "kpss_lags", "kpss_stationary")


@query()
def adf(spark, sf_dir):
    return sy.adf_test(panel(spark, sf_dir), "rain", "ct", by=SITE)


@query()
def stationarity_verdicts(spark, sf_dir):
    return sy.stationarity_tests(panel(spark, sf_dir), "rain", "ct", by=SITE)


@query()
def differenced_where_needed(spark, sf_dir):
    rows = materialise(panel(spark, sf_dir).select("site", "day", "rain", "n_obs"))
    return sy.prepare_time_series(rows, "rain", ["n_obs"], by=SITE)


@query()
def residual_diagnosis(spark, sf_dir):
    resid = materialise(dc.residual_for_stationarity(panel(spark, sf_dir), "rain", [7, 30], by=SITE))
    return sy.decomposition_quality(sy.residual_diagnosis(resid, "resid", by=SITE))


@query()
def stationarity_synthesis(spark, sf_dir):
    """Several passes over one series table: it is written once, then reread."""
    rows = materialise(panel(spark, sf_dir).select("site", "day", "rain"))
    found = ac.acf(rows, "rain", BUDGET, by=SITE)
    orders = ac.suggest_orders(found, ac.pacf(rows, "rain", BUDGET, by=SITE), PERIODS, ["site"])
    tests = sy.stationarity_tests(rows, "rain", "ct", by=SITE)
    return sy.synthesis(tests, found, orders, ["site"], PERIODS)


# --- spectra ------------------------------------------------------------------

SPECTRUM = TOTAL + """
, d AS (SELECT day, rain - AVG(rain) OVER f AS x, COUNT(*) OVER f AS c FROM total WINDOW f AS (ORDER BY day ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)),
x AS (SELECT x, ROW_NUMBER() OVER (ORDER BY day) - 1 AS pos, COUNT(*) OVER () AS n FROM d WHERE c = 30),
k AS (SELECT UNNEST(GENERATE_SERIES(1, (SELECT CAST(FLOOR((MAX(n) - 1) / 2) AS BIGINT) FROM x))) AS k),
s AS (SELECT k, n, SUM(x * COS(2 * PI() * ((k * pos) % n) / n)) AS c, SUM(x * SIN(2 * PI() * ((k * pos) % n) / n)) AS s FROM x CROSS JOIN k GROUP BY 1, 2),
spectrum AS (SELECT k, k / n AS frequency, n / k AS period, SQRT(c * c + s * s) AS magnitude FROM s)
"""


def total_spectrum(spark, sf_dir):
    return sp.detrended_spectrum(daily_total(spark, sf_dir), "rain", by=SITE)


@query(SPECTRUM + "SELECT k, ROUND(frequency, 9) AS frequency, ROUND(period, 7) AS period, ROUND(magnitude, 4) AS magnitude FROM spectrum")
def periodogram(spark, sf_dir):
    out = total_spectrum(spark, sf_dir).drop("site")
    return rounded(rounded(rounded(out, 9, "frequency"), 7, "period"), 4, "magnitude")


@query(SPECTRUM + "SELECT k, ROUND(frequency, 9) AS frequency, ROUND(period, 7) AS period, ROUND(magnitude, 4) AS magnitude FROM spectrum")
def periodogram_by_sums(spark, sf_dir):
    """The route of series too long for one task."""
    flat = detrend_centred(daily_total(spark, sf_dir), "rain", 30, by=SITE)
    out = sp.periodogram_by_sums(flat.select("site", "day", "detrended"), "detrended", by=SITE).drop("site")
    return rounded(rounded(rounded(out, 9, "frequency"), 7, "period"), 4, "magnitude")


@query()
def site_periodograms(spark, sf_dir):
    return sp.detrended_spectrum(panel(spark, sf_dir), "rain", by=SITE)


DOMINANT = """
, top AS (SELECT period FROM spectrum ORDER BY magnitude DESC, k DESC LIMIT 10),
dom AS (SELECT DISTINCT CAST(ROUND_EVEN(period, 0) AS INT) AS period_days FROM top WHERE period BETWEEN 7 AND 730)
"""


@query(SPECTRUM + DOMINANT + "SELECT CAST(ROW_NUMBER() OVER (ORDER BY period_days DESC) AS INT) AS rank, period_days FROM dom")
def dominant_periods(spark, sf_dir):
    return sp.dominant_periods(total_spectrum(spark, sf_dir), keys=["site"]).drop("site")


@query(SPECTRUM + """
SELECT k, ROUND(frequency, 9) AS frequency, ROUND(period, 7) AS period, ROUND(magnitude, 4) AS magnitude,
       ROUND(LOG10(magnitude * magnitude + 1e-12), 6) AS log_power FROM spectrum WHERE period <= 365
""")
def power_spectrum(spark, sf_dir):
    out = sp.power_table(total_spectrum(spark, sf_dir)).drop("site", "power")
    return rounded(rounded(rounded(rounded(out, 9, "frequency"), 7, "period"), 4, "magnitude"), 6, "log_power")


@query(SPECTRUM + DOMINANT + """
, n AS (SELECT period_days, LOG10(magnitude * magnitude + 1e-12) AS lp,
  ROW_NUMBER() OVER (PARTITION BY period_days ORDER BY ABS(period - period_days), k) AS rn FROM dom CROSS JOIN spectrum WHERE period <= 365)
SELECT period_days, ROUND(CASE WHEN period_days <= 365 THEN lp ELSE 0.0 END, 6) AS log_power FROM n WHERE rn = 1
""")
def dominant_period_power(spark, sf_dir):
    spectrum = total_spectrum(spark, sf_dir)
    dominant = sp.dominant_periods(spectrum, keys=["site"])
    return rounded(sp.period_power(sp.power_table(spectrum), dominant, ["site"]).drop("site"), 6, "log_power")


@query()
def wavelet_spectrum(spark, sf_dir):
    """The last three years, as the definition has it."""
    return sp.wavelet_power_by_scale(panel(spark, sf_dir), "rain", by=SITE)


@query()
def wavelet_whole_series(spark, sf_dir):
    return sp.wavelet_power_by_scale(panel(spark, sf_dir), "rain", rows=None, by=SITE)


SMALL_SCALES = [2.0, 3.0, 5.0]


def taps_sql(scales) -> str:
    found = [(s, *sp.morlet_taps(s)) for s in scales]
    return ", ".join(f"({s}, {place - j}, {float(w)!r}::DOUBLE)" for s, taps, place in found for j, w in enumerate(taps))


CONVOLVED = PANEL + f"""
, o AS MATERIALIZED (SELECT site, day, rain AS x, ROW_NUMBER() OVER (PARTITION BY site ORDER BY day) AS pos FROM panel),
k AS (SELECT * FROM (VALUES {taps_sql(SMALL_SCALES)}) v(scale, away, w)),
f AS (SELECT o.site, pos - away AS pos, scale, SUM(w * x) AS coef FROM o CROSS JOIN k GROUP BY 1, 2, 3),
c AS (SELECT o.site, o.day, scale, coef FROM f JOIN o ON o.site = f.site AND o.pos = f.pos)
"""


@query(CONVOLVED + "SELECT site, CAST(scale AS DOUBLE) AS scale, day, ROUND(coef, 6) AS coef, ROUND(coef * coef, 5) AS power FROM c")
def wavelet_small_scales(spark, sf_dir):
    """Coefficients of the smallest kernels over whole series, which SQL can convolve."""
    out = sp.wavelet_power(panel(spark, sf_dir), "rain", years=None, scales=SMALL_SCALES, by=SITE)
    return rounded(rounded(out, 6, "coef"), 5, "power")


@query(CONVOLVED + "SELECT site, CAST(scale AS DOUBLE) AS scale, CAST(scale AS DOUBLE) AS period, ROUND(AVG(coef * coef), 6) AS global_power FROM c GROUP BY 1, 2")
def wavelet_small_scale_power(spark, sf_dir):
    out = sp.wavelet_power_by_scale(panel(spark, sf_dir), "rain", rows=None, scales=SMALL_SCALES, by=SITE)
    return rounded(out, 6, "global_power")


@query()
def wavelet_dominant_periods(spark, sf_dir):
    return sp.dominant_wavelet_periods(wavelet_spectrum(spark, sf_dir), keys=["site"])


@query()
def wavelet_one_year(spark, sf_dir):
    scales = [float(s) for s in np.logspace(1, 2, 20)]
    return sp.wavelet_power_by_scale(panel(spark, sf_dir), "rain", 365, scales, True, 2.0, by=SITE)


# --- decomposition ------------------------------------------------------------

def loess_weights_sql(name: str, q: int, n: int, degree: int = 1) -> str:
    """The literal weights of one loess pass over series of n > q values: (kind, at, j, w) for the kernel (j from the
    position), the first positions (j from 0) and the last ones (at and j from the end); one step outside included."""
    half = (q + 1) // 2
    _, kernel = loess.frame_weights(n // 2, n, q, degree)
    rows = [("k", 0, i - half + 1, w) for i, w in enumerate(kernel)]
    for at in [-1, *range(half - 1)]:
        rows += [("h", at, j, w) for j, w in enumerate(loess.frame_weights(at, n, q, degree, first=0)[1])]
    for back in range(0, q - half + 1):
        rows += [("t", back, q - j, w) for j, w in enumerate(loess.frame_weights(n - back, n, q, degree, first=n - q)[1])]
    values = ", ".join(f"('{k}', {a}, {j}, {float(w)!r}::DOUBLE)" for k, a, j, w in rows if w)
    return f"{name}_w AS (SELECT * FROM (VALUES {values}) v(kind, at_, j, w))"


def loess_sql(name: str, source: str, keys: str, q: int, n: int, extend: bool = False) -> str:
    """CTEs of a loess pass over ``source`` (keys, pos, n, x): ``name`` has (keys, pos, n, x)."""
    half = (q + 1) // 2
    targets = f"SELECT {keys}, pos, n FROM {source}"
    if extend:
        targets += f" UNION ALL SELECT DISTINCT {keys}, -1, n FROM {source} UNION ALL SELECT DISTINCT {keys}, n, n FROM {source}"
    return f"""{loess_weights_sql(name, q, n)},
{name}_t AS ({targets}),
{name}_f AS (SELECT {keys}, pos, n, pos + j AS src, w FROM {name}_t JOIN {name}_w ON kind = 'k' AND pos >= {half - 1} AND pos < n - {q - half}
  UNION ALL SELECT {keys}, pos, n, j, w FROM {name}_t JOIN {name}_w ON kind = 'h' AND pos = at_
  UNION ALL SELECT {keys}, pos, n, n - j, w FROM {name}_t JOIN {name}_w ON kind = 't' AND n - pos = at_),
{name} AS (SELECT {keys}, f.pos, f.n, SUM(w * s.x) AS x FROM {name}_f f JOIN (SELECT {keys}, pos AS src, x FROM {source}) s
  USING ({keys}, src) GROUP BY {keys}, f.pos, f.n)"""


PLACED = PANEL + """
, o AS (SELECT site, day, LN(1 + rain) AS x, ROW_NUMBER() OVER (PARTITION BY site ORDER BY day) - 1 AS pos, COUNT(*) OVER (PARTITION BY site) AS n FROM panel)
"""


@query(PLACED + ", " + loess_sql("smooth", "o", "site", 31, CALENDAR_DAYS)
       + " SELECT site, day, ROUND(smooth.x, 8) AS smooth FROM o JOIN smooth USING (site, pos)")
def loess_trend(spark, sf_dir):
    """One loess pass of 31 days over every site's log rain."""
    rows = panel(spark, sf_dir).select("site", "day", F.log1p("rain").alias("x"))
    return rounded(dc.loess_smooth(rows, "x", 31, by=SITE), 8, "smooth").select("site", "day", "smooth")


# One round of a weekly season (window 11, low-pass 9, trend 13), every filter written out.
STL_ROUND = PLACED + """
, c AS (SELECT site, pos % 7 AS phase, pos // 7 AS pos, COUNT(*) OVER (PARTITION BY site, pos % 7) AS n, x FROM o), """ + loess_sql(
    "cycle", "c", "site, phase", 11, CALENDAR_DAYS // 7, extend=True) + """,
e AS (SELECT site, pos * 7 + phase AS pos, x FROM cycle),
m1 AS (SELECT site, pos, AVG(x) OVER w AS x, COUNT(*) OVER w AS k FROM e WINDOW w AS (PARTITION BY site ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
m2 AS (SELECT site, pos, AVG(x) OVER w AS x, COUNT(*) OVER w AS k FROM m1 WHERE k = 7 WINDOW w AS (PARTITION BY site ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
m3 AS (SELECT site, pos, AVG(x) OVER w AS x, COUNT(*) OVER w AS k FROM m2 WHERE k = 7 WINDOW w AS (PARTITION BY site ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
l0 AS (SELECT m3.site, m3.pos + 7 AS pos, o.n, m3.x FROM m3 JOIN o ON o.site = m3.site AND o.pos = m3.pos + 7 WHERE k = 3), """ + loess_sql(
    "low", "l0", "site", 9, CALENDAR_DAYS) + """,
s AS (SELECT o.site, o.day, o.pos, o.n, e.x - low.x AS season, o.x - (e.x - low.x) AS x FROM o JOIN e USING (site, pos) JOIN low USING (site, pos)), """ + loess_sql(
    "level", "s", "site", 13, CALENDAR_DAYS) + """
SELECT site, day, ROUND(s.x + season, 8) AS observed, ROUND(level.x, 8) AS trend, ROUND(season, 8) AS seasonal_1, ROUND(s.x - level.x, 8) AS resid
FROM s JOIN level USING (site, pos)
"""


@query(STL_ROUND)
def seasonal_round(spark, sf_dir):
    """A decomposition of one round: weekly season, trend and the rest."""
    parts = dc.decompose(panel(spark, sf_dir), "rain", [7], inner_iter=1, by=SITE)
    return rounded(parts, 8, "observed", "trend", "seasonal_1", "resid")


@query()
def seasonal_decomposition(spark, sf_dir):
    return dc.decompose(panel(spark, sf_dir), "rain", [7, 30, 365], by=SITE)


@query(PANEL + "SELECT site, day, ROUND(LN(1 + rain), 6) AS recomposed FROM panel")
def decomposition_adds_up(spark, sf_dir):
    parts = dc.decompose(panel(spark, sf_dir), "rain", [7, 30], by=SITE)
    whole = F.round(F.col("trend") + F.col("seasonal_1") + F.col("seasonal_2") + F.col("resid"), 6)
    return parts.select("site", "day", whole.alias("recomposed"))


@query(PANEL + """
, k AS (SELECT site, day, ROUND(AVG(rain) OVER f, 6) AS trend, 0.0 AS seasonal, ROUND(rain - AVG(rain) OVER f, 6) AS resid FROM panel
        WINDOW f AS (PARTITION BY site ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
j AS (SELECT p.site, p.day, rain, trend AS "MSTL_Trend", seasonal AS "MSTL_Seasonal", resid AS "MSTL_Residual"
      FROM panel p LEFT JOIN (SELECT * FROM k WHERE YEAR(day) > 1995) k ON p.site = k.site AND p.day = k.day)
SELECT *, LAG("MSTL_Trend") OVER w AS "MSTL_Trend_lag_1", LAG("MSTL_Residual") OVER w AS "MSTL_Residual_lag_1",
       LAG("MSTL_Seasonal") OVER w AS "MSTL_Seasonal_lag_1" FROM j WINDOW w AS (PARTITION BY site ORDER BY day)
""")
def component_features(spark, sf_dir):
    """Components from a trailing mean stand in for a decomposition."""
    rows = panel(spark, sf_dir).select("site", "day", "rain")
    mean = F.avg("rain").over(SITE.window().rowsBetween(-6, 0))
    parts = rows.withColumn("trend", F.round(mean, 6)).withColumn("resid", F.round(F.col("rain") - mean, 6)).select(
        "site", "day", "trend", F.lit(0.0).alias("seasonal_1"), "resid"
    ).filter(F.year("day") > 1995)
    return dc.create_mstl_features(rows, parts, lag_periods=[1], by=SITE)

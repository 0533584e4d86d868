"""Correlation, multicollinearity, clustering and network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.operators import correlation as co
from pluvia.operators import features as fx
from pluvia.plans.catalog.registry import PANEL, RAW, query, rounded
from pluvia.sources.panel import CALENDAR_DAYS, MEASURES, PREDICTORS, panel, site_series, table

SITE = site_series()
# Name parts that put the panel's measures into categories.
TERMS = [("Temperature", ["temp"]), ("Humidity", ["humid"]), ("Wind", ["wind"]), ("Pressure_Radiation", ["press"])]
PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:]]
RAW_PAIRS = [(a, b) for i, a in enumerate(RAW) for b in RAW[i + 1:]]


def corr_union(source: str, pairs, key: str = "site") -> str:
    keyed, group = (f"{key}, ", f" GROUP BY {key}") if key else ("", "")
    return " UNION ALL ".join(
        f"SELECT {keyed}'{a}' AS feature_a, '{b}' AS feature_b, COUNT(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n,"
        f" CORR({a}, {b}) AS r FROM {source}{group}" for a, b in pairs
    )


@query(PANEL + f", c AS ({corr_union('panel', PAIRS)}) SELECT site, feature_a, feature_b, n, ROUND(r, 8) AS r FROM c")
def pearson_matrix(spark, sf_dir):
    return rounded(co.pearson_matrix(panel(spark, sf_dir), MEASURES, ["site"]), 8, "r")


@query(f"WITH c AS ({corr_union('lineitem', RAW_PAIRS, '')}) SELECT feature_a, feature_b, n, ROUND(r, 8) AS r FROM c")
def raw_pearson_matrix(spark, sf_dir):
    return rounded(co.pearson_matrix(table(spark, sf_dir, "lineitem"), RAW), 8, "r")


def ranked_sql(source: str, pairs, key: str = "site") -> str:
    keyed = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    same = f"PARTITION BY {key}," if key else "PARTITION BY"
    blocks = []
    for a, b in pairs:
        group = f" GROUP BY {key}" if key else ""
        blocks.append(
            f"SELECT {keyed}'{a}' AS feature_a, '{b}' AS feature_b, COUNT(*) AS n, CORR(ra, rb) AS r FROM ("
            f"SELECT {keyed}RANK() OVER ({part} ORDER BY {a}) + (COUNT(*) OVER ({same} {a}) - 1) / 2.0 AS ra,"
            f" RANK() OVER ({part} ORDER BY {b}) + (COUNT(*) OVER ({same} {b}) - 1) / 2.0 AS rb"
            f" FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL){group}"
        )
    return " UNION ALL ".join(blocks)


@query(PANEL + f", c AS ({ranked_sql('panel', PAIRS)}) SELECT site, feature_a, feature_b, n, ROUND(r, 8) AS r FROM c")
def spearman_matrix(spark, sf_dir):
    out = co.spearman_matrix(panel(spark, sf_dir), MEASURES, ["site"], rows_bound=CALENDAR_DAYS)
    return rounded(out, 8, "r")


@query(f"WITH c AS ({ranked_sql('lineitem', RAW_PAIRS, '')}) SELECT feature_a, feature_b, n, ROUND(r, 8) AS r FROM c")
def raw_spearman_matrix(spark, sf_dir):
    """One group per pair over all rows: ranks come from the distributed cumulation."""
    return rounded(co.spearman_matrix(table(spark, sf_dir, "lineitem"), RAW), 8, "r")


@query(PANEL + f"""
, p AS ({corr_union('panel', PAIRS)}), s AS ({ranked_sql('panel', PAIRS)})
SELECT p.site, p.feature_a, p.feature_b, ROUND(p.r, 8) AS pearson, ROUND(s.r, 8) AS spearman, ROUND(s.r - p.r, 8) AS difference
FROM p JOIN s ON p.site = s.site AND p.feature_a = s.feature_a AND p.feature_b = s.feature_b
""")
def nonlinearity_matrix(spark, sf_dir):
    out = co.nonlinearity_matrix(panel(spark, sf_dir), MEASURES, ["site"], CALENDAR_DAYS)
    return rounded(out, 8, "pearson", "spearman", "difference")


TARGET_CORR = f", c AS ({corr_union('panel', [('rain', c) for c in PREDICTORS])})"


@query(PANEL + TARGET_CORR + """
SELECT site, feature_b AS feature, n, ROUND(r, 8) AS r,
       CASE WHEN ABS(r) > 0.3 THEN 'strong' WHEN ABS(r) > 0.2 THEN 'moderate' ELSE 'weak' END AS strength FROM c
""")
def predictor_ranking(spark, sf_dir):
    return rounded(co.rank_predictors(panel(spark, sf_dir), "rain", MEASURES, ["site"]), 8, "r")


@query(PANEL + TARGET_CORR + """
, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site ORDER BY r DESC NULLS LAST, feature_b) AS rn FROM c)
SELECT site, feature_b AS feature, ROUND(r, 8) AS r FROM k WHERE rn <= 2
""")
def top_variables(spark, sf_dir):
    return rounded(co.top_variables(panel(spark, sf_dir), "rain", MEASURES, 2, ["site"]), 8, "r")


SEASON_SQL = """CASE WHEN MONTH(day) IN (12, 1, 2) THEN 'Dry' WHEN MONTH(day) IN (3, 4, 5) THEN 'Pre-wet'
 WHEN MONTH(day) IN (6, 7, 8) THEN 'Wet' ELSE 'Post-wet' END"""


@query(PANEL + f", s AS (SELECT *, {SEASON_SQL} AS season FROM panel) " + " UNION ALL ".join(
    f"SELECT site, season, COUNT(*) AS days, '{c}' AS feature, ROUND(CORR({c}, rain), 8) AS r FROM s GROUP BY 1, 2 HAVING COUNT(*) > 30"
    for c in PREDICTORS))
def seasonal_correlations(spark, sf_dir):
    return rounded(co.seasonal_correlations(panel(spark, sf_dir), "rain", MEASURES, "day", ["site"]), 8, "r")


def lines_by_day(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))


DAILY = "daily AS (SELECT CAST(l_shipdate AS DATE) AS day, " + ", ".join(
    f"AVG({c}) AS {c}" for c in RAW) + " FROM lineitem GROUP BY 1)"


@query("WITH " + DAILY + " SELECT day, " + ", ".join(f"ROUND({c}, 8) AS {c}" for c in RAW) + " FROM daily")
def daily_means(spark, sf_dir):
    return rounded(co.daily_means(lines_by_day(spark, sf_dir), RAW, "day"), 8, *RAW)


def daily_rows(spark, sf_dir):
    """All raw rows rolled up to one row per day, then treated as one series."""
    daily = co.daily_means(lines_by_day(spark, sf_dir), RAW, "day")
    return daily.select(F.lit(0).alias("site"), "day", *RAW)


LAGGED = "WITH " + DAILY + ", l AS (" + " UNION ALL ".join(
    f"SELECT '{v}' AS feature, {k} AS lag, COALESCE(CORR(l_extendedprice, x), 0) AS r FROM "
    f"(SELECT l_extendedprice, {'LAG' if k >= 0 else 'LEAD'}({v}, {abs(k)}) OVER (ORDER BY day) AS x FROM daily)"
    for v in ("l_quantity", "l_discount") for k in range(-5, 6)) + ")"


@query(LAGGED + " SELECT feature, lag, ROUND(r, 8) AS r FROM l")
def lagged_correlations(spark, sf_dir):
    out = co.lagged_correlations(daily_rows(spark, sf_dir), "l_extendedprice", ["l_quantity", "l_discount"], by=SITE)
    return rounded(out, 8, "r").drop("site")


@query(LAGGED + """
, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY ABS(r) DESC, lag) AS rn FROM l)
SELECT feature, lag AS best_lag, ROUND(r, 8) AS best_correlation FROM k WHERE rn = 1
""")
def best_lags(spark, sf_dir):
    out = co.lagged_correlations(daily_rows(spark, sf_dir), "l_extendedprice", ["l_quantity", "l_discount"], by=SITE)
    return rounded(co.best_lag(out, ["site"]), 8, "best_correlation").drop("site")


def rolling_corr_cte(v: str) -> str:
    f = "OVER (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
    return f"""SELECT '{v}' AS feature, AVG(r) AS m, STDDEV_SAMP(r) AS s FROM (
      SELECT CASE WHEN COUNT(*) {f} = 30 THEN CORR(l_extendedprice, {v}) {f} END AS r FROM daily) WHERE r IS NOT NULL"""


@query("WITH " + DAILY + f", a AS ({rolling_corr_cte('l_quantity')} UNION ALL {rolling_corr_cte('l_discount')})" + """
SELECT feature, ROUND(m, 7) AS mean_correlation, ROUND(s, 7) AS std_correlation,
       CASE WHEN s < 0.1 THEN 'Stable' ELSE 'Variable' END AS stability FROM a
""")
def rolling_correlations(spark, sf_dir):
    out = co.rolling_correlation_summary(
        daily_rows(spark, sf_dir), "l_extendedprice", ["l_quantity", "l_discount"], 30, by=SITE
    )
    return rounded(out, 7, "mean_correlation", "std_correlation").drop("site")


@query(PANEL + """
, w AS (SELECT site, day, CORR(rain, temp) OVER f AS r, COUNT(*) OVER f AS c FROM (SELECT * FROM panel WHERE temp IS NOT NULL)
  WINDOW f AS (PARTITION BY site ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT site, day, ROUND(CASE WHEN c = 30 THEN r END, 7) AS rolling_corr FROM w
""")
def site_rolling_correlation(spark, sf_dir):
    rows = panel(spark, sf_dir).select("site", "day", "rain", "temp")
    out = fx.rolling_correlation(rows, "rain", "temp", 30, by=SITE)
    return rounded(out, 7, "rolling_corr").drop("rain", "temp")


@query(PANEL + ", f AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CORR({c}, rain) AS r, VAR_SAMP({c}) AS v, AVG(CAST({c} IS NULL AS INT)) AS m FROM panel"
    for c in [*PREDICTORS, "n_obs"]) + """)
SELECT feature, ROUND(r, 8) AS correlation, ROUND(v, 3) AS variance, ROUND(m, 8) AS missing_share, ABS(r) < 0.05 AS low_correlation,
       v < 0.01 AS low_variance, m > 0.1 AS high_missing, ABS(r) < 0.05 OR v < 0.01 OR m > 0.1 AS recommended_to_drop FROM f
""")
def feature_quality(spark, sf_dir):
    out = co.feature_quality(panel(spark, sf_dir), "rain", [*MEASURES, "n_obs"])
    return rounded(rounded(out, 8, "correlation", "missing_share"), 3, "variance")


@query(f"""
WITH p AS (SELECT p_partkey, p_type FROM part)
SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' OR p_type LIKE '%TIN%' THEN 'Metal' WHEN p_type LIKE '%BRASS%' THEN 'Alloy'
       WHEN p_type = 'target' THEN 'Precipitation' ELSE 'Other' END AS category FROM p
""")
def term_categories(spark, sf_dir):
    terms = [("Metal", ["STEEL", "TIN"]), ("Alloy", ["BRASS"])]
    return table(spark, sf_dir, "part").select(
        "p_partkey", co.feature_category(F.col("p_type"), "target", terms).alias("category")
    )


# --- multicollinearity --------------------------------------------------------

VIF_COLUMNS = PREDICTORS


def determinant(m: list[list[str]]) -> str:
    """SQL of a determinant, expanded along the first row."""
    if len(m) == 1:
        return m[0][0]
    minors = [determinant([row[:j] + row[j + 1:] for row in m[1:]]) for j in range(len(m))]
    return "(" + " ".join(f"{'+-'[j % 2]} {m[0][j]} * {minors[j]}" for j in range(len(m))) + ")"


def inverse_diagonal(columns: list[str]) -> str:
    """Rows (f, v): diagonal of the inverse of the correlation matrix, from ratios of determinants over ``r``."""
    m = [["1.0" if a == b else f"r_{min(a, b)}_{max(a, b)}" for b in columns] for a in columns]
    whole = determinant(m)
    return " UNION ALL ".join(
        f"SELECT '{c}' AS f, {determinant([row[:i] + row[i + 1:] for k, row in enumerate(m) if k != i])} / {whole} AS v FROM r"
        for i, c in enumerate(columns))


VIF = PANEL + f""", r AS (SELECT {", ".join(f"CORR({a}, {b}) AS r_{min(a, b)}_{max(a, b)}" for i, a in enumerate(PREDICTORS) for b in PREDICTORS[i + 1:])}
  FROM panel WHERE {" AND ".join(f"{c} IS NOT NULL" for c in PREDICTORS)}), v AS ({inverse_diagonal(PREDICTORS)})
SELECT f AS "Feature", ROUND(v, 7) AS "VIF_Score",
  CASE f WHEN 'temp' THEN 'Temperature' WHEN 'humidity' THEN 'Humidity' WHEN 'wind' THEN 'Wind' ELSE 'Pressure_Radiation' END AS "Category",
  CASE WHEN v < 5 THEN 'Low' WHEN v < 10 THEN 'Moderate' ELSE 'High' END AS "Risk_Level" FROM v
"""


@query(VIF)
def vif(spark, sf_dir):
    return rounded(co.vif_table(panel(spark, sf_dir), VIF_COLUMNS, "rain", TERMS), 7, "VIF_Score")


@query("""
WITH c AS (SELECT CORR(l_quantity, l_extendedprice) AS a, CORR(l_quantity, l_discount) AS b, CORR(l_extendedprice, l_discount) AS d FROM lineitem),
v AS (SELECT 'l_quantity' AS f, 1 / (1 - (a * a + b * b - 2 * a * b * d) / (1 - d * d)) AS v FROM c UNION ALL
      SELECT 'l_extendedprice', 1 / (1 - (a * a + d * d - 2 * a * b * d) / (1 - b * b)) FROM c UNION ALL
      SELECT 'l_discount', 1 / (1 - (b * b + d * d - 2 * a * b * d) / (1 - a * a)) FROM c)
SELECT f AS "Feature", ROUND(v, 9) AS "VIF_Score", 'Other' AS "Category", 'Low' AS "Risk_Level" FROM v
""")
def raw_vif(spark, sf_dir):
    return rounded(co.vif_table(table(spark, sf_dir, "lineitem"), RAW[:3], "l_tax"), 9, "VIF_Score")


CLOSEST = PANEL + f""", c AS ({corr_union('panel', [(a, b) for i, a in enumerate(PREDICTORS) for b in PREDICTORS[i + 1:]], '')}),
s AS (SELECT feature_a AS f, ABS(r) AS a FROM c UNION ALL SELECT feature_b, ABS(r) FROM c),
m AS (SELECT f, MAX(a) AS a FROM s GROUP BY f),
v AS (SELECT f AS "Feature", CASE WHEN a < 0.99 THEN 1 / (1 - a * a) ELSE 100 END AS v,
  CASE f WHEN 'temp' THEN 'Temperature' WHEN 'humidity' THEN 'Humidity' WHEN 'wind' THEN 'Wind' ELSE 'Pressure_Radiation' END AS cat FROM m),
vif AS (SELECT *, CASE WHEN v < 5 THEN 'Low' WHEN v < 10 THEN 'Moderate' ELSE 'High' END AS risk FROM v)
"""


def closest(spark, sf_dir):
    return co.vif_by_closest_pair(panel(spark, sf_dir), VIF_COLUMNS, "rain", TERMS)


@query(CLOSEST + 'SELECT "Feature", ROUND(v, 6) AS "VIF_Score", cat AS "Category", risk AS "Risk_Level" FROM vif')
def vif_closest_pair(spark, sf_dir):
    return rounded(closest(spark, sf_dir), 6, "VIF_Score")


@query(CLOSEST + """
SELECT cat AS "Category", ROUND(AVG(v), 6) AS mean_vif, ROUND(MAX(v), 6) AS max_vif, COUNT(*) AS n_features FROM vif GROUP BY cat
""")
def vif_by_category(spark, sf_dir):
    return rounded(co.vif_by_category(closest(spark, sf_dir)), 6, "mean_vif", "max_vif")


@query(CLOSEST + 'SELECT risk AS "Risk_Level", COUNT(*) AS n_features FROM vif GROUP BY risk')
def vif_by_risk(spark, sf_dir):
    return co.vif_by_risk(closest(spark, sf_dir))


@query(CLOSEST + """
SELECT COUNT(*) FILTER (v > 10) AS high, COUNT(*) FILTER (v > 5 AND v <= 10) AS moderate, COUNT(*) FILTER (v <= 5) AS low,
       ROUND(AVG(v), 6) AS mean_vif, ROUND(QUANTILE_CONT(v, 0.5), 6) AS median_vif, ROUND(STDDEV_SAMP(v), 6) AS std_vif FROM vif
""")
def vif_summary(spark, sf_dir):
    return rounded(co.vif_summary(closest(spark, sf_dir)), 6, "mean_vif", "median_vif", "std_vif")


@query()
def pca_components(spark, sf_dir):
    return co.pca_against_target(panel(spark, sf_dir), PREDICTORS, "rain")


@query("""
WITH s AS (SELECT AVG(l_quantity) AS mq, STDDEV_SAMP(l_quantity) AS sq, AVG(l_extendedprice) AS me, STDDEV_SAMP(l_extendedprice) AS se,
  CORR(l_quantity, l_extendedprice) AS r FROM lineitem),
z AS (SELECT (l_quantity - mq) / sq + SIGN(r) * (l_extendedprice - me) / se AS p1,
             (l_quantity - mq) / sq - SIGN(r) * (l_extendedprice - me) / se AS p2, l_discount AS t, r FROM lineitem CROSS JOIN s),
c AS (SELECT MAX(r) AS r, ABS(CORR(p1, t)) AS c1, ABS(CORR(p2, t)) AS c2 FROM z)
SELECT 'PC1' AS "PC", ROUND((1 + ABS(r)) / 2, 9) AS "Explained_Variance", ROUND((1 + ABS(r)) / 2, 9) AS "Cumulative_Variance",
       ROUND(c1, 7) AS "Target_Correlation" FROM c
UNION ALL SELECT 'PC2', ROUND((1 - ABS(r)) / 2, 9), 1.0, ROUND(c2, 7) FROM c
""")
def raw_pca(spark, sf_dir):
    """Two columns, so the components are known; their sign is arbitrary."""
    out = co.pca_against_target(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "l_discount")
    out = out.withColumn("Target_Correlation", F.round(F.abs("Target_Correlation"), 7))
    return rounded(out, 9, "Explained_Variance", "Cumulative_Variance")


@query()
def feature_clusters(spark, sf_dir):
    return co.feature_clusters(panel(spark, sf_dir), [*MEASURES, "n_obs"], 2)


# --- network ------------------------------------------------------------------

NET_COLUMNS = [*MEASURES, "n_obs"]
NET_PAIRS = [(a, b) for i, a in enumerate(NET_COLUMNS) for b in NET_COLUMNS[i + 1:]]
EDGES = PANEL + f", c AS ({corr_union('panel', NET_PAIRS, '')}), e AS (SELECT feature_a, feature_b, r, ABS(r) AS w FROM c WHERE ABS(r) >= 0.25)"
NODES = "nodes(feature) AS (VALUES " + ", ".join(f"('{c}')" for c in NET_COLUMNS) + ")"
NODE_SQL = f"""
, {NODES}, l AS (SELECT feature_a AS a, feature_b AS b FROM e UNION ALL SELECT feature_b, feature_a FROM e),
d AS (SELECT a, COUNT(*) AS degree FROM l GROUP BY a),
t AS (SELECT x.a AS node, COUNT(*) AS tri FROM l x JOIN l y ON x.a = y.a AND x.b < y.b JOIN l z ON z.a = x.b AND z.b = y.b GROUP BY x.a),
m AS (SELECT feature, COALESCE(degree, 0) AS degree, COALESCE(degree, 0) / {len(NET_COLUMNS) - 1}.0 AS degree_centrality,
  CASE WHEN degree > 1 THEN COALESCE(tri, 0) / (degree * (degree - 1) / 2) ELSE 0.0 END AS clustering
  FROM nodes LEFT JOIN d ON d.a = feature LEFT JOIN t ON t.node = feature)
"""


def edges(spark, sf_dir):
    return co.network_edges(panel(spark, sf_dir), NET_COLUMNS)


@query(EDGES + "SELECT feature_a, feature_b, ROUND(r, 8) AS correlation, ROUND(w, 8) AS weight FROM e")
def network_edges(spark, sf_dir):
    return rounded(edges(spark, sf_dir), 8, "correlation", "weight")


@query(EDGES + NODE_SQL + "SELECT feature, degree, ROUND(degree_centrality, 8) AS degree_centrality, ROUND(clustering, 8) AS clustering FROM m")
def network_node_metrics(spark, sf_dir):
    return rounded(co.node_metrics(edges(spark, sf_dir), NET_COLUMNS), 8, "degree_centrality", "clustering")


@query(EDGES + NODE_SQL + f"""
SELECT {len(NET_COLUMNS)} AS n_nodes, (SELECT COUNT(*) FROM e) AS n_edges,
       ROUND((SELECT COUNT(*) FROM e) * 2.0 / {len(NET_COLUMNS) * (len(NET_COLUMNS) - 1)}, 8) AS density,
       ROUND((SELECT AVG(w) FROM e), 8) AS mean_weight, ROUND((SELECT MAX(w) FROM e), 8) AS max_weight,
       ROUND(AVG(clustering), 8) AS average_clustering FROM m
""")
def network_metrics(spark, sf_dir):
    out = co.network_metrics(edges(spark, sf_dir), NET_COLUMNS)
    return rounded(out, 8, "density", "mean_weight", "max_weight", "average_clustering")

"""Quality, distribution, calendar-profile, extreme-event and chart-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia import constants as C
from pluvia.operators import profile as pf
from pluvia.operators import quality as ql
from pluvia.operators.clean import to_long
from pluvia.plans.catalog.registry import LONG, PANEL, RAW, query, rounded
from pluvia.sources.panel import CALENDAR_DAYS, MEASURES, panel, table

BOUND = {"rows_bound": CALENDAR_DAYS}


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def long_lines(spark, sf_dir):
    return to_long(lines(spark, sf_dir), [], RAW, "feature", "v")


# --- quality ------------------------------------------------------------------

@query("""
SELECT COUNT(*) AS n_rows, 11 AS n_cols,
       'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate'
       AS columns FROM lineitem
""")
def quality_basic(spark, sf_dir):
    return ql.basic_info(lines(spark, sf_dir))


@query(PANEL + """
, m AS (SELECT COUNT(*) AS n, COUNT(temp) AS k FROM panel)
SELECT 4 * (n - k) AS total_missing, ROUND(4 * (n - k) * 100.0 / (n * 8), 2) AS missing_percentage FROM m
""")
def quality_missing(spark, sf_dir):
    return ql.missing_overall(panel(spark, sf_dir))


@query(PANEL + """
, m AS (SELECT COUNT(*) - COUNT(temp) AS missing FROM panel)
SELECT c AS "column", missing FROM m CROSS JOIN (VALUES ('temp'), ('humidity'), ('pressure'), ('wind')) v(c)
""")
def quality_missing_columns(spark, sf_dir):
    return ql.missing_by_column(panel(spark, sf_dir))


@query("""
WITH r AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 40),
k AS (SELECT COUNT(*) AS c FROM r GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
SELECT CAST(SUM(c - 1) AS BIGINT) AS duplicate_rows, ROUND(SUM(c - 1) * 100.0 / SUM(c), 2) AS duplicate_percentage FROM k
""")
def quality_duplicates(spark, sf_dir):
    """Full rows of the line items and a second copy of some of them."""
    rows = lines(spark, sf_dir)
    return ql.duplicate_rows(rows.unionAll(rows.filter("l_linenumber = 1 AND l_quantity > 40")))


@query("""
WITH t AS (SELECT UNNEST([TYPEOF(l_orderkey), TYPEOF(l_partkey), TYPEOF(l_suppkey), TYPEOF(l_linenumber), TYPEOF(l_quantity),
  TYPEOF(l_extendedprice), TYPEOF(l_discount), TYPEOF(l_tax), TYPEOF(l_returnflag), TYPEOF(l_linestatus), TYPEOF(l_shipdate)]) AS c
  FROM lineitem LIMIT 11)
SELECT CASE c WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
       WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type, COUNT(*) AS n_columns FROM t GROUP BY 1
""")
def quality_types(spark, sf_dir):
    """The types that the files themselves declare."""
    return ql.type_counts(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@query(PANEL + """
SELECT TRUE AS target_exists, COUNT(*) - COUNT(temp) AS missing_count,
       ROUND((COUNT(*) - COUNT(temp)) * 100.0 / COUNT(*), 2) AS target_missing_percentage, MIN(temp) AS min_value,
       MAX(temp) AS max_value, ROUND(AVG(temp), 2) AS mean_value, COUNT(*) FILTER (temp = 0) AS zero_days,
       ROUND(COUNT(*) FILTER (temp = 0) * 100.0 / COUNT(*), 2) AS zero_percentage FROM panel
""")
def quality_target(spark, sf_dir):
    return ql.target_check(panel(spark, sf_dir), "temp")


SCORE_SQL = """
, m AS (SELECT ROUND(4 * (COUNT(*) - COUNT(temp)) * 100.0 / (COUNT(*) * 8), 2) AS mp,
        ROUND((COUNT(*) - COUNT({t})) * 100.0 / COUNT(*), 2) AS tp FROM panel)
SELECT mp AS missing_percentage, 0.0 AS duplicate_percentage, TRUE AS target_exists, tp AS target_missing_percentage,
       GREATEST(CAST(TRUNC(100 - LEAST(mp * 2, 30) - LEAST(0.0 * 3, 20) - LEAST(tp * 2, 15)) AS INT), 0) AS overall_score FROM m
"""


@query(PANEL + SCORE_SQL.format(t="temp"))
def quality_score(spark, sf_dir):
    return ql.quality_score(panel(spark, sf_dir), "temp")


# --- distribution -------------------------------------------------------------

DESCRIBE = """
, q AS (SELECT feature, COUNT(v) AS n, AVG(v) AS mean, STDDEV_SAMP(v) AS sd, VAR_SAMP(v) AS var, MIN(v) AS lo, MAX(v) AS hi,
  QUANTILE_CONT(v, 0.05) AS p5, QUANTILE_CONT(v, 0.25) AS q1, QUANTILE_CONT(v, 0.5) AS med, QUANTILE_CONT(v, 0.75) AS q3,
  QUANTILE_CONT(v, 0.95) AS p95, SKEWNESS(v) AS sk, KURTOSIS(v) AS ku FROM long GROUP BY feature),
c AS (SELECT feature, v, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY COUNT(*) DESC, v) AS rn FROM long WHERE v IS NOT NULL GROUP BY feature, v)
"""
DESCRIBE_COLUMNS = """
n AS "Count", ROUND(mean, 6) AS "Mean", ROUND(med, 6) AS "Median", ROUND(v, 6) AS "Mode", ROUND(sd, 5) AS "Std", ROUND(var, 2) AS "Variance",
ROUND(sd * 100 / mean, 6) AS "CV_pct", ROUND(lo, 6) AS "Min", ROUND(p5, 6) AS "P5", ROUND(q1, 6) AS "Q1", ROUND(q3, 6) AS "Q3",
ROUND(p95, 6) AS "P95", ROUND(hi, 6) AS "Max", ROUND(hi - lo, 6) AS "Range", ROUND(q3 - q1, 6) AS "IQR",
ROUND(sk, 5) AS "Skewness", ROUND(ku, 5) AS "Kurtosis"
"""


def round_description(df):
    six = ["Mean", "Median", "Mode", "CV_pct", "Min", "P5", "Q1", "Q3", "P95", "Max", "Range", "IQR"]
    return rounded(rounded(rounded(df, 6, *six), 5, "Std", "Skewness", "Kurtosis"), 2, "Variance")


@query(LONG + DESCRIBE + f'SELECT feature AS "Feature", {DESCRIBE_COLUMNS} FROM q JOIN c USING (feature) WHERE rn = 1')
def descriptive_stats(spark, sf_dir):
    return round_description(pf.descriptive_stats(lines(spark, sf_dir), RAW))


SITE_LONG = ", long AS (SELECT site AS feature, rain AS v FROM panel)"


@query(PANEL + SITE_LONG + DESCRIBE + f"""
SELECT feature AS site, 'rain' AS "Feature", {DESCRIBE_COLUMNS},
  CASE WHEN sk > 1 THEN '{pf.SKEW_STEPS[0][1]}' WHEN sk > 0.5 THEN '{pf.SKEW_STEPS[1][1]}' WHEN sk > -0.5 THEN '{pf.SKEW_STEPS[2][1]}'
       WHEN sk > -1 THEN '{pf.SKEW_STEPS[3][1]}' ELSE '{pf.SKEW_LOWEST}' END AS skew_interpretation,
  CASE WHEN ku > 3 THEN '{pf.KURT_HIGH}' WHEN ku < -3 THEN '{pf.KURT_LOW}' ELSE '{pf.KURT_MIDDLE}' END AS kurtosis_interpretation
FROM q JOIN c USING (feature) WHERE rn = 1
""")
def target_profile(spark, sf_dir):
    return round_description(pf.target_profile(panel(spark, sf_dir), "rain", ["site"], **BOUND))


def band_sql() -> str:
    cases = "CASE WHEN rain = 0 THEN 'no_rain' " + " ".join(
        f"WHEN rain > {lo} " + (f"AND rain <= {hi} " if hi != float("inf") else "") + f"THEN '{k}'"
        for k, lo, hi, *_ in C.RAIN_BANDS[1:]
    ) + " END"
    values = ", ".join(f"('{k}', '{vi}', '{en}')" for k, _, _, vi, en in C.RAIN_BANDS)
    return f"""
, bands(band, label_vi, label_en) AS (VALUES {values}),
n AS (SELECT site, COUNT(*) AS total FROM panel GROUP BY site),
b AS (SELECT site, {cases} AS band, COUNT(*) AS days FROM panel GROUP BY 1, 2)
SELECT n.site, bands.band, label_vi, label_en, COALESCE(days, 0) AS days,
       ROUND(COALESCE(days, 0) * 100.0 / total, 6) AS percentage
FROM n CROSS JOIN bands LEFT JOIN b ON b.site = n.site AND b.band = bands.band
"""


@query(PANEL + band_sql())
def rain_bands(spark, sf_dir):
    return rounded(pf.rain_band_counts(panel(spark, sf_dir), "rain", ["site"]), 6, "percentage")


@query(LONG + """
SELECT feature AS "Feature", ROUND(SKEWNESS(v), 5) AS "Skewness", ROUND(KURTOSIS(v), 5) AS "Kurtosis",
       feature = 'l_discount' AS "Is_Target", ABS(SKEWNESS(v)) > 1 AS "High_Skew" FROM long GROUP BY feature
""")
def shape_comparison(spark, sf_dir):
    return rounded(pf.shape_comparison(lines(spark, sf_dir), RAW, "l_discount"), 5, "Skewness", "Kurtosis")


# --- calendar profiles --------------------------------------------------------

def unit_sql(unit: str, name: str, digits: int) -> str:
    return f"""
SELECT site, {unit}(day) AS "{name}", ROUND(AVG(rain), {digits}) AS mean, ROUND(STDDEV_SAMP(rain), {digits}) AS std,
       ROUND(QUANTILE_CONT(rain, 0.5), {digits}) AS median, COUNT(rain) AS count FROM panel GROUP BY 1, 2
"""


def unit_profile(spark, sf_dir, unit, name, decimals, digits):
    out = pf.calendar_profile(panel(spark, sf_dir), "rain", unit(F.col("day")), name, keys=["site"], decimals=decimals, **BOUND)
    return rounded(out, digits, "mean", "std", "median")


@query(PANEL + unit_sql("MONTH", "Month", 4))
def monthly_profile(spark, sf_dir):
    return unit_profile(spark, sf_dir, F.month, "Month", 4, 4)


@query(PANEL + unit_sql("DAYOFYEAR", "DayOfYear", 6))
def day_of_year_profile(spark, sf_dir):
    return unit_profile(spark, sf_dir, F.dayofyear, "DayOfYear", None, 6)


@query(PANEL + unit_sql("YEAR", "Year", 6))
def yearly_profile(spark, sf_dir):
    return unit_profile(spark, sf_dir, F.year, "Year", None, 6)


@query("""
SELECT MONTH(l_shipdate) AS "Month", ROUND(AVG(l_extendedprice), 4) AS mean, ROUND(STDDEV_SAMP(l_extendedprice), 4) AS std,
       ROUND(QUANTILE_CONT(l_extendedprice, 0.5), 4) AS median, COUNT(*) AS count FROM lineitem GROUP BY 1
""")
def raw_monthly_profile(spark, sf_dir):
    """Twelve groups over the raw rows: the median takes the distributed route."""
    return pf.calendar_profile(lines(spark, sf_dir), "l_extendedprice", F.month("l_shipdate"), "Month", decimals=4)


@query(PANEL + """
, m AS (SELECT site, MONTH(day) AS mo, AVG(rain) AS mean FROM panel GROUP BY 1, 2),
t AS (SELECT site, QUANTILE_CONT(mean, 0.75) AS hi, QUANTILE_CONT(mean, 0.25) AS lo FROM m GROUP BY site)
SELECT m.site, mo AS "Month", CASE WHEN mean > hi THEN 'wet' ELSE 'dry' END AS season, ROUND(mean, 6) AS mean
FROM m JOIN t ON m.site = t.site WHERE mean > hi OR mean < lo
""")
def wet_dry_months(spark, sf_dir):
    return rounded(pf.wet_dry_months(panel(spark, sf_dir), "rain", "day", keys=["site"]), 6, "mean")


# --- extremes -----------------------------------------------------------------

def extremes_sql(source: str, key: str, x: str) -> str:
    group = f"GROUP BY {key}" if key else ""
    keyed = f"{key}, " if key else ""
    on = f"r.{key} = t.{key}" if key else "TRUE"
    shown = f"t.{key}, " if key else ""
    return f"""
t AS (SELECT {keyed}QUANTILE_CONT({x}, 0.95) AS p95, QUANTILE_CONT({x}, 0.99) AS p99, QUANTILE_CONT({x}, 0.999) AS p99_9 FROM {source} {group}),
c AS (SELECT {shown}p95, p99, p99_9, COUNT(*) FILTER ({x} > p95) AS c95, COUNT(*) FILTER ({x} > p99) AS c99,
      COUNT(*) FILTER ({x} > p99_9) AS c999, COUNT(*) AS n FROM {source} r JOIN t ON {on} GROUP BY ALL)
SELECT {keyed}'p95' AS name, 0.95 AS percentile, ROUND(p95, 6) AS threshold, c95 AS extreme_days, n AS total_days FROM c UNION ALL
SELECT {keyed}'p99', 0.99, ROUND(p99, 6), c99, n FROM c UNION ALL SELECT {keyed}'p99_9', 0.999, ROUND(p99_9, 6), c999, n FROM c
"""


@query(PANEL + "," + extremes_sql("panel", "site", "rain"))
def extreme_thresholds(spark, sf_dir):
    return rounded(pf.extreme_thresholds(panel(spark, sf_dir), "rain", keys=["site"], **BOUND), 6, "threshold")


@query("WITH " + extremes_sql("lineitem", "", "l_extendedprice"))
def raw_extreme_thresholds(spark, sf_dir):
    return rounded(pf.extreme_thresholds(lines(spark, sf_dir), "l_extendedprice"), 6, "threshold")


@query(PANEL + "SELECT site, COUNT(*) FILTER (rain > 50) AS extreme_days FROM panel GROUP BY site")
def count_above_amount(spark, sf_dir):
    return pf.count_extreme_events(panel(spark, sf_dir), "rain", threshold=50.0, keys=["site"])


@query("""
SELECT COUNT(*) AS extreme_days FROM lineitem
WHERE l_extendedprice > (SELECT QUANTILE_CONT(l_extendedprice, 0.9) FROM lineitem)
""")
def count_above_percentile(spark, sf_dir):
    return pf.count_extreme_events(lines(spark, sf_dir), "l_extendedprice", percentile=0.9)


EXTREME_ROWS = PANEL + """
, t AS (SELECT site, QUANTILE_CONT(rain, 0.95) AS threshold FROM panel GROUP BY site),
x AS (SELECT panel.site, day, rain, threshold FROM panel JOIN t ON panel.site = t.site WHERE rain > threshold)
"""


@query(EXTREME_ROWS + "SELECT site, day, rain, ROUND(threshold, 6) AS threshold FROM x")
def extreme_days(spark, sf_dir):
    out = pf.above_percentile(panel(spark, sf_dir).select("site", "day", "rain"), "rain", keys=["site"], **BOUND)
    return rounded(out, 6, "threshold")


@query(EXTREME_ROWS + """
, m AS (SELECT site, MONTH(day) AS mo, COUNT(*) AS n FROM x GROUP BY 1, 2)
SELECT site, mo AS "Month", n AS extreme_days, ROW_NUMBER() OVER (PARTITION BY site ORDER BY n DESC, mo) = 1 AS is_peak FROM m
""")
def extremes_by_month(spark, sf_dir):
    return pf.extremes_by_month(panel(spark, sf_dir), "rain", "day", keys=["site"], **BOUND)


@query(PANEL + """
, r AS (SELECT site, day, rain, ROW_NUMBER() OVER (PARTITION BY site ORDER BY rain DESC NULLS LAST, day) AS rank, COUNT(*) OVER (PARTITION BY site) AS n FROM panel)
SELECT site, day, rain, rank, ROUND(n / rank, 8) AS return_period FROM r WHERE rank <= 100
""")
def return_periods(spark, sf_dir):
    return rounded(pf.return_periods(panel(spark, sf_dir), "rain", 100, ["site"], "day"), 8, "return_period")


@query("""
WITH r AS (SELECT event_id, value, ROW_NUMBER() OVER (ORDER BY value DESC NULLS LAST, event_id) AS rank, COUNT(*) OVER () AS n FROM events)
SELECT event_id, value, rank, ROUND(n / rank, 8) AS return_period FROM r WHERE rank <= 100
""")
def raw_return_periods(spark, sf_dir):
    return rounded(pf.return_periods(table(spark, sf_dir, "events"), "value", 100, tie="event_id"), 8, "return_period")


# --- tables behind charts -----------------------------------------------------

@query(LONG + """
, f AS (SELECT feature, MIN(v) AS lo, MAX(v) AS hi, COUNT(v) AS n FROM long GROUP BY feature),
h AS (SELECT long.feature, lo, (hi - lo) / 50 AS w, n, CAST(LEAST(FLOOR((v - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin
      FROM long JOIN f ON long.feature = f.feature)
SELECT feature, bin, ROUND(lo + bin * w, 6) AS bin_start, COUNT(*) AS days, ROUND(COUNT(*) / (n * w), 8) AS density
FROM h GROUP BY feature, lo, w, n, bin
""")
def histogram(spark, sf_dir):
    out = pf.histogram(long_lines(spark, sf_dir), "v", 50, ["feature"])
    return rounded(rounded(out, 6, "bin_start"), 8, "density")


@query(PANEL + """
, f AS (SELECT site, MIN(rain) AS lo, MAX(rain) AS hi, STDDEV_SAMP(rain) * POW(COUNT(*), -0.2) AS h, COUNT(*) AS n FROM panel GROUP BY site),
g AS (SELECT *, lo + (hi - lo) * point / 199 AS x FROM f CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(0, 199)) AS point)),
v AS (SELECT site, rain, COUNT(*) AS c FROM panel GROUP BY 1, 2)
SELECT g.site, point, ROUND(x, 6) AS "at",
       ROUND(SUM(c * EXP(-0.5 * POW((x - rain) / h, 2)) / (h * SQRT(2 * PI()))) / n, 8) AS density
FROM g JOIN v ON g.site = v.site GROUP BY g.site, point, x, n
""")
def density_grid(spark, sf_dir):
    out = pf.density_grid(panel(spark, sf_dir), "rain", 200, ["site"])
    return rounded(rounded(out, 6, "at"), 8, "density")


@query("""
SELECT l_extendedprice AS value, ROW_NUMBER() OVER (ORDER BY l_extendedprice) AS position,
       ROUND(ROW_NUMBER() OVER (ORDER BY l_extendedprice) / COUNT(*) OVER (), 10) AS cumulative FROM lineitem
""")
def empirical_cdf(spark, sf_dir):
    return rounded(pf.empirical_cdf(lines(spark, sf_dir), "l_extendedprice"), 10, "cumulative")


@query(PANEL + """
, q AS (SELECT site, MONTH(day) AS mo, QUANTILE_CONT(rain, 0.25) AS q1, QUANTILE_CONT(rain, 0.5) AS median, QUANTILE_CONT(rain, 0.75) AS q3
        FROM panel GROUP BY 1, 2),
r AS (SELECT q.*, rain, rain >= q1 - 1.5 * (q3 - q1) AND rain <= q3 + 1.5 * (q3 - q1) AS ok FROM panel JOIN q ON panel.site = q.site AND MONTH(day) = mo)
SELECT site, mo AS "Month", ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3, MIN(rain) FILTER (ok) AS whisker_low,
       MAX(rain) FILTER (ok) AS whisker_high, COUNT(*) FILTER (NOT ok) AS outliers FROM r GROUP BY site, mo, q1, median, q3
""")
def monthly_boxes(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("Month", F.month("day"))
    return rounded(pf.box_numbers(rows, "rain", ["site", "Month"], **BOUND), 6, "q1", "median", "q3")


@query()
def qq_points(spark, sf_dir):
    return pf.qq_points(lines(spark, sf_dir), "l_extendedprice")


MEASURE_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT site || '|{m}' AS feature, {m} AS v FROM panel" for m in MEASURES) + ")"


@query(PANEL + MEASURE_LONG + DESCRIBE + f"""
SELECT CAST(SPLIT_PART(feature, '|', 1) AS INT) AS site, SPLIT_PART(feature, '|', 2) AS "Feature", {DESCRIBE_COLUMNS}
FROM q JOIN c USING (feature) WHERE rn = 1
""")
def panel_description(spark, sf_dir):
    return round_description(pf.descriptive_stats(panel(spark, sf_dir), MEASURES, ["site"], **BOUND))

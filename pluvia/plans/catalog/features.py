"""Column choice, calendar, lag, rolling, sequence and missing-value queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.functions.ordering import series
from pluvia.operators import clean
from pluvia.operators import features as fx
from pluvia.plans.catalog.registry import PANEL, query, rounded
from pluvia.plans.recipes import apply_steps
from pluvia.sources.panel import CALENDAR_DAYS, PREDICTORS, panel, site_series, table

SITE = site_series()
W = "OVER (PARTITION BY site ORDER BY day)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY site ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(PANEL + "SELECT day, rain, wind, temp FROM panel")
def select_features(spark, sf_dir):
    return clean.select_features(
        panel(spark, sf_dir), ["wind", "no such column", "rain", "temp"], target_col="rain", date_col="day"
    )


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def numeric_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(clean.numeric_columns(rows))


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS l_extendedprice_x_l_discount,
       l_extendedprice / (l_discount + 1e-8) AS l_extendedprice_div_l_discount,
       l_extendedprice + l_discount AS l_extendedprice_plus_l_discount,
       l_extendedprice - l_discount AS l_extendedprice_minus_l_discount,
       l_extendedprice, l_discount
FROM lineitem
""")
def interaction_features(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return clean.create_interaction_features(
        rows, [("l_extendedprice", "l_discount"), ("l_extendedprice", "missing")],
        ["multiply", "divide", "add", "subtract", "power"],
    )


@query("""
SELECT o_orderkey, day, YEAR(day) AS "Year", MONTH(day) AS "Month", DAY(day) AS "DayofMonth", DAYOFYEAR(day) AS "DayofYear",
       ROUND(SIN(2 * PI() * MONTH(day) / 12), 9) AS "Month_sin", ROUND(COS(2 * PI() * MONTH(day) / 12), 9) AS "Month_cos",
       ROUND(SIN(2 * PI() * DAYOFYEAR(day) / 365.25), 9) AS "DayOfYear_sin",
       ROUND(COS(2 * PI() * DAYOFYEAR(day) / 365.25), 9) AS "DayOfYear_cos",
       CAST(MONTH(day) BETWEEN 5 AND 11 AS INT) AS "Is_Wet_Season"
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
""")
def temporal_features(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    made = fx.create_temporal_features(rows, "day", [*fx.CALENDAR_FEATURES, "Is_Wet_Season", "Unknown"])
    return rounded(made, 9, "Month_sin", "Month_cos", "DayOfYear_sin", "DayOfYear_cos")


@query("""
SELECT o_orderkey, MONTH(o_orderdate) AS "Month", YEAR(o_orderdate) AS "Year", DAYOFYEAR(o_orderdate) AS "DayOfYear" FROM orders
""")
def calendar_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return fx.add_calendar_columns(rows, "o_orderdate").drop("o_orderdate")


@query("""
SELECT o_orderkey, CASE WHEN MONTH(o_orderdate) IN (12, 1, 2) THEN 'Dry' WHEN MONTH(o_orderdate) IN (3, 4, 5) THEN 'Pre-wet'
       WHEN MONTH(o_orderdate) IN (6, 7, 8) THEN 'Wet' ELSE 'Post-wet' END AS season FROM orders
""")
def season_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fx.season_of(F.col("o_orderdate")).alias("season"))


@query(PANEL + "SELECT site, day, rain, CAST(rain > 0.1 AS INT) AS is_rain FROM panel")
def rain_flag(spark, sf_dir):
    return panel(spark, sf_dir).select("site", "day", "rain", fx.rain_flag(F.col("rain")).alias("is_rain"))


@query(PANEL + "SELECT * FROM panel WHERE temp IS NOT NULL")
def missing_drop(spark, sf_dir):
    return clean.handle_missing_values(panel(spark, sf_dir), "drop")


@query(PANEL + f"""
SELECT site, day, rain, n_obs, {", ".join(
    f"LAST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
    for c in PREDICTORS)} FROM panel
""")
def missing_fill_forward(spark, sf_dir):
    return clean.handle_missing_values(
        panel(spark, sf_dir), "fill_forward", date_col="day", keys=["site"], rows_bound=CALENDAR_DAYS
    )


@query("""
WITH e AS (SELECT event_type, ts, event_id, CASE WHEN value < 20 THEN NULL ELSE value END AS value FROM events)
SELECT event_type, ts, event_id, LAST_VALUE(value IGNORE NULLS) OVER (
  PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM e
""")
def event_fill_forward(spark, sf_dir):
    """Few, large keys; beyond what a task should order the fill runs in blocks of positions."""
    value = F.when(F.col("value") >= 20, F.col("value"))
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", value.alias("value"))
    return clean.fill_forward(rows, series("event_type", "ts", ties="event_id"), ["value"])


@query(PANEL + f"""
SELECT site, day, rain, n_obs, {", ".join(f"ROUND(COALESCE({c}, AVG({c}) OVER ()), 5) AS {c}" for c in PREDICTORS)} FROM panel
""")
def missing_fill_mean(spark, sf_dir):
    filled = clean.fill_mean(panel(spark, sf_dir), PREDICTORS)
    return rounded(filled, 5, *PREDICTORS)


@query(PANEL + "SELECT site, day, rain, n_obs FROM panel")
def missing_drop_columns(spark, sf_dir):
    return clean.handle_missing_values(panel(spark, sf_dir), "drop_columns", threshold=0.8)


@query(PANEL + """
SELECT COUNT(*) AS rows_before, COUNT(temp) AS rows_after, COUNT(*) - COUNT(temp) AS rows_removed,
       4 * (COUNT(*) - COUNT(temp)) AS missing_before, 0 AS missing_after,
       MIN(day) FILTER (temp IS NOT NULL) AS first_day, MAX(day) FILTER (temp IS NOT NULL) AS last_day FROM panel
""")
def missing_summary(spark, sf_dir):
    rows = panel(spark, sf_dir)
    return clean.missing_summary(rows, clean.handle_missing_values(rows, "drop"), "day")


@query(PANEL + f"""
SELECT site, day, rain, temp, {", ".join(
    f"LAG({c}, {k}) {W} AS {c}_lag_{k}" for c in ("rain", "temp") for k in (1, 3, 7))} FROM panel
""")
def lag_features(spark, sf_dir):
    rows = panel(spark, sf_dir).select("site", "day", "rain", "temp")
    return fx.create_lag_features(rows, ["rain", "temp", "nothing"], [1, 3, 7], by=SITE)


@query("""
SELECT event_type, ts, event_id, value, LAG(value, 1) OVER w AS value_lag_1, LAG(value, 24) OVER w AS value_lag_24
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
""")
def event_lags(spark, sf_dir):
    """Few, very large keys: positions are cut into blocks with a halo of 24 rows."""
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    by = series("event_type", "ts", ties="event_id")
    return fx.create_lag_features(rows, "value", [1, 24], by=by)


ROLL_SQL = {"mean": "AVG", "std": "STDDEV_SAMP", "min": "MIN", "max": "MAX", "sum": "SUM"}


def rolling_sql(c: str, stat: str, n: int) -> str:
    return (
        f"ROUND(CASE WHEN COUNT({c}) {frame(n)} = {n} THEN {ROLL_SQL[stat]}({c}) {frame(n)} END, 4) AS {c}_{stat}_{n}d"
    )


@query(PANEL + f"""
SELECT site, day, rain, temp, {", ".join(
    rolling_sql(c, s, n) for c in ("rain", "temp") for n in (7, 30) for s in ROLL_SQL)} FROM panel
""")
def rolling_features(spark, sf_dir):
    rows = panel(spark, sf_dir).select("site", "day", "rain", "temp")
    made = fx.create_rolling_features(rows, ["rain", "temp"], [7, 30], [*fx.FRAME_STATS, "mode"], by=SITE)
    return rounded(made, 4, *[c for c in made.columns if c.endswith("d") and "_" in c])


@query("""
SELECT event_type, ts, event_id,
       ROUND(CASE WHEN COUNT(*) OVER f = 50 THEN AVG(value) OVER f END, 5) AS value_mean_50d,
       CASE WHEN COUNT(*) OVER f = 50 THEN MAX(value) OVER f END AS value_max_50d
FROM events WINDOW f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
""")
def event_rolling(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    by = series("event_type", "ts", ties="event_id")
    made = fx.create_rolling_features(rows, "value", [50], ["mean", "max"], by=by)
    return rounded(made, 5, "value_mean_50d").drop("value")


@query(PANEL + """
, d AS (SELECT site, day, rain - AVG(rain) OVER f AS x, COUNT(*) OVER f AS c FROM panel
  WINDOW f AS (PARTITION BY site ORDER BY day ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING))
SELECT site, day, ROUND(x, 6) AS detrended FROM d WHERE c = 30
""")
def centred_detrend(spark, sf_dir):
    out = fx.detrend_centred(panel(spark, sf_dir).select("site", "day", "rain"), "rain", 30, by=SITE)
    return rounded(out, 6, "detrended").drop("rain")


@query(PANEL + """
SELECT site, day, ROUND(CASE WHEN COUNT(rain) OVER f = 365 THEN AVG(rain) OVER f END, 5) AS rolling_mean,
       ROUND(CASE WHEN COUNT(rain) OVER f = 365 THEN STDDEV_SAMP(rain) OVER f END, 5) AS rolling_std
FROM panel WINDOW f AS (PARTITION BY site ORDER BY day ROWS BETWEEN 364 PRECEDING AND CURRENT ROW)
""")
def rolling_diagnostics(spark, sf_dir):
    out = fx.rolling_diagnostics(
        panel(spark, sf_dir).select("site", "day", "rain"), "rain", fx.diagnostic_window(CALENDAR_DAYS), by=SITE
    )
    return rounded(out, 5, "rolling_mean", "rolling_std").drop("rain")


@query(PANEL + f"SELECT site, day, rain, ROUND(rain - LAG(rain, 1) {W}, 4) AS rain_diff FROM panel")
def first_difference(spark, sf_dir):
    return rounded(fx.first_difference(panel(spark, sf_dir).select("site", "day", "rain"), "rain", by=SITE), 4, "rain_diff")


@query(PANEL + f"""
, s AS (SELECT site, day, rain AS target, {", ".join(f"LAG(rain, {8 - i}) {W} AS r{i}, LAG(n_obs, {8 - i}) {W} AS o{i}" for i in range(1, 8))} FROM panel)
SELECT site, day, target, {", ".join(f"r{i}, CAST(o{i} AS DOUBLE) AS o{i}" for i in range(1, 8))} FROM s WHERE r1 IS NOT NULL
""")
def sequences(spark, sf_dir):
    out = fx.build_sequences(panel(spark, sf_dir), ["rain", "n_obs"], "rain", 7, by=SITE)
    steps = [F.col("steps")[i - 1][j].alias(f"{'ro'[j]}{i}") for i in range(1, 8) for j in (0, 1)]
    return out.select("site", "day", "target", *steps)


@query(PANEL + """
, r AS (SELECT site, day, rain, ROW_NUMBER() OVER (PARTITION BY site ORDER BY day DESC) AS rn FROM panel)
SELECT site, day, rain FROM r WHERE rn <= 1095
""")
def recent_rows(spark, sf_dir):
    return fx.recent_rows(panel(spark, sf_dir).select("site", "day", "rain"), 3 * 365, by=SITE)


@query(PANEL + "SELECT site, day, ROUND(LN(1 + rain), 8) AS transformed FROM panel")
def variance_log1p(spark, sf_dir):
    out = fx.stabilise_variance(panel(spark, sf_dir).select("site", "day", "rain"), "rain")
    return rounded(out, 8, "transformed").drop("rain", "lam")


@query("SELECT l_orderkey, l_linenumber, ROUND((POW(l_extendedprice, 0.25) - 1) / 0.25, 6) AS transformed FROM lineitem")
def variance_box_cox(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = fx.stabilise_variance(rows, "l_extendedprice", 0.25)
    return rounded(out, 6, "transformed").drop("l_extendedprice", "lam")


@query("""
WITH g AS (SELECT CAST(ROUND(-2 + i * 0.01, 10) AS DOUBLE) AS lam FROM (SELECT UNNEST(GENERATE_SERIES(0, 400)) AS i)),
f AS (SELECT l_shipmonth, lam, COUNT(*) AS n, SUM(LN(x)) AS sl,
             VAR_POP(CASE WHEN ABS(lam) < 1e-12 THEN LN(x) ELSE (EXP(lam * LN(x)) - 1) / CASE WHEN ABS(lam) < 1e-12 THEN 1 ELSE lam END END) AS v
      FROM (SELECT MONTH(l_shipdate) AS l_shipmonth, l_extendedprice AS x FROM lineitem), g GROUP BY 1, 2),
s AS (SELECT l_shipmonth, lam, (lam - 1) * sl - n / 2 * LN(v) AS ll FROM f),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_shipmonth ORDER BY ll DESC) AS rn FROM s)
SELECT l_shipmonth, lam FROM r WHERE rn = 1
""")
def variance_auto_lambda(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.month("l_shipdate").alias("l_shipmonth"), "l_extendedprice")
    return fx.box_cox_lambda(rows, "l_extendedprice", ["l_shipmonth"])


STEPS = [
    {"function": "select_features", "params": {
        "features_to_keep": ["site", "temp", "wind"], "target_col": "rain", "date_col": "day"}},
    {"function": "create_temporal_features", "params": {
        "date_col": "day", "features_to_create": ["Month", "Is_Wet_Season"]}},
    {"function": "create_lag_features", "params": {"columns_to_lag": "rain", "lags": [1, 2]}},
    {"function": "create_rolling_features", "params": {
        "columns_to_roll": "rain", "windows": [7], "stats": ["mean", "max"]}},
    {"function": "create_interaction_features", "params": {
        "feature_pairs": [("temp", "wind")], "operations": ["add"]}},
    {"function": "no_such_step", "params": {}},
    {"function": "handle_missing_values", "params": {"strategy": "drop"}},
]


@query(PANEL + f"""
, f AS (SELECT day, rain, site, temp, wind, MONTH(day) AS "Month", CAST(MONTH(day) BETWEEN 5 AND 11 AS INT) AS "Is_Wet_Season",
  LAG(rain, 1) {W} AS rain_lag_1, LAG(rain, 2) {W} AS rain_lag_2,
  {rolling_sql("rain", "mean", 7)}, {rolling_sql("rain", "max", 7)}, ROUND(temp + wind, 5) AS temp_plus_wind FROM panel)
SELECT * FROM f WHERE temp IS NOT NULL AND rain_lag_2 IS NOT NULL AND rain_mean_7d IS NOT NULL
""")
def feature_recipe(spark, sf_dir):
    made = apply_steps(panel(spark, sf_dir), STEPS, by=SITE)
    return rounded(rounded(made, 4, "rain_mean_7d", "rain_max_7d"), 5, "temp_plus_wind")

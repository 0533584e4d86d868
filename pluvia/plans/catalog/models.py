"""Metrics, folds, rain models, search and forecasting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.functions.storage import materialise
from pluvia.operators import evaluation as ev
from pluvia.operators import features as fx
from pluvia.operators import forecasting as fc
from pluvia.operators import linear_search as ls
from pluvia.operators import rain_models as rm
from pluvia.operators import training as tr
from pluvia.plans.catalog.registry import PANEL, query, rounded
from pluvia.sources.panel import CALENDAR_DAYS, panel, site_series

SITE = site_series()

# Scores for the metric queries: a chance of rain and an amount that both come
# from the line count of the day.
SCORES = PANEL + """
, scores AS (SELECT site, day, rain AS y, n_obs / (n_obs + 1.0) AS p_rain, n_obs * 12.5 AS amount FROM panel)
"""


def scores(spark, sf_dir):
    n = F.col("n_obs")
    return panel(spark, sf_dir).select(
        "site", "day", F.col("rain").alias("y"), (n / (n + 1.0)).alias("p_rain"), (n * 12.5).alias("amount")
    )


def metric_sql(y: str, p: str, prefix: str = "", where: str = "TRUE") -> str:
    f = f"FILTER ({where})"
    return (
        f"ROUND(AVG(ABS({y} - {p})) {f}, 7) AS \"{prefix}MAE\", ROUND(SQRT(AVG(POW({y} - {p}, 2)) {f}), 7) AS \"{prefix}RMSE\", "
        f"ROUND(1 - SUM(POW({y} - {p}, 2)) {f} / (VAR_POP({y}) {f} * COUNT({y}) {f}), 8) AS \"{prefix}R2\""
    )


@query(SCORES + f"SELECT site, {metric_sql('y', 'amount')} FROM scores GROUP BY site")
def regression_metrics(spark, sf_dir):
    out = ev.calculate_metrics(scores(spark, sf_dir), "y", "amount", "regression", ["site"])
    return rounded(rounded(out, 7, "MAE", "RMSE"), 8, "R2")


AUC_SQL = """
, rk AS (SELECT site, CAST(y > 0.1 AS INT) AS rain, RANK() OVER (PARTITION BY site ORDER BY p_rain)
   + (COUNT(*) OVER (PARTITION BY site, p_rain) - 1) / 2.0 AS r FROM scores),
au AS (SELECT site, SUM(rain) AS p, COUNT(*) - SUM(rain) AS n, SUM(r) FILTER (rain = 1) AS s FROM rk GROUP BY site),
auc AS (SELECT site, (s - CAST(p AS DOUBLE) * (p + 1) / 2) / (CAST(p AS DOUBLE) * n) AS auc FROM au)
"""


@query(SCORES + AUC_SQL + 'SELECT site, ROUND(auc, 9) AS "ROC_AUC" FROM auc')
def roc_auc(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("rain", fx.rain_flag(F.col("y")))
    return rounded(ev.roc_auc(rows, "rain", "p_rain", ["site"], CALENDAR_DAYS), 9, "ROC_AUC")


@query(SCORES + "SELECT site, day, CASE WHEN p_rain >= 0.5 THEN amount ELSE 0.0 END AS combined FROM scores")
def combined_prediction(spark, sf_dir):
    made = ev.combined_prediction(F.col("p_rain"), F.col("amount"))
    return scores(spark, sf_dir).select("site", "day", made.alias("combined"))


@query(SCORES + AUC_SQL + f"""
, c AS (SELECT *, CASE WHEN p_rain >= 0.5 THEN amount ELSE 0.0 END AS cb FROM scores),
m AS (SELECT site, {metric_sql('y', 'amount', 'rain_', 'y > 0.1')}, {metric_sql('y', 'cb', 'combined_')},
      COUNT(*) FILTER (y > 0.1) AS rain_days, COUNT(*) AS total_rows FROM c GROUP BY site)
SELECT m.*, ROUND(auc, 9) AS "ROC_AUC" FROM m JOIN auc ON m.site = auc.site
""")
def two_stage_evaluation(spark, sf_dir):
    out = ev.evaluate_two_stage(scores(spark, sf_dir), "y", "p_rain", "amount", groups=["site"], rows_bound=CALENDAR_DAYS)
    errors = [f"{a}_{m}" for a in ("rain", "combined") for m in ("MAE", "RMSE")]
    return rounded(rounded(rounded(out, 7, *errors), 8, "rain_R2", "combined_R2"), 9, "ROC_AUC")


@query(SCORES + f"SELECT {metric_sql('y', 'amount')}, COUNT(*) AS total_rows FROM scores")
def single_stage_evaluation(spark, sf_dir):
    out = ev.evaluate_single_stage(scores(spark, sf_dir), "y", "amount")
    return rounded(rounded(out, 7, "MAE", "RMSE"), 8, "R2")


NUMBERED = PANEL + """
, c AS (SELECT site, day, rain, temp, wind, ROW_NUMBER() OVER (ORDER BY day, site) - 1 AS pos, COUNT(*) OVER () AS n FROM panel
        WHERE temp IS NOT NULL AND wind IS NOT NULL)
"""


def split(spark, sf_dir):
    return ev.prepare_data(panel(spark, sf_dir), "rain", ["temp", "wind"], "day", ["site"], 0.2)


@query(NUMBERED + "SELECT site, day, rain, temp, wind, CASE WHEN pos < CAST(FLOOR(n * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM c")
def hold_out_split(spark, sf_dir):
    train, test = split(spark, sf_dir)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.drop("_pos")


FOLDS = PANEL + """
, c AS (SELECT site, day, ROW_NUMBER() OVER (ORDER BY day, site) - 1 AS pos, COUNT(*) OVER () AS n FROM panel),
f AS (SELECT DISTINCT CAST(i AS INT) AS fold, n - (5 - i) * (n // 6) AS train_end, n - (4 - i) * (n // 6) AS test_end
      FROM (SELECT n FROM c LIMIT 1) CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(0, 4)) AS i))
"""


@query(FOLDS + "SELECT fold, train_end, test_end FROM f")
def fold_table(spark, sf_dir):
    return ev.fold_table(panel(spark, sf_dir), 5)


@query(FOLDS + "SELECT site, day, fold, CASE WHEN pos < train_end THEN 'train' ELSE 'test' END AS role FROM c JOIN f ON pos < test_end")
def fold_assignment(spark, sf_dir):
    rows = ev.numbered_rows(panel(spark, sf_dir).select("site", "day"), "day", ["site"])
    return ev.assign_folds(rows, ev.fold_bounds(rows.count(), 5)).drop("_pos")


# --- fitted models (iterative, so checked by tests and not by SQL) -------------

FEATURES = ["month", "rain_lag_1", "rain_lag_7", "rain_mean_7d"]


def training_rows(spark, sf_dir):
    """Lag and calendar features of every site, written once for all fits."""
    rows = panel(spark, sf_dir).select("site", "day", "rain").withColumn("month", F.month("day"))
    rows = fx.create_lag_features(rows, "rain", [1, 7], by=SITE)
    rows = fx.create_rolling_features(rows, "rain", [7], ["mean"], by=SITE)
    return ev.prepare_data(rows, "rain", FEATURES, "day", ["site"])


# Plain least squares on two features, solved in SQL from the training rows' covariances.
LEAST_SQUARES = PANEL + """
, f AS (SELECT site, day, rain AS y, CAST(MONTH(day) AS DOUBLE) AS a, LAG(rain, 1) OVER (PARTITION BY site ORDER BY day) AS b FROM panel),
c AS (SELECT *, ROW_NUMBER() OVER (ORDER BY day, site) - 1 AS pos, COUNT(*) OVER () AS n FROM f WHERE b IS NOT NULL),
s AS (SELECT VAR_POP(a) AS aa, VAR_POP(b) AS bb, COVAR_POP(a, b) AS ab, COVAR_POP(a, y) AS ay, COVAR_POP(b, y) AS by_, AVG(a) AS ma, AVG(b) AS mb, AVG(y) AS my
      FROM c WHERE pos < CAST(FLOOR(n * 0.8) AS BIGINT)),
w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb, aa, bb, ma, mb, my FROM s),
p AS (SELECT site, day, y, my + wa * (a - ma) + wb * (b - mb) AS amount FROM c CROSS JOIN w WHERE pos >= CAST(FLOOR(n * 0.8) AS BIGINT))
"""


def least_squares(spark, sf_dir):
    rows = panel(spark, sf_dir).select("site", "day", "rain").withColumn("month", F.month("day"))
    rows = fx.create_lag_features(rows, "rain", [1], by=SITE)
    features = ["month", "rain_lag_1"]
    train, test = ev.prepare_data(rows, "rain", features, "day", ["site"])
    model = rm.RainModel("linear", features, "rain", two_stage=False, params={"regression_type": "linear"})
    return model.fit(train), test


@query(LEAST_SQUARES + f"SELECT {metric_sql('y', 'amount')}, COUNT(*) AS total_rows FROM p")
def least_squares_evaluation(spark, sf_dir):
    fitted, test = least_squares(spark, sf_dir)
    return rounded(rounded(fitted.evaluate(test), 7, "MAE", "RMSE"), 8, "R2")


@query(LEAST_SQUARES + "SELECT site, day, ROUND(amount, 6) AS amount FROM p")
def least_squares_predictions(spark, sf_dir):
    fitted, test = least_squares(spark, sf_dir)
    return rounded(fitted.predict(test).select("site", "day", "amount"), 6, "amount")


@query(LEAST_SQUARES + """
, k AS (SELECT COUNT(*) AS n FROM c WHERE pos < CAST(FLOOR(n * 0.8) AS BIGINT))
SELECT 'single_stage' AS stage, 'month' AS feature, ROUND(wa * SQRT(aa * k.n / (k.n - 1)), 6) AS coefficient FROM w CROSS JOIN k UNION ALL
SELECT 'single_stage', 'rain_lag_1', ROUND(wb * SQRT(bb * k.n / (k.n - 1)), 6) FROM w CROSS JOIN k UNION ALL
SELECT 'single_stage', 'intercept', ROUND(my, 6) FROM w
""")
def least_squares_coefficients(spark, sf_dir):
    """Per standard deviation of the feature, as the inputs are scaled."""
    fitted, _ = least_squares(spark, sf_dir)
    return rounded(fitted.coefficients(spark), 6, "coefficient")


@query()
def linear_two_stage(spark, sf_dir):
    train, test = training_rows(spark, sf_dir)
    return rm.RainModel("linear", FEATURES, "rain").fit(train).evaluate(test)


@query()
def linear_coefficients(spark, sf_dir):
    train, _ = training_rows(spark, sf_dir)
    return rm.RainModel("linear", FEATURES, "rain", params={"regression_type": "lasso"}).fit(train).coefficients(spark)


@query()
def two_stage_predictions(spark, sf_dir):
    train, test = training_rows(spark, sf_dir)
    return rm.RainModel("linear", FEATURES, "rain").fit(train).predict(test).drop("_pos")


@query()
def forest_importance(spark, sf_dir):
    train, _ = training_rows(spark, sf_dir)
    model = rm.RainModel("random_forest", FEATURES, "rain", params={"n_estimators": 10, "max_depth": 6})
    return model.fit(train).feature_importance(spark)


@query()
def boosting_comparison(spark, sf_dir):
    """Both boosting presets, two-stage and single-stage, in one table."""
    train, test = training_rows(spark, sf_dir)
    small = {"n_estimators": 5, "max_depth": 3}
    fitted = [
        rm.RainModel(family, FEATURES, "rain", two_stage=two, params=small).fit(train)
        for family in ("xgboost", "lightgbm") for two in (True, False)
    ]
    return rm.compare_approaches(fitted, test)


@query()
def cross_validation(spark, sf_dir):
    train, _ = training_rows(spark, sf_dir)
    return tr.cross_validate(rm.RainModel("linear", FEATURES, "rain"), train, 5)


@query()
def model_search(spark, sf_dir):
    """A seeded search of 100 trials, refit and hold-out evaluation of two models."""
    rows = panel(spark, sf_dir).select("site", "day", "rain").withColumn("month", F.month("day"))
    rows = fx.create_lag_features(rows, "rain", [1, 7], by=SITE)
    features = FEATURES[:3]
    results = tr.train_models(
        rows, "rain", {
            "ridge": rm.RainModel("linear", features, "rain"),
            "single": rm.RainModel("linear", features, "rain", two_stage=False),
        }, features, "day", ("site",),
        spaces={
            "ridge": {
                "classification": {"C": {"type": "loguniform", "low": 0.1, "high": 10.0}},
                "regression": {"alpha": {"type": "float", "low": 0.1, "high": 5.0}},
            },
            "single": {"single_stage": {
                "regression_type": {"type": "categorical", "choices": ["ridge", "lasso"]},
                "alpha": {"type": "loguniform", "low": 0.01, "high": 100.0},
            }},
        }, n_trials=100, cv_splits=3,
    )
    return tr.results_table(spark, results)


#: Penalties of the ridge search: from 0.01 to a million in equal ratios.
ALPHAS = [10 ** (-2 + 8 * i / 99) for i in range(100)]

# Two features, three folds: the normal equations of every fold and penalty on features of unit variance.
RIDGE_SEARCH = PANEL + f"""
, f AS (SELECT site, day, rain AS y, CAST(MONTH(day) AS DOUBLE) AS a, LAG(rain, 1) OVER (PARTITION BY site ORDER BY day) AS b FROM panel),
c AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (ORDER BY day, site) - 1 AS pos, COUNT(*) OVER () AS n FROM f WHERE b IS NOT NULL),
t AS MATERIALIZED (SELECT *, CAST(FLOOR(n * 0.8) AS BIGINT) AS cut FROM c WHERE pos < CAST(FLOOR(n * 0.8) AS BIGINT)),
o AS (SELECT CAST(i AS INT) AS fold, cut - (3 - i) * (cut // 4) AS train_end, cut - (2 - i) * (cut // 4) AS test_end
      FROM (SELECT cut FROM t LIMIT 1) CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(0, 2)) AS i)),
s AS (SELECT fold, train_end, test_end, COUNT(*) AS k, STDDEV_POP(a) AS sa, STDDEV_POP(b) AS sb, AVG(a) AS ma, AVG(b) AS mb, AVG(y) AS my,
        COVAR_POP(a, b) / (STDDEV_POP(a) * STDDEV_POP(b)) * COUNT(*) AS ab, COVAR_POP(a, y) / STDDEV_POP(a) * COUNT(*) AS ay,
        COVAR_POP(b, y) / STDDEV_POP(b) * COUNT(*) AS by_ FROM t JOIN o ON pos < train_end GROUP BY 1, 2, 3),
l AS (SELECT * FROM (VALUES {", ".join(f"({i}, {a!r}::DOUBLE)" for i, a in enumerate(ALPHAS))}) v(trial, alpha)),
w AS (SELECT s.*, trial, alpha, (ay * (k + alpha) - by_ * ab) / ((k + alpha) * (k + alpha) - ab * ab) AS wa,
        (by_ * (k + alpha) - ay * ab) / ((k + alpha) * (k + alpha) - ab * ab) AS wb FROM s CROSS JOIN l),
e AS (SELECT fold, trial, alpha, AVG(ABS(r)) AS mae, SQRT(AVG(r * r)) AS rmse, 1 - SUM(r * r) / (VAR_POP(y) * COUNT(*)) AS r2
      FROM (SELECT fold, trial, alpha, t.y, t.y - my - wa * (a - ma) / sa - wb * (b - mb) / sb AS r FROM w JOIN t ON pos >= train_end AND pos < test_end)
      GROUP BY 1, 2, 3)
SELECT CAST(trial AS INT) AS trial, 'ridge' AS regression_type, ROUND(alpha, 8) AS alpha, ROUND(AVG(mae), 6) AS "MAE", ROUND(AVG(rmse), 6) AS "RMSE", ROUND(AVG(r2), 8) AS "R2"
FROM e GROUP BY trial, alpha
"""


@query(RIDGE_SEARCH)
def ridge_search(spark, sf_dir):
    """A hundred ridge penalties over three expanding folds of the training rows, from one table of cross products."""
    rows = panel(spark, sf_dir).select("site", "day", "rain").withColumn("month", F.month("day"))
    rows = fx.create_lag_features(rows, "rain", [1], by=SITE)
    train, _ = ev.prepare_data(rows, "rain", ["month", "rain_lag_1"], "day", ["site"])
    out = ls.search_table(train, ["month", "rain_lag_1"], "rain", [{"alpha": a} for a in ALPHAS], 3)
    return rounded(rounded(out, 6, "MAE", "RMSE"), 8, "alpha", "R2")


# --- forecasting --------------------------------------------------------------

LAST_TRAIN = "2001-09-30"


def forecast_rows(spark, sf_dir):
    rows = materialise(panel(spark, sf_dir).select("site", "day", "rain", F.col("n_obs").cast("double").alias("n_obs")))
    train = rows.filter(F.col("day") <= F.lit(LAST_TRAIN).cast("date"))
    later = rows.filter(F.col("day") > F.lit(LAST_TRAIN).cast("date")).withColumn(
        "step", F.datediff("day", F.lit(LAST_TRAIN).cast("date"))
    )
    return train, later


@query(PANEL + f"""
, t AS (SELECT site, day, rain AS y, LAG(rain) OVER (PARTITION BY site ORDER BY day) AS x FROM panel WHERE day <= DATE '{LAST_TRAIN}'),
w AS (SELECT site, SUM(x * y) / SUM(x * x) AS phi, ARG_MAX(y, day) AS last FROM t WHERE x IS NOT NULL GROUP BY site)
SELECT site, CAST(k AS INT) AS step, ROUND(POW(phi, k) * last, 6) AS forecast
FROM w CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(1, 92)) AS k)
""")
def ar1_forecast(spark, sf_dir):
    """First-order forecasts of the whole hold-out, which follow in closed form from a regression on the day before (no constant)."""
    train, _ = forecast_rows(spark, sf_dir)
    out = fc.ar_model("rain", (1, 0, 0)).fit(train, by=SITE).forecast(92)
    return rounded(out.select("site", "step", "forecast"), 6, "forecast")


@query()
def ar_forecast(spark, sf_dir):
    train, _ = forecast_rows(spark, sf_dir)
    return fc.ar_model("rain", (3, 0, 3)).fit(train, by=SITE).forecast(30)


@query()
def seasonal_ar_forecast(spark, sf_dir):
    train, _ = forecast_rows(spark, sf_dir)
    return fc.seasonal_ar_model("rain", (3, 0, 3), (1, 1, 1, 7)).fit(train, by=SITE).forecast(30)


@query()
def arx_evaluation(spark, sf_dir):
    train, later = forecast_rows(spark, sf_dir)
    fitted = fc.seasonal_ar_model("rain", (2, 0, 1), (1, 0, 0, 7), ("n_obs",)).fit(train, by=SITE)
    return fitted.evaluate(later.select("site", "step", "rain"), later.select("site", "step", "n_obs"))

"""Whole-module runs: every table of one analysis, as a dict of DataFrames.

Tables are lazy where their operators are; a caller evaluates what it needs.
Single-site input gets a constant series key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia import constants as C
from pluvia.functions.ordering import Series
from pluvia.functions.storage import materialise
from pluvia.operators import autocorrelation as ac
from pluvia.operators import clean
from pluvia.operators import correlation as co
from pluvia.operators import decomposition as dc
from pluvia.operators import profile as pf
from pluvia.operators import spectrum as sp
from pluvia.operators import stat_tests as st
from pluvia.operators import stationarity as sy

DEFAULT_PERIODS = [7, 30, 365]


#: Columns that name a row of a report's table, beside its keys and its texts and dates.
ROW_NAMES = {"Month", "Year", "DayOfYear", "rank", "lag", "k", "period_days", "scale", "bin", "component", "return_rank"}


def long_report(tables: dict[str, DataFrame], keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """(table, key, metric, value, label): all tables of a run below each other.

    ``key`` joins what names a row: the keys, its dates and texts, and the columns of ``ROW_NAMES``.  The other columns are
    metrics: numbers and flags as values, anything else as a JSON label; a row without any other column has the metric
    ``row``, so that none is lost."""
    out = None
    for name, df in tables.items():
        ids = [f.name for f in df.schema if f.name in keys or f.name in ROW_NAMES or isinstance(f.dataType, (T.StringType, T.DateType))]
        cells = []
        for f in df.schema:
            if f.name in ids:
                continue
            number = isinstance(f.dataType, (T.NumericType, T.BooleanType))
            value = F.round(F.col(f"`{f.name}`").cast("double"), digits) if number else F.lit(None).cast("double")
            label = F.lit(None).cast("string") if number else F.to_json(F.struct(F.col(f"`{f.name}`")))
            cells.append(F.struct(F.lit(f.name).alias("metric"), value.alias("value"), label.alias("label")))
        cells = cells or [F.struct(F.lit("row").alias("metric"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("label"))]
        key = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ids])
        rows = df.select(F.lit(name).alias("table"), key.alias("key"), F.inline(F.array(*cells)))
        out = rows if out is None else out.unionByName(rows)
    return out


def analyze_distributions(df: DataFrame, target: str = C.TARGET_LABEL, columns: list[str] | None = None) -> dict[str, DataFrame]:
    columns = columns or clean.distribution_columns(df)
    tests = st.normality_battery(df, columns)
    ranks = st.non_parametric_tests(df, target, columns)
    bands = pf.rain_band_counts(df, target)
    return {
        "descriptive_stats": pf.descriptive_stats(df, columns),
        "target_analysis": pf.target_profile(df, target),
        "intensity_distribution": bands,
        "normality_tests": tests,
        "non_parametric_tests": ranks,
        "shape_comparison": pf.shape_comparison(df, columns, target),
        "summary_insights": distribution_insights(bands, tests, ranks),
    }


def distribution_insights(bands: DataFrame, normality: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row: rain shares, features that look normal, significant rank tests.

    The three inputs have a few rows each; they meet in a union and one aggregate."""
    days = F.sum("days")

    def share(*names: str):
        hit = F.sum(F.when(F.col("band").isin(*names), F.col("days")).otherwise(0))
        return F.try_divide(hit * 100.0, days)

    a = bands.agg(
        share("no_rain").alias("zero_rain_pct"), share("light_rain", "moderate_rain").alias("light_moderate_pct"),
        share("heavy_rain", "very_heavy_rain").alias("heavy_pct"),
    )
    normal = (F.col("Shapiro_Normal") == "Yes") & (F.col("JB_Normal") == "Yes")
    b = normality.agg(F.count_if(normal).alias("normal_features"), F.count(F.lit(1)).alias("tested_features"))
    c = ranks.agg(*[
        F.count_if(F.col(f"{t}_Significant") == "Yes").alias(f"significant_{n}")
        for t, n in (("MW", "rain_difference"), ("KW", "group_difference"), ("Spearman", "rank_correlation"))
    ])
    parts = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return parts.agg(*[F.max(n).alias(n) for n in parts.columns])


def analyze_correlations(
    df: DataFrame, target: str = C.TARGET_LABEL, date_col: str = C.DATE_LABEL, columns: list[str] | None = None,
    terms=None, rolling_window: int = 30,
) -> dict[str, DataFrame]:
    columns = columns or clean.correlation_columns(df, date_col)
    predictors = [c for c in columns if c != target]
    daily = materialise(co.daily_means(df, columns, date_col).withColumn("_site", F.lit(0)))
    days = daily.count()
    by = Series(("_site",), date_col, rows_bound=days)
    out = {
        "pearson": co.pearson_matrix(df, columns),
        "spearman": co.spearman_matrix(df, columns),
        "nonlinearity": co.nonlinearity_matrix(df, columns),
        "feature_groups": co.feature_groups(df.sparkSession, columns, target, terms),
        "target_ranking": co.rank_predictors(df, target, columns),
        "seasonal_correlations": co.seasonal_correlations(df, target, columns, date_col),
        "network_nodes": co.network_nodes(df.sparkSession, columns, target, terms),
        "network_edges": co.network_edges(df, columns),
    }
    if days >= 60:
        top = [r["feature"] for r in co.top_variables(daily, target, columns).collect()]
        lagged = co.lagged_correlations(daily, target, top, by=by)
        out["rolling_correlations"] = co.rolling_correlation_summary(daily, target, top, rolling_window, by=by).drop("_site")
        out["lagged_correlations"] = co.best_lag(lagged, ["_site"]).drop("_site")
    vif = co.vif_table(df, predictors, target, terms)
    out |= {
        "multicollinearity": vif, "vif_by_category": co.vif_by_category(vif), "vif_by_risk": co.vif_by_risk(vif),
        "vif_summary": co.vif_summary(vif), "pca": co.pca_against_target(df, predictors, target),
        "feature_clusters": co.feature_clusters(df, predictors),
        "network_metrics": co.network_metrics(out["network_edges"], columns),
        "node_metrics": co.node_metrics(out["network_edges"], columns),
    }
    return out


def analyze_extreme_events(
    df: DataFrame, target: str = C.TARGET_LABEL, date_col: str = C.DATE_LABEL, keys: Sequence[str] = (),
    rows_bound: int | None = None,
) -> dict[str, DataFrame]:
    return {
        "thresholds": pf.extreme_thresholds(df, target, keys=keys, rows_bound=rows_bound),
        "extreme_days": pf.above_percentile(df, target, keys=keys, rows_bound=rows_bound),
        "extremes_by_month": pf.extremes_by_month(df, target, date_col, keys=keys, rows_bound=rows_bound),
        "return_periods": pf.return_periods(df, target, keys=keys, tie=date_col),
    }


def analyze_temporal_structure(
    df: DataFrame, target: str = C.TARGET_LABEL, *, by: Series, periods: Sequence[int] | None = None
) -> dict[str, DataFrame]:
    """Calendar profiles, spectrum, decomposition and wavelets.

    Without given periods the three longest dominant ones of the first series
    (or 7, 30 and 365) feed the decomposition of all series."""
    rows = materialise(df.select(*by.keys, by.order, *by.ties, target))
    out = pf.seasonal_patterns(rows, target, by.order, keys=by.keys, rows_bound=by.rows_bound)
    spectrum = materialise(sp.detrended_spectrum(rows, target, by=by))
    dominant = sp.dominant_periods(spectrum, keys=by.keys)
    if periods is None:
        top = dominant.groupBy("period_days").agg(F.count(F.lit(1)).alias("n")).orderBy(
            F.desc("n"), F.desc("period_days")
        ).limit(3).collect()
        periods = [r["period_days"] for r in top] or DEFAULT_PERIODS
    power = sp.power_table(spectrum)
    wavelet = sp.wavelet_power(rows, target, by=by)
    spectrum_w = sp.global_wavelet_spectrum(wavelet, by.keys)
    return out | {
        "spectrum": spectrum, "dominant_periods": dominant, "power": power,
        "decomposition": dc.decompose(rows, target, periods, by=by),
        "wavelet_power": wavelet, "wavelet_spectrum": spectrum_w,
        "wavelet_periods": sp.dominant_wavelet_periods(spectrum_w, keys=by.keys),
    }


def analyze_stationarity_autocorrelation(
    df: DataFrame, target: str = C.TARGET_LABEL, *, by: Series, periods: Sequence[int] = (),
    residual: DataFrame | None = None, min_rows: int = 50,
) -> dict[str, DataFrame]:
    """Unit-root tests, ACF and PACF up to the lag budget, order suggestions,
    residual diagnosis when a residual is given, and the synthesis."""
    keys = list(by.keys)
    present = df.select(*keys, by.order, *by.ties, target).filter(F.col(target).isNotNull())
    rows = materialise(pf.with_series_facts(present, by, {"_n": F.count(F.lit(1))}).filter(F.col("_n") >= min_rows).drop("_n"))
    budget = ac.lag_budget(periods)["max_lags"]
    tests = sy.stationarity_tests(rows, target, "ct", by=by)
    acf_table = materialise(ac.acf(rows, target, budget, by=by))
    pacf_table = materialise(ac.pacf(rows, target, budget, by=by))
    orders = ac.suggest_orders(acf_table, pacf_table, periods, keys)
    out = {
        "stationarity": tests, "acf": acf_table, "pacf": pacf_table,
        "validated_lags": ac.lags_near_periods(acf_table, periods), "orders": orders,
    }
    quality = None
    if residual is not None:
        kept = materialise(residual.select(*keys, by.order, "resid"))
        quality = sy.decomposition_quality(sy.residual_diagnosis(kept, "resid", by=by))
        out["residual_diagnosis"] = quality
    out["synthesis"] = sy.synthesis(tests, acf_table, orders, keys, periods, quality)
    return out

"""Whole-module runs as queries: every table of a module in one long result, from one materialised panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.functions.storage import materialise
from pluvia.plans import reports
from pluvia.plans.catalog import profiles  # noqa: F401  (its SQL is reused)
from pluvia.plans.catalog.registry import ORACLES, query
from pluvia.sources.panel import CALENDAR_DAYS, panel, site_series

SITE = site_series()
COLUMNS = ["rain", "temp", "n_obs"]


def rolled_up(spark, sf_dir, *columns):
    """The panel's columns, written once for all tables of a run."""
    return materialise(panel(spark, sf_dir).select(*columns))


def long_sql(parts: dict[str, tuple[str, list[str], list[str]]], digits: int) -> str:
    """The long form of several SQL tables: name -> (query, key columns in their order, metrics)."""
    rows = []
    for name, (sql, ids, metrics) in parts.items():
        key = " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), '')" for c in ids)
        rows += [f"SELECT '{name}' AS \"table\", {key} AS key, '{m}' AS metric, ROUND(CAST({m} AS DOUBLE), {digits}) AS value, "
                 f"CAST(NULL AS VARCHAR) AS label FROM ({sql})" for m in metrics]
    return "\nUNION ALL ".join(rows)


@query(long_sql({
    "thresholds": (ORACLES["extreme_thresholds"], ["site", "name"], ["percentile", "threshold", "extreme_days", "total_days"]),
    "extreme_days": (ORACLES["extreme_days"], ["site", "day"], ["rain", "threshold"]),
    "extremes_by_month": (ORACLES["extremes_by_month"], ["site", '"Month"'], ["extreme_days", "is_peak"]),
    "return_periods": (ORACLES["return_periods"], ["site", "day", "rank"], ["rain", "return_period"]),
}, 4))
def extreme_report(spark, sf_dir):
    rows = rolled_up(spark, sf_dir, "site", "day", "rain")
    tables = reports.analyze_extreme_events(rows, "rain", "day", ["site"], CALENDAR_DAYS)
    return reports.long_report(tables, ["site"], 4)


@query()
def distribution_report(spark, sf_dir):
    rows = rolled_up(spark, sf_dir, "rain", "temp", F.col("n_obs").cast("double").alias("n_obs"))
    return reports.long_report(reports.analyze_distributions(rows, "rain", COLUMNS))


@query()
def correlation_report(spark, sf_dir):
    columns = ["rain", "temp", "humidity", "pressure", "wind"]
    rows = rolled_up(spark, sf_dir, "day", *columns)
    return reports.long_report(reports.analyze_correlations(rows, "rain", "day", columns))


@query()
def temporal_report(spark, sf_dir):
    """All tables but the decomposition and the wavelet coefficients, which have queries of their own."""
    made = reports.analyze_temporal_structure(rolled_up(spark, sf_dir, "site", "day", "rain"), "rain", by=SITE, periods=[7, 30])
    return reports.long_report({k: v for k, v in made.items() if k not in ("decomposition", "wavelet_power")}, ["site"])


@query()
def stationarity_report(spark, sf_dir):
    rows = rolled_up(spark, sf_dir, "site", "day", "rain")
    return reports.long_report(reports.analyze_stationarity_autocorrelation(rows, "rain", by=SITE, periods=[7, 30]), ["site"])

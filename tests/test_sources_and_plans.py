"""Sources, sinks, cleaning rules, recipes, reports, the stream and the driver contract."""

import datetime as dt
import json
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia import constants as C
from pluvia.functions.ordering import series
from pluvia.operators import clean, quality
from pluvia.operators import features as fx
from pluvia.operators import profile as pf
from pluvia.plans import reports
from pluvia.plans.catalog import ORACLES, QUERIES
from pluvia.plans.recipes import apply_steps
from pluvia.sources import payload, weather
from pluvia.sources.panel import CALENDAR_DAYS, panel
from pluvia.streaming import landing
from tests.oracle_check import compare, duck


def scratch():
    return tempfile.mkdtemp(prefix="run-")


def test_csv_scan_sink_and_pruned_read(spark):
    folder = scratch()
    with open(f"{folder}/a.csv", "w", encoding="utf-8") as f:
        f.write("DATE,T2M,PRECTOTCORR,LATITUDE,LONGITUDE\n")
        f.write("2019-12-31,20.5,1.5,10.78,106.7\n2020-01-01,-999,0.0,10.78,106.7\nnonsense,1,2,3,4\n2021-03-05,22.0,-999.0,10.78,106.7\n")
    rows = weather.read_weather_csv(spark, folder, "20200101", "20211231")
    assert {"Ngày", "Lượng mưa", "Nhiệt độ 2m"} <= set(rows.columns) and rows.count() == 2
    got = {r["Ngày"]: r for r in rows.collect()}
    assert got[dt.date(2020, 1, 1)]["Nhiệt độ 2m"] is None and got[dt.date(2021, 3, 5)]["Lượng mưa"] is None
    coded = weather.read_weather_csv(spark, folder, rename_columns=False)
    out = scratch() + "/daily"
    weather.write_daily(coded.select("DATE", "T2M"), out, "DATE")
    back = weather.read_daily(spark, out, "DATE", "20200101", "20201231")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().executedPlan().toString()
    text = scratch() + "/text"
    weather.write_daily(coded.select("DATE", "T2M"), text, "DATE", fmt="csv")
    assert weather.read_weather_csv(spark, text).count() == 4  # also the row whose date is unreadable
    assert coded.filter("DATE IS NULL").count() == 1
    raw = spark.read.option("header", True).csv(folder)
    assert [r["DATE"] for r in weather.unreadable_dates(raw).collect()] == ["nonsense"]


def test_payload_cases(spark):
    good = {"messages": [], "properties": {"parameter": {"T2M": {"20000101": 25.1, "20000102": 26.0}, "PS": {"20000101": 100.5}}}}
    cases = [good, {"messages": ["bad"], "properties": {"parameter": {}}}, {"properties": {"parameter": {}}}]
    rows = payload.parse_payloads(spark.createDataFrame([(json.dumps(c),) for c in cases], "body string"), "body")
    ok, bad = payload.split_payloads(rows)
    flat = {r["DATE"]: r for r in payload.flatten_payloads(ok).collect()}
    assert len(flat) == 2 and flat[dt.date(2000, 1, 2)]["PS"] is None and flat[dt.date(2000, 1, 1)]["T2M"] == 25.1
    assert sorted(r["problem"] for r in bad.collect()) == ["api_error", "no_data"]


def test_stream_of_landed_payloads(spark):
    folder, out = scratch(), scratch()
    with open(f"{folder}/one.json", "w") as f:
        json.dump({"messages": [], "properties": {"parameter": {"T2M": {"20000101": 25.1, "20000102": -999.0}}}}, f)
    stream = landing.stream_payloads(spark, folder, ["T2M"])
    landing.append_daily(stream, out + "/rows", out + "/state").awaitTermination(120)
    rows = {r["DATE"]: r["T2M"] for r in spark.read.parquet(out + "/rows").collect()}
    assert rows == {dt.date(2000, 1, 1): 25.1, dt.date(2000, 1, 2): None}


def test_bands_cover_edges(spark):
    values = [0.0, 0.6, 0.61, 6.0, 16.0, 50.0, 100.0, 100.1, -1.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    days = {r["band"]: r["days"] for r in pf.rain_band_counts(df, "x").collect()}
    assert days == {"no_rain": 1, "trace_rain": 1, "light_rain": 2, "moderate_rain": 1, "heavy_rain": 1,
                    "very_heavy_rain": 1, "extremely_heavy_rain": 1}


def test_interaction_division_guards_zero(spark):
    df = spark.createDataFrame([(1.0, -1e-8), (1.0, 0.0)], "a double, b double")
    got = [r[0] for r in clean.create_interaction_features(df, [("a", "b")], ["divide"]).select("a_div_b").collect()]
    assert got[0] is None and got[1] == pytest.approx(1e8)


def test_quality_of_small_tables(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, None)], "a int, t double")
    assert quality.quality_score(df, "t").first()["overall_score"] == 100 - 30 - 20 - 15
    assert quality.quality_score(df, "nope").first()["overall_score"] == 0
    empty = df.limit(0)
    assert quality.missing_overall(empty).first()["total_missing"] == 0
    assert quality.duplicate_rows(empty).first()["duplicate_rows"] == 0


def test_missing_strategies(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 3.0, 4.0)], "d int, a double, b double")
    assert clean.handle_missing_values(df, "drop").count() == 1
    assert clean.handle_missing_values(df, "drop_columns", 0.6).columns == ["d", "a"]
    assert clean.handle_missing_values(df, "unknown").collect() == df.collect()
    filled = clean.handle_missing_values(df, "fill_mean").orderBy("d").collect()
    assert filled[1]["a"] == 2.0 and filled[0]["b"] == 4.0
    forward = clean.handle_missing_values(df, "fill_forward", date_col="d").orderBy("d").collect()
    assert forward[1]["a"] == 1.0 and forward[0]["b"] is None


def test_box_cox_lambda_is_the_best_of_the_grid(spark):
    x = np.random.default_rng(0).lognormal(size=500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert abs(fx.box_cox_lambda(df, "x").first()["lam"]) < 0.1


def test_box_cox_points_are_worked_out_once_for_each_key(spark, monkeypatch):
    """Rounding a point of the grid costs more than the power of a row: rows meet points that are ready."""
    from pluvia.operators import features

    x = np.random.default_rng(1).lognormal(size=400)
    df = spark.createDataFrame([(i % 2, float(v) ** (1 + 2 * (i % 2)) * 50) for i, v in enumerate(x)], "k int, x double")
    sums, keep = [], features.materialise

    def materialise(rows):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        sums.extend(line for line in plan.splitlines() if "var_pop(" in line)
        return keep(rows)

    monkeypatch.setattr(features, "materialise", materialise)
    got = {r.k: r.lam for r in fx.box_cox_lambda(df, "x", ["k"]).collect()}
    assert sums and not any("round(" in line for line in sums)
    for k in (0, 1):
        log = np.log(x[k::2] ** (1 + 2 * k) * 50)

        def likelihood(lam, log=log):
            y = log if abs(lam) < 1e-12 else np.expm1(lam * log) / lam
            return (lam - 1) * log.sum() - len(log) / 2 * np.log(y.var())

        assert got[k] == max((round(-2 + i * 0.01, 10) for i in range(401)), key=likelihood)


def test_recipe_skips_unknown_steps(panel_rows):
    by = series("site", "day", rows_bound=1000)
    steps = [{"function": "nope"}, {"function": "create_lag_features", "params": {"columns_to_lag": "x", "lags": [1]}}]
    assert "x_lag_1" in apply_steps(panel_rows, steps, by=by).columns


def test_reports_build_every_table(spark):
    rows = panel(spark, "/root/testdata/sf0.001")
    columns = ["rain", "temp", "wind", "n_obs"]
    for made in (
        reports.analyze_distributions(rows, "rain", columns),
        reports.analyze_correlations(rows.select("day", *columns), "rain", "day", columns),
        reports.analyze_extreme_events(rows, "rain", "day", ["site"], CALENDAR_DAYS),
    ):
        for name, df in made.items():
            assert df.count() > 0 or name in ("network_edges",), name
    one = reports.analyze_distributions(rows, "rain", columns)["summary_insights"].first()
    assert 0 <= one["zero_rain_pct"] <= 100


def test_series_reports(spark):
    by = series("site", "day", rows_bound=CALENDAR_DAYS)
    rows = panel(spark, "/root/testdata/sf0.001")
    temporal = reports.analyze_temporal_structure(rows, "rain", by=by, periods=[7, 30])
    for name in ("Month", "season_months", "dominant_periods", "decomposition", "wavelet_periods"):
        assert temporal[name].count() > 0, name
    made = reports.analyze_stationarity_autocorrelation(
        rows, "rain", by=by, periods=[7, 30], residual=temporal["decomposition"]
    )
    sites = rows.select("site").distinct().count()
    assert made["synthesis"].count() == sites and made["residual_diagnosis"].count() == sites


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25570
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


SAMPLE = [
    "weather_panel", "payload_flatten", "csv_lines", "feature_recipe", "event_lags", "event_fill_forward", "rolling_features",
    "sequences", "descriptive_stats", "rain_bands", "wet_dry_months", "extremes_by_month", "histogram", "empirical_cdf",
    "quality_score", "raw_spearman_matrix", "spearman_matrix", "lagged_correlations", "network_metrics", "raw_vif",
    "rank_tests", "kruskal_wallis", "acf", "ljung_box", "kpss", "periodogram", "dominant_periods", "two_stage_evaluation",
    "fold_assignment", "csv_scan", "daily_sink", "unreadable_dates", "moving_average_orders", "least_squares_evaluation",
]


def test_order_suggestions_can_be_written(spark):
    df = QUERIES["order_suggestions"](spark, "/root/testdata/sf0.001")
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    df.write.parquet(scratch() + "/orders")


def test_rows_outside_the_calendar_fail(spark):
    from pyspark.errors import PySparkException

    from pluvia.sources.panel import on_calendar

    obs = spark.createDataFrame(
        [(1, dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0, 1)],
        "site int, day date, rain double, temp double, humidity double, pressure double, wind double, n_obs long")
    with pytest.raises(PySparkException):
        on_calendar(obs).collect()
    assert on_calendar(obs, dt.date(2019, 12, 31), dt.date(2020, 1, 2)).count() == 3


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    cur = duck(sf_dir).execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    df = QUERIES[name](spark, sf_dir)
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    assert compare(df.columns, df.collect(), columns, cur.fetchall()) is None


def test_long_report_keeps_every_cell(spark):
    a = spark.createDataFrame([("x", 1, 2.0, True, [1, 2]), (None, 2, None, False, None)], "name string, site int, v double, ok boolean, list array<int>")
    b = spark.createDataFrame([(dt.date(2020, 1, 2), 3)], "day date, site int")
    rows = {(r.table, r.key, r.metric): (r.value, r.label) for r in reports.long_report({"a": a, "b": b}, ["site"]).collect()}
    assert rows == {
        ("a", "x|1", "v"): (2.0, None), ("a", "x|1", "ok"): (1.0, None), ("a", "x|1", "list"): (None, '{"list":[1,2]}'),
        ("a", "|2", "v"): (None, None), ("a", "|2", "ok"): (0.0, None), ("a", "|2", "list"): (None, "{}"),
        ("b", "2020-01-02|3", "row"): (1.0, None)}


def test_date_ranges_replace_only_their_rows(spark):
    folder = scratch() + "/ranges"
    days = [dt.date(2019, 11, 20) + dt.timedelta(days=i) for i in range(100)]

    def rows(v):
        return spark.createDataFrame([(d, v) for d in days], "day date, v double")

    def stored():
        return {r.day: r.v for r in weather.read_daily(spark, folder, "day", "20190101", "20211231").collect()}

    weather.write_date_range(rows(1.0), folder, "day", "20191120", "20200115")
    assert set(stored().values()) == {1.0} and len(stored()) == 57
    for _ in range(2):  # a repeated range changes nothing
        weather.write_date_range(rows(2.0), folder, "day", "20200110", "20200227")
        assert stored() == {d: 2.0 if d >= dt.date(2020, 1, 10) else 1.0 for d in days}
    weather.write_date_range(rows(3.0).limit(0), folder, "day", "20191201", "20191231")
    assert min(d for d in stored() if d > dt.date(2019, 11, 30)) == dt.date(2020, 1, 1)
    assert spark.read.json(folder + "/_ranges").count() == 4

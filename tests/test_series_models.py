"""Spectra, decomposition, forecasting and rain models against direct numerics."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvia.functions.ordering import series
from pluvia.operators import decomposition as dc
from pluvia.operators import evaluation as ev
from pluvia.operators import forecasting as fc
from pluvia.operators import loess
from pluvia.operators import rain_models as rm
from pluvia.operators import spectrum as sp
from pluvia.operators import training as tr
from tests import local_mstl as lm

BY = series("site", "day", rows_bound=5000)


def one_series(spark, x, site="a"):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(len(x))]
    return spark.createDataFrame(
        pd.DataFrame({"site": site, "day": days, "x": np.asarray(x, float)}), "site string, day date, x double"
    )


@pytest.mark.parametrize("group_values", [1 << 17, 20])
def test_transforms_equal_numpy(spark, group_values):
    """A prime, a square, twice a prime, tiny lengths; with little groups the primes take the chirp form."""
    rng = np.random.default_rng(2)
    x = {f"s{n}": rng.normal(size=n) for n in (151, 144, 94, 60, 3, 2, 1)}
    df = one_series(spark, x["s151"], "s151")
    for name, values in list(x.items())[1:]:
        df = df.union(one_series(spark, values, name))
    got = sp.periodogram(df, "x", by=series("site", "day"), group_values=group_values).toPandas()
    for name, values in x.items():
        n, rows = len(values), got[got["site"] == name].sort_values("k")
        k = np.arange(1, (n - 1) // 2 + 1)
        np.testing.assert_array_equal(rows["k"], k)
        np.testing.assert_allclose(rows["magnitude"], np.abs(np.fft.fft(values))[k], atol=1e-9)
        np.testing.assert_allclose(rows["period"], n / k)


def test_transform_of_one_series_equals_sums(spark):
    x = np.random.default_rng(2).normal(size=151)
    df = one_series(spark, x)
    want = np.abs(np.fft.fft(x))[1:76]
    split = series("site", "day", block_rows=20)
    alone = sp.periodogram(df.drop("site"), "x", by=series((), "day"))
    for got in (sp.periodogram(df, "x", by=BY), alone, sp.periodogram_by_sums(df, "x", by=split)):
        rows = got.toPandas().sort_values("k")
        np.testing.assert_allclose(rows["magnitude"], want, atol=1e-9)
        np.testing.assert_allclose(rows["period"], 151 / np.arange(1, 76))


def test_dominant_period_of_a_sine(spark):
    t = np.arange(900)
    spectrum = sp.detrended_spectrum(one_series(spark, 10 + np.sin(2 * np.pi * t / 14)), "x", by=BY)
    assert 14 in [r["period_days"] for r in sp.dominant_periods(spectrum, keys=["site"]).collect()]


def test_short_series_has_no_spectrum(spark):
    assert sp.detrended_spectrum(one_series(spark, np.arange(100)), "x", by=BY).count() == 0


def morlet_direct(x, s):
    """Coefficients from the definition: convolve with the resampled integral, difference, cut to the middle."""
    integral, step = sp.morlet_integral()
    at = np.floor(np.arange(s * 16 + 1) / (s * step)).astype(int)
    kernel = integral[at[at < len(integral)]][::-1]
    coef = -math.sqrt(s) * np.diff(np.convolve(x, kernel))
    cut = (len(coef) - len(x)) / 2
    return coef[math.floor(cut): len(coef) - math.ceil(cut)]


def complex_morlet_direct(x, s):
    width = min(10 * s, len(x))
    t = (np.arange(0, width) - (width - 1.0) / 2) / s
    kernel = np.conj((np.sqrt(1 / s) * np.exp(5j * t) * np.exp(-0.5 * t * t) * np.pi ** -0.25)[::-1])
    full = np.convolve(x, kernel)
    start = (len(full) - len(x)) // 2
    return full[start: start + len(x)]


@pytest.mark.parametrize("size,rows", [(17, None), (1 << 15, None), (17, 40)])
def test_wavelets_over_blocks_equal_direct_sums(spark, size, rows):
    rng = np.random.default_rng(4)
    x = {"a": rng.normal(size=60), "b": rng.normal(size=7)}
    df = one_series(spark, x["a"]).union(one_series(spark, x["b"], "b"))
    by, scales = series("site", "day"), [1.0, 3.0, 5.5]
    kept = {k: v[-rows:] if rows else v for k, v in x.items()}
    for complex_, direct in ((False, morlet_direct), (True, complex_morlet_direct)):
        got = sp._cwt(df, "x", rows, scales, complex_, by, size).toPandas().sort_values(["site", "scale", "day"])
        sums = sp.wavelet_power_by_scale(df, "x", rows, scales, complex_, by=by, size=size).toPandas().set_index(["site", "scale"])
        for (site, s), part in got.groupby(["site", "scale"]):
            want = direct(kept[site], s)
            np.testing.assert_allclose(part["coef"], want.real, atol=1e-9)
            np.testing.assert_allclose(part["power"], np.abs(want) ** 2, atol=1e-9)
            assert sums.loc[(site, s), "global_power"] == pytest.approx((np.abs(want) ** 2).mean())


def test_wavelet_peaks_at_the_scale_of_a_sine(spark):
    t = np.arange(800)
    power = sp.wavelet_power(one_series(spark, np.sin(2 * np.pi * t / 20)), "x", years=2, by=BY)
    spectrum = sp.global_wavelet_spectrum(power, ["site"])
    assert power.select("day").distinct().count() == 730
    best = spectrum.orderBy(F.desc("global_power")).first()["scale"]
    assert abs(best - 20 * 5 / (2 * math.pi)) <= 3  # the Morlet's centre frequency is 5 / 2 pi


def loess_direct(y, q):
    n, out = len(y), []
    for i in range(n):
        order = sorted(range(n), key=lambda j: abs(j - i))
        near = sorted(order[: min(q, n)])
        a = lm._left(i + 1, n, q) - 1
        near = list(range(a, a + min(q, n)))
        h = max(i - near[0], near[-1] - i) + (max(q - n, 0) // 2)
        w = np.array([max(0.0, 1 - (abs(j - i) / h) ** 3) ** 3 for j in near])
        z = np.column_stack([np.ones(len(near)), np.array(near) - i])
        beta = np.linalg.lstsq(z * np.sqrt(w)[:, None], y[near] * np.sqrt(w), rcond=None)[0]
        out.append(beta[0])
    return np.array(out)


@pytest.mark.parametrize("n,q", [(40, 7), (40, 11), (9, 15), (30, 29)])
def test_loess_is_local_regression(n, q):
    y = np.random.default_rng(n + q).normal(size=n)
    np.testing.assert_allclose(lm.loess(y, q), loess_direct(y, q), atol=2e-3)
    np.testing.assert_allclose(lm.loess(y, q, rho=np.ones(n)), lm.loess(y, q), atol=1e-12)


def test_dense_cycles_equal_single_cycles():
    y = np.random.default_rng(8).normal(size=100)
    fast = lm._smooth_cycles(y, 7, 11, 1, None)
    slow = np.empty_like(fast)
    for p in range(7):
        slow[p::7] = lm._smooth_cycle(y[p::7], 11, 1, None)
    np.testing.assert_allclose(fast, slow, atol=1e-12)


def test_decomposition_recovers_trend_and_season(spark):
    t = np.arange(420)
    level, week = 5 + 0.01 * t, np.sin(2 * np.pi * t / 7)
    df = one_series(spark, np.expm1(level * 0.2 + 0.1 * week))
    got = dc.decompose(df, "x", [7, 30], by=BY).toPandas().sort_values("day")
    total = got["trend"] + got["seasonal_1"] + got["seasonal_2"] + got["resid"]
    np.testing.assert_allclose(total, got["observed"], atol=1e-12)
    np.testing.assert_allclose(got["seasonal_1"], 0.1 * week, atol=0.01)
    np.testing.assert_allclose(got["trend"], level * 0.2, atol=0.01)


@pytest.mark.parametrize("size,options", [(37, {}), (1000, {}), (2500, {"robust": True, "inner_iter": 2, "outer_iter": 2})])
def test_blocks_equal_the_decomposition_in_memory(spark, size, options):
    """Blocks much shorter than the reach of the filters, series of different lengths."""
    rng = np.random.default_rng(5)
    x = {"a": rng.gamma(2, 2, 301), "b": rng.gamma(2, 2, 64), "c": rng.gamma(2, 2, 40)}
    df = one_series(spark, x["a"]).union(one_series(spark, x["b"], "b")).union(one_series(spark, x["c"], "c")).union(one_series(spark, x["c"][:12], "d"))
    by = series("site", "day")
    got = dc.decompose(df, "x", [7, 30], by=by, size=size, **options).toPandas().sort_values(["site", "day"])
    assert sorted(got["site"].unique()) == ["a", "b", "c"]
    for site, rows in got.groupby("site"):
        level, seasonal, rest = lm.mstl(np.log1p(x[site]), [7, 30], **options)
        np.testing.assert_allclose(rows["trend"], level, atol=1e-9)
        np.testing.assert_allclose(rows["resid"], rest, atol=1e-9)
        for i in range(2):
            if i < len(seasonal):
                np.testing.assert_allclose(rows[f"seasonal_{i + 1}"], seasonal[i], atol=1e-9)
            else:
                assert rows[f"seasonal_{i + 1}"].isna().all()


def test_one_loess_pass_over_blocks(spark):
    x = np.random.default_rng(6).normal(size=200)
    rows = one_series(spark, x)
    for size, q in ((25, 31), (1000, 31), (25, 301)):
        got = dc.loess_smooth(rows, "x", q, by=series("site", "day"), size=size).toPandas().sort_values("day")
        np.testing.assert_allclose(got["smooth"], lm.loess(x, q), atol=1e-10)


def test_rounds_without_an_exchange():
    """Several rounds from a wider reach equal as many single rounds of the whole series."""
    x = np.random.default_rng(7).normal(size=900)
    windows, n = (11, 9, 13), 900
    whole = loess.seasonal_steps(x, np.zeros(n), None, 0, 0, n, n, 3, 7, windows, (1, 1, 1))
    reach = 3 * loess.step_reach(7, windows)
    a, b = 400, 430
    lo, hi = a - reach, b + reach
    part = loess.seasonal_steps(x[lo:hi], np.zeros(hi - lo), None, lo, a, b, n, 3, 7, windows, (1, 1, 1))
    assert hi < n and lo > 0
    for p, w in zip(part, whole, strict=True):
        np.testing.assert_allclose(p, w[a:b], atol=1e-12)


def test_decomposition_leaves_out_what_is_too_short(spark):
    assert dc.decompose(one_series(spark, np.ones(10)), "x", [7], by=BY).count() == 0


def test_box_cox_auto_handles_zeros(spark):
    x = np.random.default_rng(1).gamma(2, 2, 400)
    x[:5] = 0
    got = dc.decompose(one_series(spark, x), "x", [7], lmbda="auto", by=BY)
    assert got.count() == 400


def test_forecast_of_an_ar_process(spark):
    rng = np.random.default_rng(11)
    x = np.zeros(2000)
    for t in range(1, 2000):
        x[t] = 0.7 * x[t - 1] + rng.normal()
    fitted = fc.ar_model("x", (1, 0, 0)).fit(one_series(spark, x), by=BY)
    coef = fitted.table.first()["coef"][0]
    assert coef == pytest.approx((x[1:] @ x[:-1]) / (x[:-1] @ x[:-1]), rel=1e-9)
    path = [r["forecast"] for r in fitted.forecast(3).orderBy("step").collect()]
    np.testing.assert_allclose(path, x[-1] * coef ** np.arange(1, 4))


def test_seasonal_difference_continues_a_pattern(spark):
    week = np.array([3.0, 1, 4, 1, 5, 9, 2])
    x = np.tile(week, 40) + np.random.default_rng(0).normal(size=280) * 1e-6
    fitted = fc.seasonal_ar_model("x", (1, 0, 0), (0, 1, 0, 7)).fit(one_series(spark, x), by=BY)
    path = [r["forecast"] for r in fitted.forecast(14).orderBy("step").collect()]
    np.testing.assert_allclose(path, np.tile(week, 2), atol=1e-4)


def test_moving_average_terms_and_outside_columns(spark):
    rng = np.random.default_rng(21)
    e, z = rng.normal(size=3001), rng.normal(size=3000)
    x = 2.0 * z + e[1:] + 0.5 * e[:-1]
    df = one_series(spark, x).toPandas().assign(z=z)
    df = spark.createDataFrame(df, "site string, day date, x double, z double")
    fitted = fc.ar_model("x", (0, 0, 1), exog=["z"]).fit(df, by=BY)
    assert fitted.table.first()["coef"][1] == pytest.approx(2.0, abs=0.1)
    future = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.0)], "site string, step int, z double")
    assert fitted.forecast(2, future).count() == 2
    with pytest.raises(ValueError, match="do not match"):
        fitted.forecast(2, future.withColumnRenamed("z", "other"))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    n = 600
    a, b = rng.normal(size=(2, n))
    wet = (a + rng.normal(size=n) * 0.5) > 0
    y = np.where(wet, np.maximum(0.2, 5 + 2 * a + b + rng.normal(size=n) * 0.3), 0.0)
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    return spark.createDataFrame(pd.DataFrame({"day": days, "a": a, "b": 3 * b + 1, "y": y}), "day date, a double, b double, y double")


def scaled(pdf, names):
    x = pdf[names].to_numpy()
    return (x - x.mean(axis=0)) / x.std(axis=0)


def test_ridge_and_lasso_match_their_definitions(spark, rows):
    pdf = rows.toPandas()
    wet = pdf[pdf["y"] > 0.1]
    z, y = scaled(wet, ["a", "b"]), wet["y"].to_numpy()
    ridge = np.linalg.solve(z.T @ z + 5.0 * np.eye(2), z.T @ (y - y.mean()))
    factor = math.sqrt((len(wet) - 1) / len(wet))  # MLlib scales by the sample deviation
    fitted = rm.RainModel("linear", ["a", "b"], "y", params={"alpha": 5.0}).fit(rows)
    got = {(r["stage"], r["feature"]): r["coefficient"] for r in fitted.coefficients(spark).collect()}
    np.testing.assert_allclose([got["regression", c] * factor for c in "ab"], ridge, rtol=1e-6)
    lasso = rm.RainModel("linear", ["a", "b"], "y", two_stage=False, params={"alpha": 0.4, "regression_type": "lasso"})
    coef = {r["feature"]: r["coefficient"] for r in lasso.fit(rows).coefficients(spark).collect()}
    z, y = scaled(pdf, ["a", "b"]), pdf["y"].to_numpy()
    w = np.zeros(2)
    for _ in range(500):
        for j in range(2):
            r = y - y.mean() - z @ w + z[:, j] * w[j]
            c = z[:, j] @ r / len(y)
            w[j] = math.copysign(max(abs(c) - 0.4, 0), c)
    factor = math.sqrt((len(pdf) - 1) / len(pdf))
    np.testing.assert_allclose([coef["a"] * factor, coef["b"] * factor], w, atol=1e-4)


def test_two_stage_beats_nothing_and_predicts_every_row(spark, rows):
    train, test = ev.prepare_data(rows, "y", ["a", "b"], "day")
    assert (train.count(), test.count()) == (480, 120)
    fitted = rm.RainModel("linear", ["a", "b"], "y").fit(train)
    scored = fitted.predict(test).toPandas()
    assert len(scored) == 120 and set(scored["combined"][scored["p_rain"] < 0.5]) == {0.0}
    m = fitted.evaluate(test).first()
    assert m["ROC_AUC"] > 0.85 and m["rain_R2"] > 0.9 and m["total_rows"] == 120


def test_no_rain_means_no_regressor(spark, rows):
    dry = rows.withColumn("y", F.when(F.col("a") > 100, 1.0).otherwise(0.0))
    model = rm.RainModel("linear", ["a", "b"], "y")
    assert model._regression(dry.withColumn("_y", F.col("y")).filter("y > 0.1"), {}) is None
    fitted = rm.FittedRainModel(model, classifier=rm.RainModel("linear", ["a", "b"], "y").fit(rows).classifier)
    assert fitted.predict(dry).agg(F.max("amount")).first()[0] == 0.0


def test_tree_families(spark, rows):
    fitted = rm.RainModel("random_forest", ["a", "b"], "y", params={"n_estimators": 5, "max_depth": 4}).fit(rows)
    shares = fitted.feature_importance(spark).groupBy("stage").agg(F.sum("importance").alias("s")).collect()
    assert [r["s"] for r in shares] == pytest.approx([1.0, 1.0])
    small = {"n_estimators": 3, "max_depth": 2}
    both = [rm.RainModel(f, ["a", "b"], "y", two_stage=t, params=small).fit(rows) for f, t in (("xgboost", True), ("lightgbm", False))]
    assert rm.compare_approaches(both, rows).count() == 2


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9), (0, 0.2), (0, 0.1)], "y int, s double")
    assert ev.roc_auc(df, "y", "s").first()["ROC_AUC"] == pytest.approx(0.875)
    assert ev.roc_auc(df.filter("y = 1"), "y", "s").first()["ROC_AUC"] is None
    same = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, p double")
    assert ev.regression_metrics(same, "y", "p").first()["R2"] == 0.0
    with pytest.raises(ValueError):
        ev.calculate_metrics(df, "y", "s", "ranking")


def test_folds_expand_and_do_not_overlap():
    bounds = ev.fold_bounds(103, 5)
    assert bounds[0] == (0, 18, 35) and bounds[-1] == (4, 86, 103)
    assert all(a[2] == b[1] for a, b in zip(bounds, bounds[1:]))
    with pytest.raises(ValueError):
        ev.fold_bounds(3, 5)


def test_cross_validation_and_search(spark, rows):
    train, _ = ev.prepare_data(rows, "y", ["a", "b"], "day")
    model = rm.RainModel("linear", ["a", "b"], "y")
    cv = {r["metric"]: r for r in tr.cross_validate(model, train, 3).collect()}
    assert len(cv["MAE"]["scores"]) == 3 and cv["MAE"]["mean"] == pytest.approx(np.mean(cv["MAE"]["scores"]))
    best = tr.search_single_stage(
        model, train, {"regression_type": {"type": "categorical", "choices": ["linear"]}}, "r2", n_trials=1, n_splits=2
    )
    assert best == {"regression_type": "linear"}
    results = tr.train_models(rows, "y", {"good": model, "bad": rm.RainModel("linear", ["a", "missing"], "y")}, ["a", "b"], "day", cv_splits=2)
    assert "evaluation" in results["good"] and "error" in results["bad"]
    assert tr.results_table(spark, results).count() == 2


def test_draws_follow_their_space():
    rng = random.Random(1)
    space = {"k": {"type": "int", "low": 2, "high": 4}, "c": {"type": "loguniform", "low": 0.01, "high": 1.0}, "f": {"type": "float", "low": 0, "high": 1}}
    for _ in range(50):
        p = tr.draw(space, rng)
        assert 2 <= p["k"] <= 4 and 0.01 <= p["c"] <= 1.0 and 0 <= p["f"] <= 1

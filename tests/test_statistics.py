"""Statistics against direct numpy formulas."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvia.functions import tails
from pluvia.functions.ordering import series
from pluvia.operators import autocorrelation as ac
from pluvia.operators import correlation as co
from pluvia.operators import profile as pf
from pluvia.operators import stat_tests as st
from pluvia.operators import stationarity as sy

BY = series("site", "day", rows_bound=5000)
SPLIT = series("site", "day", block_rows=64)


def as_series(spark, **named):
    parts = []
    for site, x in named.items():
        days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(len(x))]
        parts.append(pd.DataFrame({"site": site, "day": days, "x": np.asarray(x, float)}))
    return spark.createDataFrame(pd.concat(parts), "site string, day date, x double")


def walks(n=300):
    rng = np.random.default_rng(5)
    e = rng.normal(size=(2, n))
    ar = np.zeros(n)
    for t in range(1, n):
        ar[t] = 0.6 * ar[t - 1] + e[0, t]
    return {"ar": ar + 2, "walk": np.cumsum(e[1])}


def test_tails(spark):
    df = spark.createDataFrame([(x, k) for x in (0.0, 0.3, 2.0, 9.5, 40.0) for k in (1, 2, 3, 7, 10)], "x double, k int")
    rows = df.select("x", "k", tails.chi2_sf(F.col("x"), F.col("k")).alias("p"), tails.erfc(F.col("x")).alias("e")).collect()
    for r in rows:
        assert r["e"] == pytest.approx(math.erfc(r["x"]), rel=1e-13)
        grid = np.linspace(r["x"], r["x"] + 400, 400001)
        if r["k"] > 1 or r["x"] > 0:
            pdf = np.where(grid > 0, grid, 1e-300) ** (r["k"] / 2 - 1) * np.exp(-grid / 2) / (2 ** (r["k"] / 2) * math.gamma(r["k"] / 2))
            assert r["p"] == pytest.approx(np.trapezoid(pdf, grid), abs=2e-4)
    t = spark.createDataFrame([(12.7062, 1.0), (2.2281, 10.0), (1.962, 1000.0)], "t double, v double")
    for r in t.select(tails.t_two_sided("t", "v").alias("p")).collect():
        assert r["p"] == pytest.approx(0.05, abs=1e-4)


def test_descriptive_stats_match_pandas(spark, panel_rows):
    x = panel_rows.toPandas()["x"].dropna()
    got = pf.descriptive_stats(panel_rows, ["x"]).first()
    assert got["Skewness"] == pytest.approx(x.skew()) and got["Kurtosis"] == pytest.approx(x.kurtosis())
    assert got["Mode"] == x.mode().iloc[0] and got["Count"] == len(x)
    assert got["P95"] == pytest.approx(x.quantile(0.95)) and got["CV_pct"] == pytest.approx(x.std() / x.mean() * 100)


def test_zero_mean_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 7.0), (-1.0, 7.0), (1.0, 7.0), (-1.0, 7.0)], "a double, b double")
    rows = {r["Feature"]: r for r in pf.descriptive_stats(df, ["a", "b"]).collect()}
    assert rows["a"]["CV_pct"] == math.inf and rows["b"]["Skewness"] == 0.0 and rows["b"]["Kurtosis"] == 0.0
    assert co.pearson_matrix(df, ["a", "b"]).first()["r"] is None


def test_spearman_with_gaps(spark, panel_rows):
    p = panel_rows.toPandas()
    want = p["x"].rank().where(p["x"].notna())
    ok = p["x"].notna()
    want = np.corrcoef(p["x"][ok].rank(), p["y"][ok].rank())[0, 1]
    assert co.spearman_matrix(panel_rows, ["x", "y"]).first()["r"] == pytest.approx(want)
    full = panel_rows.na.drop("any")
    assert co.spearman_matrix(full, ["x", "y"]).first()["r"] == pytest.approx(want)


def test_many_pairs_route(spark, monkeypatch, panel_rows):
    want = {(r["feature_a"], r["feature_b"]): r["r"] for r in co.pearson_matrix(panel_rows, ["x", "y"]).collect()}
    monkeypatch.setattr(co, "PAIRS_IN_ONE_AGGREGATE", 0)
    for r in co.pearson_matrix(panel_rows, ["x", "y"]).collect():
        assert r["r"] == pytest.approx(want[r["feature_a"], r["feature_b"]])


def test_vif_and_clusters(spark):
    rng = np.random.default_rng(3)
    a, b, c, d, e, f = rng.normal(size=(6, 500))
    x = np.column_stack([a, a + 0.3 * b, c, c + 0.2 * d, e, f])
    names = list("pqrstu")
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    inverse = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    got = {r["Feature"]: r["VIF_Score"] for r in co.vif_table(df, names).collect()}
    np.testing.assert_allclose([got[n] for n in names], inverse, rtol=1e-8)
    label = {r["feature"]: r["cluster"] for r in co.feature_clusters(df, names, 4).collect()}
    assert label["p"] == label["q"] and label["r"] == label["s"] and label["p"] != label["r"]


def test_shapiro_and_anderson(spark):
    # Published example: weights of eleven men (Shapiro and Wilk 1965), W about 0.79.
    w = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    long = spark.createDataFrame([("w", float(v)) for v in w], "Feature string, v double")
    got = st.shapiro_wilk(long).first()
    assert got["Shapiro_Stat"] == pytest.approx(0.79, abs=0.005) and got["Shapiro_P"] == pytest.approx(0.0067, abs=0.001)
    x = np.sort((np.array(w) - np.mean(w)) / np.std(w, ddof=1))
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    n, i = len(x), np.arange(1, len(x) + 1)
    want = -n - np.mean((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1])))
    assert st.anderson_darling(long).first()["AD_Stat"] == pytest.approx(want)


def test_battery_orders_values_and_not_rows(spark, monkeypatch):
    """Shapiro-Wilk from counted values equals the one over ordered rows, and the battery orders no rows."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"a": rng.choice([0.0, 0.0, 0.0, 1.0, 2.5], 700), "b": rng.normal(size=700), "c": np.full(700, 4.0)})
    df = spark.createDataFrame(rows)
    long = st.to_long(df, [], ["a", "b", "c"], "Feature", "v")
    want = {r.Feature: r for r in st.shapiro_wilk(long).collect()}
    ranked = st.average_ranks(long, ["Feature"], "v")
    for stretch in (1, 7, 4096):
        placed = st.tie_positions(ranked, stretch).groupBy("Feature").agg(F.sort_array(F.collect_list("_pos")).alias("p"))
        assert all(r.p == list(range(700)) for r in placed.collect())

    def fail(*_):
        raise AssertionError("rows were ordered")

    monkeypatch.setattr(st, "with_positions", fail)
    got = {r.Feature: r for r in st.normality_battery(df, ["a", "b", "c"]).collect()}
    assert set(got) == {"a", "b", "c"} == set(want)
    for name, r in want.items():
        assert got[name].Shapiro_Stat == pytest.approx(r.Shapiro_Stat, rel=1e-10)
        assert got[name].Shapiro_P == pytest.approx(r.Shapiro_P, rel=1e-6)


def test_rank_tests_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rain = rng.choice([0.0, 1.0, 5.0, 20.0], 200)
    x = np.round(rng.normal(size=200) + rain / 20, 1)
    df = spark.createDataFrame(pd.DataFrame({"rain": rain, "x": x}))
    got = st.non_parametric_tests(df, "rain", ["x"]).first()
    dry, wet = x[rain == 0], x[rain > 0]
    u = sum((a > b) + 0.5 * (a == b) for a in dry for b in wet)
    assert got["MW_Statistic"] == pytest.approx(u)
    ranks = pd.Series(x).rank().to_numpy()
    n = len(x)
    h = 12 / (n * (n + 1)) * sum(ranks[rain == g].sum() ** 2 / (rain == g).sum() for g in set(rain)) - 3 * (n + 1)
    ties = sum(c ** 3 - c for c in pd.Series(x).value_counts())
    assert got["KW_Statistic"] == pytest.approx(h / (1 - ties / (n ** 3 - n)))
    assert got["Spearman_Corr"] == pytest.approx(np.corrcoef(ranks, pd.Series(rain).rank())[0, 1])


def acf_direct(x, k):
    c = x - x.mean()
    return np.array([c[j:] @ c[: len(c) - j] for j in range(k + 1)])


@pytest.mark.parametrize("by", [BY, SPLIT])
def test_acf_pacf(spark, by):
    data = walks()
    df = as_series(spark, **data)
    got = ac.acf(df, "x", 20, by=by).toPandas().set_index(["site", "lag"]).sort_index()
    part = ac.pacf(df, "x", 20, by=by).toPandas().set_index(["site", "lag"]).sort_index()
    for site, x in data.items():
        s = acf_direct(x, 20)
        np.testing.assert_allclose(got.loc[site]["r"], s / s[0], atol=1e-10)
        acov = s / (len(x) - np.arange(21))
        for k in (1, 4, 9):
            toeplitz = acov[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
            assert part.loc[site]["r"].iloc[k] == pytest.approx(np.linalg.solve(toeplitz, acov[1: k + 1])[-1])


def adf_direct(x, trend):
    """Textbook augmented Dickey-Fuller by least squares."""
    n = len(x)
    top = min(n // 2 - (2 if trend else 1) - 1, math.ceil(12 * (n / 100) ** 0.25))
    dx = np.diff(x)

    def fit(lag, skip):
        rows = range(skip, len(dx))
        z = [[1.0, *([float(t)] if trend else []), x[t], *[dx[t - j] for j in range(1, lag + 1)]] for t in rows]
        z, y = np.array(z), dx[skip:]
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        ssr = ((y - z @ beta) ** 2).sum()
        at = 2 if trend else 1
        se = math.sqrt(ssr / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[at, at])
        return len(y) * math.log(ssr / len(y)) + 2 * z.shape[1], beta[at] / se

    best = min(range(top + 1), key=lambda lag: fit(lag, top)[0])
    return fit(best, best)[1], best


@pytest.mark.parametrize("by", [BY, SPLIT])
@pytest.mark.parametrize("regression", ["c", "ct"])
def test_adf(spark, by, regression):
    data = walks()
    got = {r["site"]: r for r in sy.adf_test(as_series(spark, **data), "x", regression, by=by).collect()}
    for site, x in data.items():
        stat, lag = adf_direct(x, regression == "ct")
        assert got[site]["used_lag"] == lag and got[site]["adf_stat"] == pytest.approx(stat, rel=1e-6)
    assert got["ar"]["adf_stationary"] and not got["walk"]["adf_stationary"]


def kpss_direct(x, trend):
    n, t = len(x), np.arange(len(x), dtype=float)
    e = x - np.polyval(np.polyfit(t, x, 1), t) if trend else x - x.mean()
    gamma = np.array([e[k:] @ e[: n - k] for k in range(n)])
    m = int(n ** (2 / 9))
    s0 = gamma[0] / n + sum(gamma[k] / (n / 2) for k in range(1, m + 1))
    s1 = sum(k * gamma[k] / (n / 2) for k in range(1, m + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    lrv = (gamma[0] + 2 * sum(gamma[k] * (1 - k / (lags + 1)) for k in range(1, lags + 1))) / n
    return (np.cumsum(e) ** 2).sum() / n ** 2 / lrv, lags


@pytest.mark.parametrize("by", [BY, SPLIT])
@pytest.mark.parametrize("regression", ["c", "ct"])
def test_kpss(spark, by, regression):
    data = walks()
    got = {r["site"]: r for r in sy.kpss_test(as_series(spark, **data), "x", regression, by=by).collect()}
    for site, x in data.items():
        stat, lags = kpss_direct(x, regression == "ct")
        assert got[site]["kpss_lags"] == lags and got[site]["kpss_stat"] == pytest.approx(stat, rel=1e-8)


def test_make_stationary_differences_only_the_walk(spark):
    df = as_series(spark, **walks())
    got = sy.make_stationary(df, ["x"], by=BY).toPandas()
    assert (got["site"] == "ar").sum() == 300 and (got["site"] == "walk").sum() == 299


def test_ljung_box_counts(spark):
    lb = ac.ljung_box(as_series(spark, **walks()), "x", 10, by=BY)
    rows = {r["site"]: r for r in ac.ljung_box_summary(lb, ["site"]).collect()}
    assert rows["walk"]["significant_lags"] == 10 and rows["walk"]["first_significant_lag"] == 1


def test_order_suggestion_rules(spark):
    schema = "site string, lag int, significant boolean"
    acf = spark.createDataFrame([("a", k, k in (1, 2, 8)) for k in range(1, 20)], schema)
    pacf = spark.createDataFrame([("a", k, k in (1,)) for k in range(1, 20)], schema)
    got = ac.suggest_orders(acf, pacf, (), ["site"]).first()
    assert (got["ar_order"], got["ma_order"], got["season_length"]) == (1, 3, 7) and got["suggested_models"][0] == "SARIMA(1,1,3)x(1,1,1,7)"
    named = ac.suggest_orders(acf, pacf, (7, 30), ["site"]).first()
    assert named["season_length"] == 30 and named["suggested_models"][2] == "SARIMA(1,1,3)x(1,1,1,7)"


def test_series_without_keys(spark):
    data = walks()["ar"]
    df = as_series(spark, a=data).select("day", "x")
    by = series((), "day", block_rows=64)
    got = sy.stationarity_tests(df, "x", "ct", by=by).first()
    stat, lag = adf_direct(data, True)
    assert got["used_lag"] == lag and got["adf_stat"] == pytest.approx(stat, rel=1e-6)
    assert got["kpss_stat"] == pytest.approx(kpss_direct(data, True)[0], rel=1e-8)
    assert ac.acf(df, "x", 10, by=by).count() == 11
    assert sy.make_stationary(df, ["x"], by=by).count() == 300


@pytest.mark.parametrize("size", [3, 17, 1 << 18])
@pytest.mark.parametrize("regression", ["c", "ct"])
def test_kpss_over_blocks(spark, size, regression):
    rng = np.random.default_rng(9)
    x = {"walk": np.cumsum(rng.normal(size=90)), "noise": rng.normal(size=41), None: rng.normal(size=30)}
    rows = [(k, i, float(v)) for k, values in x.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "site string, day int, x double")
    got = {r.site: r for r in sy.kpss_test(df, "x", regression, by=series("site", "day"), size=size).collect()}
    for k, values in x.items():
        stat, m = kpss_direct(values, regression == "ct")
        assert got[k].kpss_stat == pytest.approx(stat, rel=1e-9) and got[k].kpss_lags == m
    alone = sy.kpss_test(df.filter("site = 'walk'").drop("site"), "x", regression, by=series((), "day"), size=size).first()
    assert alone.kpss_stat == pytest.approx(got["walk"].kpss_stat)


def gaps(n=500, k=6, seed=12):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(1000, 3, (n, k)) + rng.normal(0, 3, (n, 1)), 0)
    x[rng.random((n, k)) < 0.15] = np.nan
    return pd.DataFrame(x, columns=[f"c{i}" for i in range(k)])


def as_rows(spark, pdf, key=None):
    rows = [tuple(None if v != v else float(v) for v in r) for r in pdf.to_numpy()]
    schema = ", ".join(f"{c} double" for c in pdf.columns)
    if key is not None:
        rows, schema = [(key(i), *r) for i, r in enumerate(rows)], "site string, " + schema
    return spark.createDataFrame(rows, schema).repartition(3)


def test_wide_pearson_equals_pairwise(spark):
    """300 columns with gaps and large means: matrix products against pairwise complete correlations."""
    pdf = gaps(200, 300)
    df = as_rows(spark, pdf)
    got = co.pearson_matrix(df, list(pdf.columns)).toPandas()
    want, present = pdf.corr().to_numpy(), pdf.notna().to_numpy().astype(int)
    assert len(got) == 300 * 299 // 2
    a, b = got["feature_a"].str[1:].astype(int), got["feature_b"].str[1:].astype(int)
    np.testing.assert_allclose(got["r"], want[a, b], atol=1e-10)
    np.testing.assert_array_equal(got["n"], (present.T @ present)[a, b])


def test_wide_pearson_by_key_with_nan_and_constants(spark):
    pdf = gaps(300, 8).assign(c3=7.0)
    df = as_rows(spark, pdf, lambda i: [None, "a", "b"][i % 3])
    df = df.withColumn("c5", F.when(F.col("c5") == df.agg(F.max("c5")).first()[0], float("nan")).otherwise(F.col("c5")))
    columns = list(pdf.columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = {(r.site, r.feature_a, r.feature_b): r for r in co._wide_correlations(df, ["site"], pairs).collect()}
    narrow = co.pair_correlations(df, columns, ["site"], pairs).collect()
    assert len(wide) == len(narrow) == 3 * len(pairs)
    for r in narrow:
        other = wide[r.site, r.feature_a, r.feature_b]
        assert other.n == r.n
        if r.r is None or other.r is None:
            assert "c3" in (r.feature_a, r.feature_b)
        elif math.isnan(r.r):
            assert math.isnan(other.r) and "c5" in (r.feature_a, r.feature_b)
        elif "c3" not in (r.feature_a, r.feature_b):
            assert other.r == pytest.approx(r.r, abs=1e-9)


@pytest.mark.parametrize("key,bound", [(None, None), (lambda i: "ab"[i % 2], None), (lambda i: "ab"[i % 2], 1000)])
def test_spearman_with_gaps_equals_pairwise(spark, key, bound):
    pdf = gaps()
    df = as_rows(spark, pdf, key)
    keys = ["site"] if key else []
    got = co.spearman_matrix(df, list(pdf.columns), keys, bound).collect()
    parts = {None: pdf} if not key else {s: pdf[[key(i) == s for i in range(len(pdf))]] for s in "ab"}
    assert len(got) == 15 * len(parts)
    for r in got:
        own = parts[r.site if key else None][[r.feature_a, r.feature_b]].dropna()
        assert r.n == len(own) and r.r == pytest.approx(own.rank().corr().iloc[0, 1], abs=1e-10)


def test_density_by_cells_equals_the_sum_of_kernels(spark):
    rng = np.random.default_rng(1)
    x = {"gamma": rng.gamma(0.5, 30, 700), "far": np.append(rng.normal(0, 1, 300), 1e4), "flat": np.full(5, 2.0), "one": np.array([3.0])}
    df = spark.createDataFrame([(k, float(v)) for k, values in x.items() for v in values], "site string, x double")
    got = pf.density_grid(df, "x", 101, ["site"]).toPandas()
    for site, rows in got.groupby("site"):
        values, rows = x[site], rows.sort_values("point")
        np.testing.assert_allclose(rows["at"], np.linspace(values.min(), values.max(), 101))
        if site in ("flat", "one"):
            assert rows["density"].isna().all()
            continue
        h = values.std(ddof=1) * len(values) ** -0.2
        z = (rows["at"].to_numpy()[:, None] - values[None, :]) / h
        want = np.exp(-z * z / 2).sum(1) / (len(values) * h * math.sqrt(2 * math.pi))
        np.testing.assert_allclose(rows["density"], want, atol=1e-11 / h, rtol=1e-9)
    assert len(got) == 4 * 101

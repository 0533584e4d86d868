"""ADF and KPSS tests, verdicts, differencing, residual diagnosis, synthesis."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.functions.blocks import BLOCK_VALUES, PLACE, series_blocks, with_reach
from pluvia.functions.gram import gram_by_key
from pluvia.functions.ordering import Series, longest_series, over_frames, running_total
from pluvia.functions.storage import materialise
from pluvia.functions.stats import kurt_adjusted, skew_adjusted
from pluvia.functions.tails import let, normal_cdf
from pluvia.operators.autocorrelation import lags_near_periods, ljung_box, ljung_box_summary
from pluvia.operators.profile import join_groups, with_series_facts
from pluvia.operators.stat_tests import moment_tests, shapiro_wilk

# MacKinnon response surfaces of the Dickey-Fuller statistic for
# a constant (c) and a constant with trend (ct): limits, low and high branch,
# lowest power first, and the coefficients of the 1/5/10 % points in 1/n.
MACKINNON = {
    "c": {
        "max": 2.74, "min": -18.83, "star": -1.61,
        "low": [2.1659, 1.4412, 3.8269e-2], "high": [1.7339, 9.3202e-1, -1.2745e-1, -1.0368e-2],
        "critical": {
            "1%": [-3.43035, -6.5393, -16.786, -79.433],
            "5%": [-2.86154, -2.8903, -4.234, -40.040],
            "10%": [-2.56677, -1.5384, -2.809, 0.0],
        },
    },
    "ct": {
        "max": 0.7, "min": -16.18, "star": -2.89,
        "low": [3.2512, 1.6047, 4.9588e-2], "high": [2.5261, 6.1654e-1, -3.7956e-1, -6.0285e-2],
        "critical": {
            "1%": [-3.95877, -9.0531, -28.428, -134.155],
            "5%": [-3.41049, -4.3904, -9.036, -45.374],
            "10%": [-3.12705, -2.5856, -3.925, -22.380],
        },
    },
}

# KPSS points at p = .10, .05, .025, .01.
KPSS_P = [0.10, 0.05, 0.025, 0.01]
KPSS_POINTS = {"c": [0.347, 0.463, 0.574, 0.739], "ct": [0.119, 0.146, 0.176, 0.216]}


def _poly_low_first(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def mackinnon_p(stat: Column, regression: str) -> Column:
    m = MACKINNON[regression]
    z = F.when(stat <= m["star"], _poly_low_first(m["low"], stat)).otherwise(
        _poly_low_first(m["high"], stat)
    )
    return F.when(stat > m["max"], 1.0).when(stat < m["min"], 0.0).otherwise(let(z, normal_cdf))


def adf_max_lag(rows: int, regression: str) -> int:
    trend_terms = {"c": 1, "ct": 2}[regression]
    return max(0, min(rows // 2 - trend_terms - 1, math.ceil(12 * (rows / 100) ** 0.25)))


def _ols(gram: np.ndarray, use: list[int], target: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and inverse of X'X."""
    xx = gram[np.ix_(use, use)]
    inverse = np.linalg.pinv(xx, hermitian=True)
    xy = gram[use, target]
    beta = inverse @ xy
    return beta, max(float(gram[target, target] - beta @ xy), 0.0), inverse


def adf_test(df: DataFrame, column: str, regression: str = "ct", *, by: Series) -> DataFrame:
    """(keys, adf_stat, adf_pvalue, used_lag, n_obs, crit_1/5/10, adf_stationary).

    Lag length by AIC over a common sample, then the chosen regression on its
    own full sample.  All candidate regressions of a key are read off one
    cross-product matrix; the few rows that only shorter lags can use are kept
    as rows and added for the final fit.
    """
    keys = list(by.keys)
    x = df.select(*keys, by.order, *by.ties, F.col(column).cast("double").alias("_y")).filter("_y IS NOT NULL")
    longest = by.rows_bound if by.rows_bound is not None else longest_series(x, keys)
    top = adf_max_lag(longest, regression)
    rows = with_series_facts(x, by, {
        "_n": F.count("_y"), "_mean": F.avg("_y"), "_sd": F.stddev_pop("_y"),
    }).filter("_n >= 8 AND _sd > 0").withColumn(
        "_z", (F.col("_y") - F.col("_mean")) / F.col("_sd")
    )
    numbered = running_total(rows, by, "_z", "_sum")
    stepped = over_frames(numbered, by, 1, 0, lambda w: {"_before": F.lag("_z", 1).over(w)})
    moves = stepped.withColumn("_d", F.col("_z") - F.col("_before"))
    framed = over_frames(moves, by, top, 0, lambda w: {
        "_past": F.collect_list("_d").over(w.rowsBetween(-top, -1)) if top else F.array().cast("array<double>")
    }).filter("_before IS NOT NULL")
    trend_terms = {"c": 1, "ct": 2}[regression]
    own_lag = F.greatest(F.lit(0), F.least(
        F.floor(F.col("_n") / 2) - trend_terms - 1,
        F.ceil(12 * F.pow(F.col("_n") / F.lit(100.0), F.lit(0.25))),
    )).cast("int")
    lags = F.reverse("_past")
    padded = F.slice(F.concat(lags, F.array_repeat(F.lit(0.0), max(top, 1))), 1, max(top, 1))
    # Position 0 is the first difference; rows past the key's own lag are "full".
    flagged = framed.withColumns({"_own": own_lag, "_at": F.col("_pos") - 1})
    vector = F.concat(
        F.array(F.lit(1.0), F.col("_pos") / F.col("_n"), F.col("_before"), F.col("_d")), padded
    )
    design = flagged.withColumn("_v", vector)
    early = F.when(F.col("_at") < F.col("_own"), F.col("_at").cast("long"))
    pieces = gram_by_key(design.withColumn("_head", early), keys, "_v", "_head", ["_own"])
    fields = [T.StructField("adf_stat", T.DoubleType()), T.StructField("used_lag", T.IntegerType()),
              T.StructField("n_obs", T.LongType())]
    schema = T.StructType([pieces.schema[k] for k in keys] + fields)
    fixed = [0] if regression == "c" else [0, 1]

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own_lag = int(pdf["_own"].iloc[0])
        mats = pdf[pdf["at"] == -1]
        if mats.empty:
            return pd.DataFrame(columns=schema.names)
        total = np.vstack(mats["gram"].to_numpy()).sum(axis=0)
        size = int(round(len(total) ** 0.5))
        gram, n = total.reshape(size, size), int(mats["n"].sum())
        best, best_aic = 0, np.inf
        for lag in range(own_lag + 1):
            use = fixed + [2] + list(range(4, 4 + lag))
            _, ssr, _ = _ols(gram, use, 3)
            aic = n * (np.log(2 * np.pi) + np.log(max(ssr, 1e-300) / n) + 1) + 2 * len(use)
            if aic < best_aic - 1e-12:
                best, best_aic = lag, aic
        gram = gram.copy()
        head = pdf[(pdf["at"] >= best)]
        for v in head["gram"]:
            v = np.asarray(v)
            gram += np.outer(v, v)
        n += len(head)
        use = fixed + [2] + list(range(4, 4 + best))
        beta, ssr, inverse = _ols(gram, use, 3)
        at = use.index(2)
        variance = ssr / (n - len(use)) * inverse[at, at]
        stat = float(beta[at] / np.sqrt(variance)) if variance > 0 else None
        return pd.DataFrame([(*key, stat, best, n)], columns=schema.names)

    if keys:
        solved = pieces.groupBy(*keys).applyInPandas(solve, schema)
    else:
        def solve_all(pdf: pd.DataFrame) -> pd.DataFrame:
            return solve((), pdf)

        solved = pieces.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(solve_all, schema)
    inv = 1 / F.col("n_obs")
    points = {
        f"crit_{name.rstrip('%')}": _poly_low_first(c, inv)
        for name, c in MACKINNON[regression]["critical"].items()
    }
    return solved.withColumn("adf_pvalue", mackinnon_p(F.col("adf_stat"), regression)).withColumns({
        **points, "adf_stationary": F.col("adf_pvalue") < 0.05,
    })


def kpss_test(df: DataFrame, column: str, regression: str = "ct", *, by: Series, size: int = BLOCK_VALUES) -> DataFrame:
    """(keys, kpss_stat, kpss_pvalue, kpss_lags, kpss_stationary).

    Automatic bandwidth after Hobijn et al.  The series lies in blocks: lag sums are products of a block with itself and
    the values before it, summed with their Bartlett weights inside the block; running sums are block sums and, of each
    block, three numbers.
    """
    keys = list(by.keys)
    x = df.select(*keys, by.order, *by.ties, F.col(column).cast("double").alias("_y")).filter("_y IS NOT NULL")
    blocks = materialise(series_blocks(x, ["_y"], by=by, size=size).select(*keys, *PLACE, "_y"))
    n, middle = F.col("_n").cast("double"), (F.col("_n") - 1) / F.lit(2.0)

    @F.pandas_udf("total double, tilt double")
    def moments(y: pd.Series, start: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [(v.sum(), (np.arange(a, a + len(v)) - (k - 1) / 2) @ v) for v, a, k in zip(y, start, n, strict=True)]
        return pd.DataFrame(rows, columns=["total", "tilt"])

    line = blocks.select(*keys, "_n", moments("_y", "_from", "_n").alias("_m")).groupBy(*keys, "_n").agg(
        F.sum("_m.total").alias("_total"), F.sum("_m.tilt").alias("_tilt"))
    slope = F.try_divide(12 * F.col("_tilt"), n * (n * n - 1)) if regression == "ct" else F.lit(0.0)
    line = line.select(*keys, (F.col("_total") / n).alias("_mean"), F.coalesce(slope, F.lit(0.0)).alias("_slope"))
    resid = _join_keys(blocks, line, keys).withColumn("_e", F.transform("_y", lambda y, i: y - F.col("_mean") - F.col("_slope") * (
        F.col("_from") + i - middle))).select(*keys, *PLACE, "_e")
    resid = materialise(resid)

    longest = by.rows_bound if by.rows_bound is not None else longest_series(x, keys)
    spread = int(longest ** (2 / 9) + 1e-12) if longest else 1
    near = with_reach(resid, keys, {"e": F.col("_e")}, spread + 1, size)
    sums = near.select(*keys, "_n", _weighted_lag_sums()("_near_e", "_lo", "_from", "_to", F.floor(
        F.pow(n, F.lit(2 / 9)) + 1e-12).cast("long")).alias("_l")).groupBy(*keys, "_n").agg(
        (F.sum("_l.plain") / n).alias("s0"), (F.sum("_l.by_lag") / n).alias("s1"))
    ratio = F.try_divide(F.col("s1"), F.col("s0"))
    gamma = 1.1447 * F.pow(ratio * ratio, F.lit(1 / 3))
    lags = F.least(F.floor(F.coalesce(gamma, F.lit(0.0)) * F.pow(n, F.lit(1 / 3))), F.col("_n") - 1)
    width = materialise(sums.select(*keys, lags.cast("long").alias("m")))

    reach = width.agg(F.max("m")).first()[0] or 0  # one number: the widest bandwidth
    wide = with_reach(_join_keys(resid, width, keys), keys, {"e": F.col("_e")}, int(reach) + 1, size)
    parts = wide.select(*keys, "_n", "m", "_block", _weighted_lag_sums()("_near_e", "_lo", "_from", "_to", "m").alias("_l"),
                        _running_parts()("_e").alias("_r"))
    earlier = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_r.total").over(earlier), F.lit(0.0)))
    squares = F.col("_r.squares") + 2 * F.col("_before") * F.col("_r.sums") + F.col("_r.count") * F.col("_before") * F.col("_before")
    out = parts.groupBy(*keys, "_n", "m").agg(F.sum(squares).alias("eta"), F.sum("_l.bartlett").alias("lrv"))
    stat = F.try_divide(F.col("eta") / (n * n), F.col("lrv") / n)
    return out.withColumn("kpss_stat", stat).select(
        *keys, "kpss_stat", kpss_p(F.col("kpss_stat"), regression).alias("kpss_pvalue"),
        F.col("m").alias("kpss_lags"),
    ).withColumn("kpss_stationary", F.col("kpss_pvalue") > 0.05)


def _weighted_lag_sums():
    """Of a block: the sums of products with the values up to ``most`` rows before, lag 0 once and the others twice: plain,
    times the lag, and with Bartlett weights."""
    @F.pandas_udf("plain double, by_lag double, bartlett double")
    def compute(near: pd.Series, lo: pd.Series, start: pd.Series, stop: pd.Series, most: pd.Series) -> pd.DataFrame:
        rows = []
        for e, first, a, b, m in zip(near, lo, start, stop, most, strict=True):
            own = e[a - first: b - first]
            products = [own @ own]
            for k in range(1, m + 1):
                back = max(first - (a - k), 0)  # a product needs a value k rows before
                products.append(2 * own[back:] @ e[a - k + back - first: max(b - k, a - k + back) - first] if back < len(own) else 0.0)
            products, lag = np.array(products), np.arange(m + 1)
            rows.append((products.sum(), (products * lag).sum(), (products * (1 - lag / (m + 1))).sum()))
        return pd.DataFrame(rows, columns=["plain", "by_lag", "bartlett"])

    return compute


def _running_parts():
    """Of a block, for its running sums s: their number, their sum, the sum of their squares, and the last one."""
    @F.pandas_udf("count long, sums double, squares double, total double")
    def compute(e: pd.Series) -> pd.DataFrame:
        rows = []
        for v in e:
            s = np.cumsum(v)
            rows.append((len(s), s.sum(), s @ s, s[-1] if len(s) else 0.0))
        return pd.DataFrame(rows, columns=["count", "sums", "squares", "total"])

    return compute


def _join_keys(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        one = facts.first()
        kinds = {f.name: f.dataType for f in facts.schema}
        return rows.withColumns({c: F.lit(one[c] if one else None).cast(kinds[c]) for c in facts.columns})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    named = facts.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    return rows.join(named, same).drop(*[f"_k{i}" for i in range(len(keys))])


def kpss_p(stat: Column, regression: str) -> Column:
    """Linear interpolation in the table, clipped to its ends."""
    points = KPSS_POINTS[regression]
    out = F.when(stat <= points[0], KPSS_P[0])
    for i in range(3):
        a, b, pa, pb = points[i], points[i + 1], KPSS_P[i], KPSS_P[i + 1]
        out = out.when(stat <= b, pa + (stat - a) / (b - a) * (pb - pa))
    return out.when(stat.isNotNull(), KPSS_P[3])


def verdict(adf: Column, kpss: Column) -> Column:
    """Two-by-two reading of both tests."""
    return (
        F.when(adf & kpss, "Stationary").when(adf & ~kpss, "Difference Stationary")
        .when(~adf & kpss, "Trend Stationary").otherwise("Non-stationary")
    )


def model_verdict(adf: Column, kpss: Column) -> Column:
    return F.when(adf & kpss, "STATIONARY").when(~adf & ~kpss, "NON-STATIONARY").otherwise("INCONCLUSIVE")


def stationarity_tests(df: DataFrame, column: str, regression: str = "ct", *, by: Series) -> DataFrame:
    """ADF and KPSS of every series with both verdicts."""
    keys = list(by.keys)
    a = adf_test(df, column, regression, by=by)
    k = kpss_test(df, column, regression, by=by)
    joined = join_groups(a, k, keys)
    yes_a, yes_k = F.col("adf_stationary"), F.col("kpss_stationary")
    return joined.withColumns({
        "stationarity_type": verdict(yes_a, yes_k), "conclusion": model_verdict(yes_a, yes_k),
        "tests_agree": yes_a == yes_k,
    })


def make_stationary(df: DataFrame, columns: list[str], *, by: Series) -> DataFrame:
    """Differences, per series and column, what both tests call non-stationary,
    then drops rows with any missing value; other columns are carried along."""
    keys = list(by.keys)
    df = materialise(df)  # read by both tests of every column and by the differences
    verdicts = None
    for c in columns:
        v = stationarity_tests(df.select(*keys, by.order, *by.ties, c), c, "c", by=by).select(
            *keys, (F.col("conclusion") == "NON-STATIONARY").alias(f"_diff_{c}")
        )
        if verdicts is None:
            verdicts = v
        else:
            verdicts = verdicts.join(v, keys, "full_outer") if keys else join_groups(verdicts, v, [])
    moved = over_frames(df, by, 1, 0, lambda w: {
        f"_d_{c}": F.col(c) - F.lag(c, 1).over(w) for c in columns
    })
    if keys:
        judged = moved.join(verdicts, keys, "left")
    else:
        one = verdicts.first()
        judged = moved.withColumns({f"_diff_{c}": F.lit(bool(one[f"_diff_{c}"])) for c in columns})
    changed = {
        c: F.when(F.coalesce(F.col(f"_diff_{c}"), F.lit(False)), F.col(f"_d_{c}")).otherwise(F.col(c))
        for c in columns
    }
    return judged.withColumns(changed).select(*df.columns).na.drop("any", subset=columns)


def prepare_time_series(
    df: DataFrame, target: str, exog: list[str], stationary: bool = True, *, by: Series
) -> DataFrame:
    """(keys, order, target, exog...): the target rides in the row, so it stays
    aligned with the rows the differencing keeps."""
    rows = df.select(*by.keys, by.order, *by.ties, target, *exog)
    return make_stationary(rows, exog, by=by) if stationary else rows


# --- residuals ----------------------------------------------------------------

def residual_diagnosis(
    df: DataFrame, column: str, ljung_box_lags: int = 10, shapiro_rows: int = 5000, *, by: Series,
    min_rows: int = 50,
) -> DataFrame:
    """One row per series: moments, Ljung-Box summary, Jarque-Bera and (for up
    to ``shapiro_rows`` rows) Shapiro-Wilk.  Series below ``min_rows`` are left out."""
    keys = list(by.keys)
    clean = df.select(*keys, by.order, *by.ties, F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    if not keys:
        raise ValueError("residual diagnosis needs a series key; add a constant one for a single site")
    sized = with_series_facts(clean, by, {"_n": F.count("v")}).filter(F.col("_n") >= min_rows)
    v = F.col("v")
    stats = sized.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        skew_adjusted(v).alias("skewness"), kurt_adjusted(v).alias("kurtosis"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    lb = ljung_box_summary(ljung_box(sized.drop("_n"), "v", ljung_box_lags, by=by), keys)
    jb = moment_tests(sized, keys).select(*keys, "JB_Stat", "JB_P")
    sw = shapiro_wilk(sized.filter(F.col("_n") <= shapiro_rows).drop("_n"), keys, shapiro_rows)
    return stats.join(lb, keys).join(jb, keys).join(sw, keys, "left").withColumns({
        "jb_normal": F.col("JB_P") > 0.05, "shapiro_normal": F.col("Shapiro_P") > 0.05,
    })


def decomposition_quality(diagnosis: DataFrame) -> DataFrame:
    """Good / Moderate / Poor from the residual autocorrelation."""
    clean, lags = F.col("autocorr_clean"), F.col("significant_lags")
    quality = F.when(clean & (lags < 5), "Good").when(clean | (lags < 10), "Moderate").otherwise("Poor")
    return diagnosis.withColumn("overall_quality", quality)


def synthesis(
    tests: DataFrame, acf_table: DataFrame, orders: DataFrame, keys: Sequence[str],
    periods: Sequence[int] = (), quality: DataFrame | None = None,
) -> DataFrame:
    """One recommendation record per series.

    Differencing follows the verdict (a series is stationary only when both
    tests say so)."""
    keys = list(keys)
    sig = F.col("significant")
    lag_facts = acf_table.groupBy(*keys).agg(
        F.slice(F.array_sort(F.collect_list(F.when(sig, F.col("lag")))), 1, 5).alias("significant_lags"),
        F.count_if(sig).alias("significant_lag_count"),
    )
    near = lags_near_periods(acf_table, periods).groupBy(*keys).agg(F.count(F.lit(1)).alias("_near"))
    out = tests.select(*keys, "stationarity_type").join(lag_facts, keys).join(
        orders.select(*keys, "seasonal_periods", "suggested_models", "methodology"), keys
    ).join(near, keys, "left")
    if quality is not None:
        out = out.join(quality.select(*keys, "overall_quality"), keys, "left")
    else:
        out = out.withColumn("overall_quality", F.lit(None).cast("string"))
    steady = F.col("stationarity_type") == "Stationary"
    seasonal = F.size("seasonal_periods") > 0
    near_count = F.coalesce("_near", F.lit(0)) if periods else F.lit(0)
    listed = F.array_join(F.col("seasonal_periods").cast("array<string>"), ", ")
    named = ", ".join(str(p) for p in periods)
    advice = F.array_compact(F.array(
        F.when(steady, "arma").otherwise("arima with one difference"),
        F.when(seasonal, "sarima for the given periods" if periods else "sarima for the periods found"),
        F.when(seasonal & F.lit(bool(periods)), F.lit(f"given periods: {named}")),
        F.when(seasonal, F.concat(F.lit("all seasonal periods: "), listed)),
        F.when(F.col("overall_quality") == "Good", "decomposition explains most of the series")
        .when(F.col("overall_quality").isNotNull(), "residuals ask for more ar or ma terms"),
        F.when(F.lit(bool(periods)), F.concat(F.lit("significant lags near given periods: "), near_count.cast("string"))),
    ))
    return out.select(
        *keys, "stationarity_type", (~steady).alias("differencing_needed"), "significant_lags",
        "significant_lag_count", near_count.cast("long").alias("lags_near_periods"), "seasonal_periods",
        "suggested_models", "methodology", "overall_quality", advice.alias("model_recommendations"),
    )

"""ACF, PACF, Ljung-Box, lags near periods, order suggestions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.functions.ordering import Series, over_frames
from pluvia.functions.tails import chi2_sf
from pluvia.operators.profile import with_series_facts

# Normal 97.5 % point; tolerance and default periods of the lag rules.
Z975 = 1.959963984540054
NEAR_PERIOD = 5
KNOWN_PERIODS = [7, 14, 30, 365]


def lag_budget(periods: Sequence[int] = ()) -> dict:
    """Largest lag worth looking at and the seasonal periods among those given."""
    if not periods:
        return {"has_periods": False, "max_lags": 100, "seasonal_periods": [], "periods": []}
    top = max(periods)
    return {
        "has_periods": True, "max_lags": min(top + max(20, top // 4), 200),
        "seasonal_periods": [p for p in periods if p >= 7], "periods": list(periods),
    }


def lag_products(df: DataFrame, column: str, max_lag: int, *, by: Series) -> DataFrame:
    """(keys, lag, n, product): sums of centred x_t x_{t-lag} for lag 0..max_lag.

    One window hands every row its predecessors; each lag is one sum of the same
    aggregate, so no row is repeated and the shuffle carries max_lag + 1 numbers
    per key and task.
    """
    rows = with_series_facts(
        df.select(*by.keys, by.order, *by.ties, F.col(column).cast("double").alias("_x"))
        .filter("_x IS NOT NULL"),
        by, {"_mean": F.avg("_x"), "n": F.count("_x")},
    ).withColumn("_c", F.col("_x") - F.col("_mean"))
    past = over_frames(rows, by, max_lag, 0, lambda w: {
        "_past": F.collect_list("_c").over(w.rowsBetween(-max_lag, 0))
    })
    back = past.select(*by.keys, "n", "_c", F.reverse("_past").alias("_b"))
    sums = back.groupBy(*by.keys, "n").agg(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.sum(F.col("_c") * F.get("_b", F.lit(k))).alias("product"))
        for k in range(max_lag + 1)
    ]).alias("_s"))
    return sums.select(*by.keys, "n", F.inline("_s")).filter("product IS NOT NULL")


def acf(df: DataFrame, column: str, max_lag: int, *, by: Series) -> DataFrame:
    """(keys, lag, n, r, half_band, significant) for lag 0..min(max_lag, n/4).

    The band is Bartlett's: (1 + 2 sum of earlier squared r) / n.
    """
    products = lag_products(df, column, max_lag, by=by)
    keys = list(by.keys)
    w = Window.partitionBy(*keys).orderBy("lag")
    r = products.withColumn(
        "r", F.try_divide(F.col("product"), F.first("product").over(w))
    ).withColumn("_sq", F.when(F.col("lag") > 0, F.col("r") * F.col("r")).otherwise(0.0))
    earlier = F.coalesce(F.sum("_sq").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    half = F.when(F.col("lag") == 0, 0.0).otherwise(Z975 * F.sqrt((1 + 2 * earlier) / F.col("n")))
    return r.withColumn("half_band", half).filter(F.col("lag") <= F.floor(F.col("n") / 4)).select(
        *keys, "lag", "n", "r", "half_band",
        ((F.col("lag") > 0) & (F.abs("r") > F.col("half_band"))).alias("significant"),
    )


def _partial_from_acov(acov: np.ndarray) -> np.ndarray:
    """Durbin-Levinson recursion: partial autocorrelations of lags 0..m."""
    m = len(acov) - 1
    out = np.ones(m + 1)
    phi = np.zeros(0)
    error = acov[0]
    for k in range(1, m + 1):
        a = (acov[k] - phi @ acov[k - 1:0:-1][: k - 1]) / error if error != 0 else np.nan
        phi = np.append(phi - a * phi[::-1], a)
        error *= 1 - a * a
        out[k] = a
    return out


def pacf(df: DataFrame, column: str, max_lag: int, *, by: Series) -> DataFrame:
    """(keys, lag, n, r, half_band, significant) by Yule-Walker with n - k divisors.

    Only the max_lag + 1 products of a key reach the recursion."""
    products = lag_products(df, column, max_lag, by=by)
    keys = list(by.keys)
    usable = products.filter(F.col("lag") <= F.floor(F.col("n") / 4))
    acov = usable.groupBy(*keys, "n").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("lag", (F.col("product") / (F.col("n") - F.col("lag"))).alias("a")))),
        lambda s: s["a"],
    ).alias("acov"))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("n", T.LongType()),
                           T.StructField("partial", T.ArrayType(T.DoubleType()))])

    def recurse(batches):
        for pdf in batches:
            partial = [_partial_from_acov(np.asarray(a, float)).tolist() for a in pdf.pop("acov")]
            yield pdf.assign(partial=partial)

    out = acov.mapInPandas(recurse, schema).select(*keys, "n", F.posexplode("partial").alias("lag", "r"))
    half = F.when(F.col("lag") == 0, 0.0).otherwise(Z975 / F.sqrt("n"))
    return out.withColumn("half_band", half).select(
        *keys, "lag", "n", "r", "half_band",
        ((F.col("lag") > 0) & (F.abs("r") > F.col("half_band"))).alias("significant"),
    )


def lags_near_periods(lags: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Significant lags within five days of one of the periods (all without periods)."""
    kept = lags.filter("significant")
    if not periods:
        return kept
    near = F.lit(False)
    for p in periods:
        near = near | (F.abs(F.col("lag") - p) <= NEAR_PERIOD)
    return kept.filter(near)


def ljung_box(df: DataFrame, column: str, lags: int = 10, *, by: Series) -> DataFrame:
    """(keys, lag, n, lb_stat, lb_pvalue): Q cumulated over lags, chi-square tail."""
    keys = list(by.keys)
    products = lag_products(df, column, lags, by=by)
    w = Window.partitionBy(*keys).orderBy("lag")
    r = F.try_divide(F.col("product"), F.first("product").over(w))
    part = products.withColumn("r", r).withColumn(
        "_q", F.when(F.col("lag") > 0, F.col("r") * F.col("r") / (F.col("n") - F.col("lag"))).otherwise(0.0)
    )
    n = F.col("n").cast("double")
    q = n * (n + 2) * F.sum("_q").over(w)
    return part.withColumn("lb_stat", q).filter("lag > 0").select(
        *keys, "lag", "n", "lb_stat", chi2_sf(F.col("lb_stat"), F.col("lag")).alias("lb_pvalue")
    )


def ljung_box_summary(lb: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lags with p < .05, the first of them, and the smallest p."""
    hit = F.col("lb_pvalue") < 0.05
    return lb.groupBy(*keys).agg(
        F.count_if(hit).alias("significant_lags"),
        F.min(F.when(hit, F.col("lag"))).alias("first_significant_lag"),
        F.min("lb_pvalue").alias("min_pvalue"),
    ).withColumns({
        "autocorr_clean": F.col("significant_lags") == 0, "is_random": F.col("min_pvalue") > 0.05,
    })


def ljung_box_legacy_lags(rows: int) -> int:
    return min(20, rows // 4)


def _first_lags(condition: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(condition, F.col("lag"))))


def suggest_orders(
    acf_table: DataFrame, pacf_table: DataFrame, periods: Sequence[int] = (), keys: Sequence[str] = ()
) -> DataFrame:
    """Seasonal ARIMA orders per series from its significant lags.

    The AR and MA orders count up to three of the first lags; the season is the longest
    given period of a week or more, else a known period within two lags.
    """
    keys = list(keys)
    budget = lag_budget(periods)
    seasonal = budget["seasonal_periods"]
    tagged = acf_table.select(*keys, "lag", "significant", F.lit("acf").alias("src")).unionByName(
        pacf_table.select(*keys, "lag", "significant", F.lit("pacf").alias("src"))
    )
    lag, sig = F.col("lag"), F.col("significant")
    # The first known period within two lags claims the lag.
    claimed = F
    for p in KNOWN_PERIODS:
        claimed = claimed.when(sig & (F.abs(lag - p) <= 2), p)
    found = tagged.groupBy(*keys).agg(
        _first_lags(sig & (F.col("src") == "acf")).alias("acf_lags"),
        _first_lags(sig & (F.col("src") == "pacf")).alias("pacf_lags"),
        F.array_sort(F.collect_set(claimed)).alias("_known"),
    )
    order_p = F.when(F.size("pacf_lags") > 0, F.least(F.size("pacf_lags"), F.lit(3))).otherwise(1)
    order_q = F.when(F.size("acf_lags") > 0, F.least(F.size("acf_lags"), F.lit(3))).otherwise(1)
    all_periods = F.array(*[F.lit(p) for p in seasonal]) if seasonal else F.col("_known")
    out = found.withColumns({
        "ar_order": order_p, "ma_order": order_q, "seasonal_periods": all_periods,
    }).withColumn("season_length", F.coalesce(F.array_max("seasonal_periods"), F.lit(0))).withColumn(
        "seasonal_ar", (F.col("season_length") > 0).cast("int")
    ).withColumn("seasonal_ma", F.col("seasonal_ar"))

    def model(d: int) -> Column:
        plain = F.format_string(f"ARIMA(%d,{d},%d)", "ar_order", "ma_order")
        with_season = F.format_string(
            f"SARIMA(%d,{d},%d)x(%d,{d},%d,%d)", "ar_order", "ma_order", "seasonal_ar", "seasonal_ma", "season_length"
        )
        return F.when(F.col("season_length") > 0, with_season).otherwise(plain)

    models = [model(1), model(0)]
    if len(seasonal) > 1:
        second = sorted(seasonal, reverse=True)[1]
        models.append(F.format_string(f"SARIMA(%d,1,%d)x(1,1,1,{second})", "ar_order", "ma_order"))
    return out.select(
        *keys, "ar_order", "ma_order", "seasonal_ar", "seasonal_ma", "season_length", "seasonal_periods", F.array(*models).alias("suggested_models"),
        F.lit("theory_driven" if budget["has_periods"] else "traditional").alias("methodology"),
    )

"""Trend and multiple seasons by loess (STL repeated per season, MSTL).

A series lies in blocks of consecutive values (``functions.blocks``).  The filters of the method (cycles of one period,
their low-pass part, trend) are weighted row-frame filters (``operators.loess``) of a known reach.  Spark hands every block
the values that the next rounds of filters reach into (as many rounds as keep that within a quarter of a block), and the
block's rounds are dot products.  So a series may have any length; what a task holds is a block and its reach.
Data-dependent steps (robustness weights) are aggregates by series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions.blocks import BLOCK_VALUES, block_rows, minus, plus, series_blocks, with_reach
from pluvia.functions.ordering import Series, exact_percentiles
from pluvia.functions.storage import materialise
from pluvia.operators import loess
from pluvia.operators.features import create_lag_features, create_rolling_features, stabilise_variance


def default_windows(count: int) -> list[int]:
    return [7 + 4 * i for i in range(1, count + 1)]


def _odd_from(x: int) -> int:
    return x if x % 2 else x + 1


def _robustness(blocks: DataFrame, keys: list[str], rest: str) -> DataFrame:
    """Adds ``_rho``: bisquare weights of the misfit, by six times its median over the series."""
    miss = F.zip_with(rest, F.zip_with("_season", "_level", lambda s, v: s + v), lambda y, f: F.abs(y - f))
    missed = materialise(blocks.drop("_rho").withColumn("_miss", miss))
    one = [] if keys else ["_all"]
    rows = missed.withColumn("_all", F.lit(0)).select(*keys, *one, F.explode("_miss").alias("_v"))
    caps = exact_percentiles(rows, [*keys, *one], "_v", {"_median": 0.5})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    caps = caps.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (6 * F.col("_median")).alias("_cap"))
    joined = missed.join(caps, same).drop(*[f"_k{i}" for i in range(len(keys))])

    def weight(m):
        cap = F.col("_cap")
        u = m / cap
        return F.when(cap <= 0, 1.0).when(m <= 0.001 * cap, 1.0).when(m <= 0.999 * cap, (1 - u * u) * (1 - u * u)).otherwise(0.0)

    return joined.withColumn("_rho", F.transform("_miss", weight)).drop("_miss", "_cap")


def stl_blocks(
    blocks: DataFrame, keys: Sequence[str], values: str, period: int, seasonal: int, trend: int | None = None,
    low_pass: int | None = None, seasonal_deg: int = 1, trend_deg: int = 1, low_pass_deg: int = 1, robust: bool = False,
    inner_iter: int | None = None, outer_iter: int | None = None, size: int = BLOCK_VALUES,
) -> DataFrame:
    """Adds ``_season`` and ``_level`` of one period to blocks of series (of more than two periods; zeros for others)."""
    keys = list(keys)
    nt = trend or _odd_from(math.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    nl = low_pass or _odd_from(period + 1)
    inner = inner_iter if inner_iter is not None else (2 if robust else 5)
    outer = outer_iter if outer_iter is not None else (15 if robust else 0)
    windows, degrees = (seasonal, nl, nt), (seasonal_deg, low_pass_deg, trend_deg)
    state = [c for c in blocks.columns if c not in keys]
    place = [F.col(c) for c in ("_lo", "_from", "_to", "_n")]
    out = blocks.withColumn("_level", F.transform(values, lambda _: F.lit(0.0)))
    reach = loess.step_reach(period, windows)
    # Rounds between two exchanges: so many that a block's reach stays within a quarter of it.
    together = max(1, min(inner, size // (4 * reach)))
    for round_no in range(outer + 1):
        for done in range(0, inner, together):
            rounds = min(together, inner - done)
            weighted = "_rho" in out.columns
            near = {"y": F.col(values), "v": F.col("_level")} | ({"w": F.col("_rho")} if weighted else {})
            met = with_reach(out, keys, near, rounds * reach, size)
            found = loess.seasonal_rounds(F.col("_near_y"), F.col("_near_v"), F.col("_near_w") if weighted else None, *place,
                                          rounds, period, windows, degrees)
            kept = [*keys, *state, *(["_rho"] if weighted else [])]
            out = met.select(*kept, found.alias("_found")).select(*kept, F.col("_found.season").alias("_season"), F.col("_found.level").alias("_level"))
        if round_no < outer:
            out = _robustness(out, keys, values)
    return out.drop("_rho")


def decompose(
    df: DataFrame,
    column: str,
    periods: Sequence[int],
    windows: Sequence[int] | None = None,
    lmbda: float | str | None = None,
    iterate: int = 2,
    *,
    by: Series,
    size: int = BLOCK_VALUES,
    **stl_options,
) -> DataFrame:
    """(keys, order, observed, trend, seasonal_1.., resid) of every series, of any length.

    Values are log1p-transformed first (``lmbda=None``) or Box-Cox transformed; components are on the transformed scale.
    Series too short for the shortest period (fewer than two cycles and a day) or with a value that is not finite are left
    out; periods of half a series or more are dropped, and its components then NULL from the last on.
    """
    keys = list(by.keys)
    present = df.select(*keys, by.order, *by.ties, F.col(column).cast("double").alias("_x")).filter("_x IS NOT NULL")
    shaped = stabilise_variance(present, "_x", lmbda, keys).withColumnRenamed("transformed", "observed")
    blocks = materialise(series_blocks(shaped, ["observed"], by=by, size=size))

    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    bad = blocks.filter(F.exists("observed", lambda x: ~finite(x))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    if windows is None:
        periods, windows = sorted(periods), default_windows(len(periods))
    chosen = sorted(zip(periods, windows, strict=False))
    state = blocks.join(bad, same, "left_anti").filter(F.col("_n") > 2 * chosen[0][0])
    nothing = F.transform("observed", lambda _: F.lit(0.0))
    names = [f"seasonal_{i + 1}" for i in range(len(chosen))]
    state = state.withColumns({"trend": nothing, "_rest": F.col("observed")} | {c: nothing for c in names})
    for round_no in range(1 if len(chosen) == 1 else iterate):
        for name, (period, window) in zip(names, chosen, strict=True):
            # A series with one usable period is done after one round.
            used = (F.col("_n") > 2 * period) & (F.lit(round_no == 0) | (F.col("_n") > 2 * chosen[min(1, len(chosen) - 1)][0]))
            state = state.withColumn("_sum", plus("_rest", name))
            state = stl_blocks(state, keys, "_sum", period, window, size=size, **stl_options)
            state = state.withColumns({
                "trend": F.when(used, F.col("_level")).otherwise(F.col("trend")),
                name: F.when(used, F.col("_season")).otherwise(F.col(name))})
            state = state.withColumn("_rest", F.when(used, minus("_sum", name)).otherwise(F.col("_rest")))
            state = materialise(state.drop("_sum", "_season", "_level"))
    dropped = {name: F.when(F.col("_n") > 2 * period, F.col(name)).otherwise(F.transform("observed", lambda _: F.lit(None).cast("double")))
               for name, (period, _) in zip(names, chosen, strict=True)}
    state = state.withColumns(dropped | {"resid": minus("_rest", "trend")})
    return block_rows(state, keys, [by.order, "observed", "trend", *names, "resid"])


def loess_smooth(df: DataFrame, column: str, window: int, degree: int = 1, *, by: Series, size: int = BLOCK_VALUES) -> DataFrame:
    """(keys, order, column, smooth): one loess pass over every series."""
    keys = list(by.keys)
    present = df.select(*keys, by.order, *by.ties, F.col(column).cast("double").alias(column)).filter(F.col(column).isNotNull())
    met = with_reach(series_blocks(present, [column], by=by, size=size), keys, {"y": F.col(column)}, window, size)
    smooth = loess.smooth(F.col("_near_y"), F.col("_lo"), F.col("_from"), F.col("_to"), F.col("_n"), window, degree)
    return block_rows(met.withColumn("smooth", smooth), keys, [by.order, column, "smooth"])


def residual_for_stationarity(
    df: DataFrame, column: str, periods: Sequence[int] = (7, 30, 365), *, by: Series
) -> DataFrame:
    return decompose(df, column, periods, by=by).select(*by.keys, by.order, "resid")


def create_mstl_features(
    df: DataFrame,
    components: DataFrame,
    lag_periods: list[int] | None = None,
    rolling_windows: list[int] | None = None,
    rolling_stats: list[str] | None = None,
    *,
    by: Series,
) -> DataFrame:
    """Joins trend, seasons and residual by series and date; optional lags and
    rolling statistics (mean by default) of the joined columns."""
    seasonal = [c for c in components.columns if c.startswith("seasonal_")]
    names = {"trend": "MSTL_Trend", "resid": "MSTL_Residual"}
    if len(seasonal) == 1:
        names[seasonal[0]] = "MSTL_Seasonal"
    else:
        names.update({c: f"MSTL_Seasonal_{i + 1}" for i, c in enumerate(seasonal)})
    on = [*by.keys, by.order]
    parts = components.select(*on, *[F.col(c).alias(n) for c, n in names.items()])
    out = df.join(parts, on, "left")
    made = list(names.values())
    if lag_periods is not None:
        out = create_lag_features(out, made, lag_periods, by=by)
    if rolling_windows is not None:
        out = create_rolling_features(out, made, rolling_windows, rolling_stats or ["mean"], by=by)
    return out

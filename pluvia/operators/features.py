"""Calendar, lag, rolling and sequence features; row transforms of one series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia import constants as C
from pluvia.functions.ordering import Series, over_frames, with_positions
from pluvia.functions.storage import materialise
from pluvia.functions.stats import aggregate, box_cox, safe_corr_over

FRAME_STATS = ("mean", "std", "min", "max", "sum")


def _on_circle(turn: Column) -> Column:
    return F.lit(2 * math.pi) * turn


def _month_turn(day: Column) -> Column:
    return _on_circle(F.month(day)) / 12


def _year_turn(day: Column) -> Column:
    return _on_circle(F.dayofyear(day)) / 365.25


CALENDAR_FEATURES = {
    "Year": F.year,
    "Month": F.month,
    "DayofMonth": F.dayofmonth,
    "DayofYear": F.dayofyear,
    "Month_sin": lambda d: F.sin(_month_turn(d)),
    "Month_cos": lambda d: F.cos(_month_turn(d)),
    "DayOfYear_sin": lambda d: F.sin(_year_turn(d)),
    "DayOfYear_cos": lambda d: F.cos(_year_turn(d)),
}
DEFAULT_CALENDAR = ("Month_sin", "Month_cos", "DayOfYear_sin", "DayOfYear_cos", "Is_Wet_Season")


def create_temporal_features(
    df: DataFrame,
    date_col: str = C.DATE_LABEL,
    features_to_create: list[str] | tuple[str, ...] = DEFAULT_CALENDAR,
    wet_season_months: list[int] | None = None,
) -> DataFrame:
    """Calendar and cyclic columns; unknown names are skipped."""
    day = F.col(date_col)
    if isinstance(df.schema[date_col].dataType, T.StringType):
        day = F.to_date(day)
    wet = F.month(day).isin(wet_season_months or C.WET_MONTHS).cast("int")
    makers = {**CALENDAR_FEATURES, "Is_Wet_Season": lambda _: wet}
    return df.withColumns({f: makers[f](day) for f in features_to_create if f in makers})


def add_calendar_columns(df: DataFrame, date_col: str, only_absent: bool = False) -> DataFrame:
    """Month, Year, DayOfYear."""
    day = F.col(date_col)
    parts = {"Month": F.month(day), "Year": F.year(day), "DayOfYear": F.dayofyear(day)}
    return df.withColumns({
        n: c for n, c in parts.items() if not (only_absent and n in df.columns)
    })


def season_of(day: Column) -> Column:
    branches = F
    for season, months in C.SEASON_MONTHS.items():
        branches = branches.when(F.month(day).isin(months), season)
    return branches


def rain_band(x: Column) -> Column:
    """Key of the rain band; NULL for negative or missing amounts."""
    branches = F.when(x == 0, C.RAIN_BANDS[0][0])
    for key, lo, hi, *_ in C.RAIN_BANDS[1:]:
        inside = (x > lo) if math.isinf(hi) else (x > lo) & (x <= hi)
        branches = branches.when(inside, key)
    return branches


def rain_flag(x: Column, threshold: float = C.RAIN_THRESHOLD) -> Column:
    return (x > threshold).cast("int")


def create_lag_features(
    df: DataFrame,
    columns_to_lag: str | list[str],
    lags: list[int],
    suffix: str = "lag",
    *,
    by: Series,
) -> DataFrame:
    """``{col}_{suffix}_{k}`` = value k rows earlier (negative k looks ahead)."""
    names = [columns_to_lag] if isinstance(columns_to_lag, str) else list(columns_to_lag)
    names = [c for c in names if c in df.columns]
    back, ahead = max([0, *lags]), max([0, *[-k for k in lags]])
    return over_frames(df, by, back, ahead, lambda w: {
        f"{c}_{suffix}_{k}": F.lag(c, k).over(w) for c in names for k in lags
    })


def full_frame(stat: str, c: Column, w, first: int, last: int) -> Column:
    """Window statistic, NULL unless every row of the frame exists and has a value."""
    frame = w.rowsBetween(first, last)
    return F.when(F.count(c).over(frame) == last - first + 1, aggregate(stat, c).over(frame))


def create_rolling_features(
    df: DataFrame,
    columns_to_roll: str | list[str],
    windows: list[int],
    stats: list[str] | tuple[str, ...] = FRAME_STATS,
    *,
    by: Series,
) -> DataFrame:
    """``{col}_{stat}_{w}d`` over the last w rows including the current one."""
    names = [columns_to_roll] if isinstance(columns_to_roll, str) else list(columns_to_roll)
    return over_frames(df, by, max(windows, default=1) - 1, 0, lambda w: {
        f"{c}_{stat}_{n}d": full_frame(stat, F.col(c), w, 1 - n, 0)
        for c in names if c in df.columns
        for n in windows for stat in stats if stat in FRAME_STATS
    })


def detrend_centred(df: DataFrame, column: str, window: int = 30, *, by: Series) -> DataFrame:
    """``detrended`` = value minus its centred window mean; rows without one are dropped.

    An even window covers window/2 rows back and window/2 - 1 ahead.
    """
    back, ahead = window // 2, (window - 1) // 2
    return over_frames(df, by, back, ahead, lambda w: {
        "detrended": F.col(column) - full_frame("mean", F.col(column), w, -back, ahead)
    }).filter(F.col("detrended").isNotNull())


def rolling_diagnostics(df: DataFrame, column: str, window: int, *, by: Series) -> DataFrame:
    """Rolling mean and std, the table behind a visual stationarity check."""
    return over_frames(df, by, window - 1, 0, lambda w: {
        "rolling_mean": full_frame("mean", F.col(column), w, 1 - window, 0),
        "rolling_std": full_frame("std", F.col(column), w, 1 - window, 0),
    })


def diagnostic_window(rows: int) -> int:
    return min(365, rows // 4)


def rolling_correlation(
    df: DataFrame, target: str, other: str, window: int = 30, *, by: Series
) -> DataFrame:
    """``rolling_corr`` over full windows of complete pairs."""
    complete = df.filter(F.col(target).isNotNull() & F.col(other).isNotNull())

    def build(w):
        frame = w.rowsBetween(1 - window, 0)
        r = safe_corr_over(F.col(target), F.col(other), frame)
        return {"rolling_corr": F.when(F.count(F.lit(1)).over(frame) == window, r)}

    return over_frames(complete, by, window - 1, 0, build)


def first_difference(df: DataFrame, columns: str | list[str], *, by: Series) -> DataFrame:
    names = [columns] if isinstance(columns, str) else list(columns)
    return over_frames(df, by, 1, 0, lambda w: {
        f"{c}_diff": F.col(c) - F.lag(c, 1).over(w) for c in names
    })


def build_sequences(
    df: DataFrame, features: list[str], target: str, length: int = 7, *, by: Series
) -> DataFrame:
    """``steps`` = features of the previous ``length`` rows, oldest first; short ones dropped."""
    step = F.array(*[F.col(c).cast("double") for c in features])
    out = over_frames(df, by, length, 0, lambda w: {
        "steps": F.collect_list(step).over(w.rowsBetween(-length, -1))
    })
    return out.filter(F.size("steps") == length).select(
        *by.keys, by.order, "steps", F.col(target).alias("target")
    )


def recent_rows(df: DataFrame, rows: int, *, by: Series) -> DataFrame:
    """The last ``rows`` rows of every series; of equal places the last by the tie breakers.

    A short series is ranked from its end; any other is numbered in pieces and cut by its number of rows."""
    if by.keys and by.rows_bound is not None and by.rows_bound <= by.block_rows:
        newest = Window.partitionBy(*by.keys).orderBy(*[F.col(c).desc_nulls_last() for c in (by.order, *by.ties)])
        return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= rows).drop("_rn")
    placed = with_positions(df, by)
    if not by.keys:
        return placed.filter(F.col("_pos") >= df.count() - rows).drop("_pos")
    sizes = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by.keys)]).agg(F.count(F.lit(1)).alias("_n"))
    on = F.lit(True)
    for i, k in enumerate(by.keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    kept = placed.join(sizes, on).filter(F.col("_pos") >= F.col("_n") - rows)
    return kept.drop("_pos", "_n", *[f"_k{i}" for i in range(len(by.keys))])


def stabilise_variance(
    df: DataFrame,
    column: str,
    lmbda: float | str | None = None,
    keys: list[str] | tuple[str, ...] = (),
    grid: tuple[float, float, int] = (-2.0, 2.0, 401),
) -> DataFrame:
    """``transformed`` (and ``lam``): log1p, Box-Cox with a given lambda, or "auto".

    "auto" replaces zeros by 1e-8 when a series has any, then takes the lambda
    of the grid with the highest Box-Cox log-likelihood per series.
    """
    x = F.col(column)
    if lmbda is None:
        return df.withColumns({"transformed": F.log1p(x), "lam": F.lit(None).cast("double")})
    if lmbda != "auto":
        fixed = float(lmbda)
        return df.withColumns({
            "transformed": F.when(x > 0, box_cox(x, fixed)), "lam": F.lit(fixed)
        })
    positive = F.when(x == 0, F.lit(1e-8)).when(x > 0, x)
    best = box_cox_lambda(df, column, keys, grid)
    shaped = F.when(F.abs("lam") < 1e-12, F.log(positive)).otherwise(
        (F.pow(positive, F.col("lam")) - 1) / F.when(F.abs("lam") < 1e-12, 1.0).otherwise(F.col("lam"))
    )
    if not keys:
        lam = best.first()["lam"]
        return df.withColumn("lam", F.lit(lam)).withColumn("transformed", shaped)
    return df.join(best, list(keys), "left").withColumn("transformed", shaped)


def box_cox_lambda(
    df: DataFrame, column: str, keys=(), grid: tuple[float, float, int] = (-2.0, 2.0, 401), per_pass: int = 16,
) -> DataFrame:
    """(keys, lam) maximising the profile log-likelihood over a grid of lambdas.

    The likelihood is concave in lambda: the variance is a sum of squares of integrals of exp(lambda t), each of which is
    log-convex.  So each pass evaluates ``per_pass`` grid points between the current bounds of every key, in one partial
    aggregate, and the bounds close in on the neighbours of the best one, until all points between them are evaluated.
    The points of a pass are worked out once for each key and not for each row.
    """
    keys = list(keys)
    lo, hi, points = grid
    x = F.col(column)
    positive = F.when(x == 0, F.lit(1e-8)).when(x > 0, x)
    step = (hi - lo) / (points - 1)
    rows = materialise(df.select(*keys, F.log(positive).alias("_l")).filter(F.col("_l").isNotNull()))
    spots = [F.col("_lo") + F.floor(F.lit(j) * (F.col("_hi") - F.col("_lo")) / (per_pass - 1)) for j in range(per_pass)]
    spread = [F.round(F.lit(lo) + i * step, 10).alias(f"_lam{j}") for j, i in enumerate(spots)]
    lams = [F.col(f"_lam{j}") for j in range(per_pass)]
    shaped = [F.when(F.abs(lam) < 1e-12, F.col("_l")).otherwise(
        (F.exp(lam * F.col("_l")) - 1) / F.when(F.abs(lam) < 1e-12, 1.0).otherwise(lam)) for lam in lams]
    everything = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("_lo"), F.lit(points - 1).cast("long").alias("_hi"))
    bounds, width = everything.select("_lo", "_hi", *spread), points - 1
    bound_keys = []
    while True:
        last = width + 1 <= per_pass
        fit = _with_bounds(rows, bound_keys, bounds).groupBy(*keys).agg(
            F.sum("_l").alias("sl"), F.count(F.lit(1)).alias("n"), *[F.var_pop(y).alias(f"v{j}") for j, y in enumerate(shaped)])
        tried = F.array(*[
            F.when(F.col(f"v{j}") > 0, F.struct(((lam - 1) * F.col("sl") - F.col("n") / 2 * F.log(f"v{j}")).alias("ll"),
                                                (-F.abs(lam)).alias("near"), lam.alias("lam"), i.alias("i")))
            for j, (lam, i) in enumerate(zip(lams, spots, strict=True))])
        best = _with_bounds(fit, bound_keys, bounds).select(
            *keys, "_lo", "_hi", F.array(*spots).alias("_spots"), F.array_max(F.array_compact(tried)).alias("_b")).filter("_b IS NOT NULL")
        if last:
            return best.select(*keys, F.col("_b.lam").alias("lam"))
        below = F.array_max(F.filter("_spots", lambda i: i < F.col("_b.i")))
        above = F.array_min(F.filter("_spots", lambda i: i > F.col("_b.i")))
        closer = best.select(*keys, F.coalesce(below, F.col("_lo")).alias("_lo"), F.coalesce(above, F.col("_hi")).alias("_hi"))
        bounds, bound_keys = materialise(closer.select(*keys, "_lo", "_hi", *spread)), keys
        width = 2 * -(-width // (per_pass - 1))


def _with_bounds(rows: DataFrame, keys: list[str], bounds: DataFrame) -> DataFrame:
    """Bounds and points to try, per key (for no keys: from one row) added to the rows; keys without bounds go."""
    facts = [c for c in bounds.columns if c not in keys]
    if not keys:
        one = bounds.first()
        return rows.withColumns({c: F.lit(one[c] if one else 0).cast(bounds.schema[c].dataType) for c in facts})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    named = bounds.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *facts)
    return rows.join(named, same).drop(*[f"_k{i}" for i in range(len(keys))])

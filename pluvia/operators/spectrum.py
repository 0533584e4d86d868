"""Periodogram and wavelet spectra per series.

Transforms run in groups of about the square root of a series (``operators.fourier``), wavelets in overlapping blocks
(``functions.blocks``), so a series of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.functions.blocks import PLACE, series_blocks, with_reach
from pluvia.functions.ordering import Series, longest_series, running_total, with_positions
from pluvia.operators.features import detrend_centred, recent_rows
from pluvia.operators.fourier import GROUP_VALUES, transform_series
from pluvia.operators.profile import with_series_facts

def periodogram(df: DataFrame, column: str, *, by: Series, group_values: int = GROUP_VALUES) -> DataFrame:
    """(keys, k, frequency, period, magnitude) of the positive frequencies, by grouped transforms at every length."""
    rows = df.select(*by.keys, by.order, *by.ties, F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    if not by.keys:
        by = replace(by, rows_bound=by.rows_bound or longest_series(rows, []))
    elif by.rows_bound is None:
        by = replace(by, rows_bound=longest_series(rows, by.keys))
    placed = with_positions(rows, by, "m")
    sized = with_series_facts(placed, by, {"_n": F.count("x")}).select(*by.keys, "_n", "m", "x")
    found = transform_series(sized, by.keys, by.rows_bound, group_values)
    n, k = F.col("_n").cast("double"), F.col("k")
    half = found.filter((k >= 1) & (k <= F.floor((F.col("_n") - 1) / 2)))
    return half.select(*by.keys, k.cast("int").alias("k"), (k / n).alias("frequency"), (n / k).alias("period"),
                       F.hypot("re", "im").alias("magnitude"))


def periodogram_by_sums(rows: DataFrame, column: str, *, by: Series) -> DataFrame:
    """The same table from sums of x cos and x sin per (key, k): quadratic, to hold the transforms against."""
    placed = running_total(rows, by, column, "_sum").drop("_sum")
    sized = with_series_facts(placed, by, {"_n": F.count(column)})
    last = F.floor((F.col("_n") - 1) / 2).cast("int")
    spread = sized.filter(last >= 1).withColumn("k", F.explode(F.sequence(F.lit(1), last)))
    # Reducing k * pos modulo n first keeps the angle exact for long series.
    angle = 2 * F.pi() * ((F.col("k").cast("long") * F.col("_pos")) % F.col("_n")) / F.col("_n")
    sums = spread.groupBy(*by.keys, "_n", "k").agg(
        F.sum(F.col(column) * F.cos(angle)).alias("c"), F.sum(F.col(column) * F.sin(angle)).alias("s")
    )
    n, k = F.col("_n").cast("double"), F.col("k")
    return sums.select(
        *by.keys, "k", (k / n).alias("frequency"), (n / k).alias("period"),
        F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("magnitude"),
    )


def detrended_spectrum(
    df: DataFrame, column: str, detrend_window: int = 30, min_rows: int = 730, *, by: Series
) -> DataFrame:
    """Periodogram of the centred-detrended series with at least ``min_rows`` values."""
    present = df.select(*by.keys, by.order, *by.ties, column).filter(F.col(column).isNotNull())
    long_enough = with_series_facts(present, by, {"_n": F.count(F.lit(1))}).filter(
        F.col("_n") >= min_rows
    ).drop("_n")
    flat = detrend_centred(long_enough, column, detrend_window, by=by)
    return periodogram(flat, "detrended", by=by)


def dominant_periods(
    spectrum: DataFrame, top_n: int = 10, period_range: tuple[int, int] = (7, 730),
    return_n: int = 10, keys: Sequence[str] = (),
) -> DataFrame:
    """(keys, rank, period_days): whole-day periods of the ``top_n`` strongest
    frequencies, filtered to the range afterwards, distinct, longest first."""
    keyed = spectrum if keys else spectrum.withColumn("_all", F.lit(0))
    groups = list(keys) or ["_all"]
    strongest = Window.partitionBy(*groups).orderBy(F.desc("magnitude"), F.desc("k"))
    peaks = keyed.withColumn("_rn", F.row_number().over(strongest)).filter(F.col("_rn") <= top_n)
    days = peaks.filter(F.col("period").between(*period_range)).select(
        *groups, F.bround("period").cast("int").alias("period_days")
    ).distinct()
    longest = Window.partitionBy(*groups).orderBy(F.desc("period_days"))
    out = days.withColumn("rank", F.row_number().over(longest)).filter(F.col("rank") <= return_n)
    return out.select(*keys, "rank", "period_days")


def power_table(spectrum: DataFrame, max_period: int = 365) -> DataFrame:
    """Power and log10 power of the periods up to ``max_period``."""
    power = F.col("magnitude") * F.col("magnitude")
    return spectrum.filter(F.col("period") <= max_period).withColumns({
        "power": power, "log_power": F.log10(power + 1e-12),
    })


def period_power(
    power: DataFrame, periods: DataFrame, keys: Sequence[str] = (), max_period: int = 365
) -> DataFrame:
    """Power at the bin nearest to each dominant period; 0 beyond ``max_period``, the table's own bound."""
    listed = periods.groupBy(*keys).agg(F.collect_list("period_days").alias("_p"))
    if keys:
        pairs = power.join(listed, list(keys))
    else:
        one = listed.first()["_p"]
        pairs = power.withColumn("_p", F.array(*[F.lit(p) for p in one]).cast("array<int>"))
    near = pairs.withColumn("period_days", F.explode("_p")).groupBy(*keys, "period_days").agg(
        F.min_by("log_power", F.struct(F.abs(F.col("period") - F.col("period_days")), F.col("k"))).alias("log_power"),
        F.max("period").alias("_top"),
    )
    return near.select(*keys, "period_days", F.when(
        F.col("period_days") <= max_period, F.col("log_power")
    ).otherwise(0.0).alias("log_power"))


# --- wavelets -----------------------------------------------------------------

def wavelet_scales(period_range: tuple[int, int] = (3, 365)) -> list[float]:
    lo, hi = max(1, period_range[0] // 2), min(200, period_range[1] // 2)
    return [float(s) for s in range(lo, hi, 2)]


def morlet_integral(level: int = 12) -> tuple[np.ndarray, float]:
    """Running integral of the real Morlet exp(-t^2/2) cos 5t on [-8, 8] and its step."""
    t, step = np.linspace(-8, 8, 2 ** level, retstep=True)
    return np.cumsum(np.exp(-t * t / 2) * np.cos(5 * t)) * step, step


def morlet_taps(s: float) -> tuple[np.ndarray, int]:
    """(taps, place): a coefficient is the sum of x[m] taps[t + place - m].

    The resampled integral is convolved with the data and differenced, which is one convolution with its differences."""
    integral, step = morlet_integral()
    at = (np.arange(s * 16 + 1) / (s * step)).astype(int)
    kernel = integral[at[at < len(integral)]][::-1]
    taps = -np.sqrt(s) * np.diff(np.concatenate(([0.0], kernel, [0.0])))
    return taps, max(len(kernel) - 2, 0) // 2 + 1


def complex_morlet_taps(s: float, n: int) -> tuple[np.ndarray, int]:
    """Taps of the complex Morlet (w = 5) for a series of ``n`` values, which bounds its width."""
    width = min(10 * s, n)
    t = (np.arange(0, width) - (width - 1.0) / 2) / s
    taps = np.conj((np.sqrt(1 / s) * np.exp(5j * t) * np.exp(-0.5 * t * t) * np.pi ** -0.25)[::-1])
    return taps, (len(taps) - 1) // 2


def convolved(x: np.ndarray, taps: np.ndarray, first: int, count: int) -> np.ndarray:
    """Values ``first`` to ``first + count`` of the full convolution, by a transform of the block; zeros beyond it."""
    size = len(x) + len(taps) - 1
    n_fft = 1 << max(size - 1, 1).bit_length()
    if np.iscomplexobj(taps):
        full = np.fft.ifft(np.fft.fft(x, n_fft) * np.fft.fft(taps, n_fft))[:size]
    else:
        full = np.fft.irfft(np.fft.rfft(x, n_fft) * np.fft.rfft(taps, n_fft), n_fft)[:size]
    out = np.zeros(count, full.dtype)
    a, b = max(first, 0), min(first + count, size)
    out[a - first: max(b, a) - first] = full[a: max(b, a)]
    return out


#: Values of a block in a wavelet transform; each scale's coefficients of a block are held at once.
WAVELET_BLOCK = 1 << 15


def _taps(scale: float, n: int, complex_: bool) -> tuple[np.ndarray, int]:
    return complex_morlet_taps(scale, n) if complex_ else morlet_taps(scale)


def _wavelet_blocks(df: DataFrame, column: str, rows: int | None, scales: list[float], by: Series, size: int) -> DataFrame:
    """Blocks of the last ``rows`` values of every series (None: all) with what the widest kernel reaches into."""
    present = df.select(*by.keys, by.order, *by.ties, F.col(column).cast("double").alias("_x")).filter("_x IS NOT NULL")
    recent = present if rows is None else recent_rows(present, rows, by=by)
    reach = int(16 * max(scales)) + 4
    return with_reach(series_blocks(recent, ["_x"], by=by, size=size), list(by.keys), {"x": F.col("_x")}, reach, size)


def _coefficients(x, lo: int, start: int, stop: int, n: int, scale: float, complex_: bool) -> np.ndarray:
    taps, place = _taps(scale, n, complex_)
    return convolved(np.asarray(x, float), taps, start + place - lo, stop - start)


def _cwt(df: DataFrame, column: str, rows: int | None, scales: list[float], complex_: bool, by: Series, size: int) -> DataFrame:
    """(keys, scale, order, coef, power): overlapping blocks are convolved with the kernel of each scale."""
    blocks = _wavelet_blocks(df, column, rows, scales, by, size)
    keys = list(by.keys)
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("scale", T.DoubleType()), df.schema[by.order],
        T.StructField("coef", T.DoubleType()), T.StructField("power", T.DoubleType()),
    ])

    def expand(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                for s in scales:
                    c = _coefficients(r["_near_x"], r["_lo"], r["_from"], r["_to"], r["_n"], s, complex_)
                    out = pd.DataFrame({"scale": s, by.order: r[by.order], "coef": c.real, "power": np.abs(c) ** 2})
                    yield out.assign(**{k: r[k] for k in keys})[schema.names]

    return blocks.select(*keys, *PLACE, "_lo", by.order, "_near_x").mapInPandas(expand, schema)


def wavelet_power(
    df: DataFrame, column: str, years: int | None = 3, period_range: tuple[int, int] = (3, 365),
    scales: list[float] | None = None, *, by: Series, size: int = WAVELET_BLOCK,
) -> DataFrame:
    """(keys, scale, order, coef, power) of the real Morlet over the last years (None: the whole series)."""
    return _cwt(df, column, years and 365 * years, scales or wavelet_scales(period_range), False, by, size)


def wavelet_power_complex(
    df: DataFrame, column: str, rows: int | None = 365, scales: list[float] | None = None, *, by: Series, size: int = WAVELET_BLOCK,
) -> DataFrame:
    """The one-year variant (None: the whole series): complex Morlet on 20 log-spaced scales, period = 2 scale."""
    chosen = scales or [float(s) for s in np.logspace(1, 2, 20)]
    return _cwt(df, column, rows, chosen, True, by, size)


def wavelet_power_by_scale(
    df: DataFrame, column: str, rows: int | None = 365 * 3, scales: list[float] | None = None, complex_: bool = False,
    period_factor: float = 1.0, *, by: Series, size: int = WAVELET_BLOCK,
) -> DataFrame:
    """``global_wavelet_spectrum`` without the table of coefficients: each task adds up the power of its blocks."""
    chosen = scales or wavelet_scales()
    keys = list(by.keys)
    blocks = _wavelet_blocks(df, column, rows, chosen, by, size)

    @F.pandas_udf("array<double>")
    def summed(x: pd.Series, lo: pd.Series, start: pd.Series, stop: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([[float((np.abs(_coefficients(*r, s, complex_)) ** 2).sum()) for s in chosen]
                          for r in zip(x, lo, start, stop, n, strict=True)], dtype=object)

    sums = blocks.select(*keys, (F.col("_to") - F.col("_from")).alias("_count"), F.posexplode(
        summed("_near_x", "_lo", "_from", "_to", "_n")).alias("_i", "_sum"))
    return sums.groupBy(*keys, "_i").agg((F.sum("_sum") / F.sum("_count")).alias("global_power")).select(
        *keys, F.get(F.array(*map(F.lit, chosen)), F.col("_i")).alias("scale"), "global_power").withColumn(
        "period", F.col("scale") * period_factor)


def global_wavelet_spectrum(power: DataFrame, keys: Sequence[str] = (), period_factor: float = 1.0) -> DataFrame:
    """(keys, scale, period, global_power): time mean of the power per scale."""
    return power.groupBy(*keys, "scale").agg(F.avg("power").alias("global_power")).withColumn(
        "period", F.col("scale") * period_factor
    )


def dominant_wavelet_periods(
    spectrum: DataFrame, top_n: int = 10, period_range: tuple[int, int] = (3, 365), keys: Sequence[str] = ()
) -> DataFrame:
    keyed = spectrum if keys else spectrum.withColumn("_all", F.lit(0))
    w = Window.partitionBy(*(keys or ["_all"])).orderBy(F.desc("global_power"), F.desc("scale"))
    top = keyed.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top_n)
    return top.filter(F.col("period").between(*period_range)).select(*keys, "period", "global_power").orderBy(
        *keys, F.desc("period")
    )

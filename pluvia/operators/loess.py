"""Loess passes as weighted row-frame filters over blocks of a series.

At each position a straight line (or a constant) is fitted to the nearest ``q`` values with tricube weights.  Without
robustness weights the fit is a fixed linear filter: one kernel inside the series, and fixed weight rows for the first
and the last positions.  So a pass is a dot product over a frame, which needs no more of the series than the frame.
Functions here see one block with its reach; positions count from 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tricube(at: float, first: int, last: int, n: int, q: int) -> np.ndarray:
    """Unscaled weights of the positions first..last for the fit at ``at``."""
    j = np.arange(first, last + 1, dtype=float)
    h = max(at - first, last - at) + ((q - n) // 2 if q > n else 0)
    if h <= 0:
        return np.ones_like(j)
    r = np.abs(j - at)
    w = np.where(r <= 0.001 * h, 1.0, (1 - (r / h) ** 3) ** 3)
    w[r > 0.999 * h] = 0.0
    return w


def fitted(weights: np.ndarray, at: float, first: int, n: int, h: float, degree: int) -> np.ndarray | None:
    """Scaled weights, tilted to a straight line where the values are spread enough; None without any weight."""
    total = weights.sum()
    if total <= 0:
        return None
    w = weights / total
    if h > 0 and degree > 0:
        j = np.arange(first, first + len(w), dtype=float)
        centre = (w * j).sum()
        spread = (w * (j - centre) ** 2).sum()
        if math.sqrt(spread) > 0.001 * (n - 1):
            w = w * ((at - centre) / spread * (j - centre) + 1)
    return w


def frame_weights(at: int, n: int, q: int, degree: int, rho: np.ndarray | None = None, first: int | None = None):
    """(first position, weights) of the fit at ``at``, which may lie one step outside of the series."""
    width = min(q, n)
    if first is None:
        first = 0 if q >= n else min(max(at - (q + 1) // 2 + 1, 0), n - q)
    h = max(at - first, first + width - 1 - at) + ((q - n) // 2 if q > n else 0)
    w = tricube(at, first, first + width - 1, n, q)
    return first, fitted(w if rho is None else w * rho, at, first, n, h, degree)


def clear_span(n: int, q: int) -> tuple[int, int]:
    """Positions at which the same kernel is used."""
    half = (q + 1) // 2
    return (half - 1, n - q + half) if q < n else (0, 0)


def _line(y: np.ndarray, rho: np.ndarray, kernel: np.ndarray, at: int, n: int, degree: int) -> np.ndarray:
    """Fits with robustness weights at many places: rows of ``y`` and ``rho`` are frames, ``at`` the place inside."""
    j = np.arange(y.shape[1], dtype=float)
    w = kernel * rho
    total = w.sum(1)
    there = total > 0
    w = w / np.where(there, total, 1)[:, None]
    if degree > 0:
        centre = w @ j
        spread = np.maximum((w * (j - centre[:, None]) ** 2).sum(1), 0)
        tilt = np.sqrt(spread) > 0.001 * (n - 1)
        slope = np.where(tilt, (at - centre) / np.where(tilt, spread, 1), 0)
        w = w * (slope[:, None] * (j - centre[:, None]) + 1)
    return np.where(there, (w * y).sum(1), y[:, at])


def loess_part(y: np.ndarray, lo: int, start: int, stop: int, n: int, q: int, degree: int, rho: np.ndarray | None = None) -> np.ndarray:
    """Smoothed values at the positions start..stop-1 of a series of ``n``, from its values at ``lo`` and on.

    ``y`` may have columns: series of one length side by side.
    """
    out = np.empty((max(stop - start, 0), *y.shape[1:]))
    if n < 2:
        out[:] = y[start - lo: stop - lo]
        return out
    width, half = min(q, n), (q + 1) // 2
    inner, end = clear_span(n, q)
    a, b = max(start, inner), min(stop, end)
    if a < b:
        seen = y[a - half + 1 - lo: b - half + q - lo]
        if rho is None:
            kernel = _kernel(n, q, degree)
            if y.ndim == 1:
                out[a - start: b - start] = np.convolve(seen, kernel[::-1], mode="valid")
            else:
                out[a - start: b - start] = sum(k * seen[i: i + b - a] for i, k in enumerate(kernel))
        else:
            weigh = rho[a - half + 1 - lo: b - half + q - lo]
            frames = np.lib.stride_tricks.sliding_window_view
            out[a - start: b - start] = _line(frames(seen, q), frames(weigh, q), tricube(half - 1, 0, q - 1, n, q), half - 1, n, degree)
    places = [*range(start, min(stop, inner)), *range(max(start, end), stop)] if q < n else range(start, stop)
    for at in places:
        first = 0 if q >= n else min(max(at - half + 1, 0), n - q)
        part = slice(first - lo, first - lo + width)
        w = _end_rows(n, q, degree)[at] if rho is None else frame_weights(at, n, q, degree, rho[part])[1]
        out[at - start] = y[at - lo] if w is None else w @ y[part]
    return out


#: Weights that a task has computed: kernels and rows of the ends by (length, window, degree).
_kernels: dict[tuple, np.ndarray] = {}
_ends: dict[tuple, dict[int, np.ndarray]] = {}
KEPT_ENDS = 32


def _kernel(n: int, q: int, degree: int) -> np.ndarray:
    """The kernel; the length only decides whether values are spread enough for a line."""
    at = (q + 1) // 2 - 1
    key = (n, q, degree)
    if key not in _kernels:
        if len(_kernels) >= KEPT_ENDS:
            _kernels.clear()
        _kernels[key] = fitted(tricube(at, 0, q - 1, n, q), at, 0, n, max(at, q - 1 - at), degree)
    return _kernels[key]


def _end_rows(n: int, q: int, degree: int) -> dict[int, np.ndarray]:
    key = (n, q, degree)
    if key not in _ends:
        if len(_ends) >= KEPT_ENDS:
            _ends.clear()
        inner, end = clear_span(n, q)
        _ends[key] = {at: frame_weights(at, n, q, degree)[1] for at in [*range(inner), *range(end, n)]}
    return _ends[key]


def cycle_part(
    y: np.ndarray, lo: int, start: int, stop: int, n: int, period: int, q: int, degree: int, rho: np.ndarray | None = None,
) -> np.ndarray:
    """Each phase of the period smoothed as a series of its own, at the positions start..stop-1; these may reach one period
    beyond the ends, where the first and the last fit of a phase are carried on."""
    first_cycle, last_cycle = lo // period, -(-(lo + len(y)) // period)
    pad = (lo - first_cycle * period, last_cycle * period - lo - len(y))

    def by_cycle(x: np.ndarray) -> np.ndarray:
        return np.pad(x, pad, constant_values=np.nan).reshape(-1, period)

    table, weights = by_cycle(y), None if rho is None else by_cycle(rho)
    from_cycle, to_cycle = start // period, -(-stop // period)
    out = np.full((to_cycle - from_cycle, period), np.nan)
    whole, extra = divmod(n, period)
    for phases, cycles in ((slice(0, extra), whole + 1), (slice(extra, period), whole)):
        part = table[:, phases]
        if not part.shape[1]:
            continue
        a, b = max(from_cycle, 0), min(to_cycle, cycles)
        columns = [part] if weights is None else [part[:, i] for i in range(part.shape[1])]
        for i, column in enumerate(columns):
            own = None if weights is None else weights[:, phases][:, i]
            to = out[:, phases] if weights is None else out[:, phases][:, i]
            to[a - from_cycle: b - from_cycle] = loess_part(column, first_cycle, a, b, cycles, q, degree, own)
            width = min(q, cycles)
            for at, first in ((-1, 0), (cycles, cycles - width)):
                if not from_cycle <= at < to_cycle:
                    continue
                seen = slice(first - first_cycle, first - first_cycle + width)
                _, w = frame_weights(at, cycles, q, degree, None if own is None else own[seen], first)
                to[at - from_cycle] = loess_part(column, first_cycle, min(max(at, 0), cycles - 1), min(max(at, 0), cycles - 1) + 1,
                                                 cycles, q, degree, own)[0] if w is None else w @ column[seen]
    return out.reshape(-1)[start - from_cycle * period: stop - from_cycle * period]


def moving_mean(x: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(x, np.full(k, 1.0 / k), mode="valid")


def low_part(cycle: np.ndarray, lo: int, start: int, stop: int, n: int, period: int, q: int, degree: int) -> np.ndarray:
    """Low-pass part of smoothed cycles (positions from one period before the series): three moving means and loess."""
    x0, x1 = max(0, lo + period), min(n, lo + len(cycle) - period)
    means = moving_mean(moving_mean(moving_mean(cycle[x0 - period - lo: x1 + period - lo], period), period), 3)
    return loess_part(means, x0, start, stop, n, q, degree)


def seasonal_step(
    y: np.ndarray, level: np.ndarray, rho: np.ndarray | None, lo: int, start: int, stop: int, n: int, period: int,
    windows: tuple[int, int, int], degrees: tuple[int, int, int],
) -> tuple[np.ndarray, np.ndarray]:
    """(season, level) of a block after one more round: smoothed cycles of what the level leaves, less their low-pass part,
    then the trend of what the season leaves.  ``y`` and ``level`` reach ``step_reach`` rows beyond the block."""
    (qs, nl, nt), (ds, dl, dt) = windows, degrees
    ta, tb = max(0, start - nt), min(n, stop + nt)       # the trend reaches so far
    xa, xb = max(0, ta - nl), min(n, tb + nl)            # the low-pass filter reaches so far
    cycle = cycle_part(y - level, lo, xa - period, xb + period, n, period, qs, ds, rho)
    low = low_part(cycle, xa - period, ta, tb, n, period, nl, dl)
    season = cycle[ta - xa + period: tb - xa + period] - low
    free = y[ta - lo: tb - lo] - season
    return season[start - ta: stop - ta], loess_part(free, ta, start, stop, n, nt, dt, None if rho is None else rho[ta - lo: tb - lo])


def seasonal_steps(
    y: np.ndarray, level: np.ndarray, rho: np.ndarray | None, lo: int, start: int, stop: int, n: int, rounds: int, period: int,
    windows: tuple[int, int, int], degrees: tuple[int, int, int],
) -> tuple[np.ndarray, np.ndarray]:
    """Several rounds of ``seasonal_step`` from values that reach as many times as far: each round is computed for the
    block and what the later rounds reach into, so that blocks need not meet between the rounds."""
    reach, season, at = step_reach(period, windows), np.zeros(0), lo
    for left in range(rounds - 1, -1, -1):
        a, b = max(0, start - left * reach), min(n, stop + left * reach)
        seen = slice(at - lo, at - lo + len(level))
        season, level = seasonal_step(y[seen], level, None if rho is None else rho[seen], at, a, b, n, period, windows, degrees)
        at = a
    return season, level


def step_reach(period: int, windows: tuple[int, int, int]) -> int:
    qs, nl, nt = windows
    return nt + nl + period * (qs + 2)


# --- the same as column functions; each row is a block ---------------------------------------------------------------

def smooth(near: Column, lo: Column, start: Column, stop: Column, n: Column, q: int, degree: int = 1) -> Column:
    @F.pandas_udf("array<double>")
    def compute(near: pd.Series, lo: pd.Series, start: pd.Series, stop: pd.Series, n: pd.Series) -> pd.Series:
        rows = zip(near, lo, start, stop, n, strict=True)
        return pd.Series([loess_part(np.asarray(y, float), lo, a, b, n, q, degree) for y, lo, a, b, n in rows], dtype=object)

    return compute(near, lo, start, stop, n)


def seasonal_rounds(
    near: Column, level: Column, rho: Column | None, lo: Column, start: Column, stop: Column, n: Column, rounds: int, period: int,
    windows: tuple[int, int, int], degrees: tuple[int, int, int],
) -> Column:
    """struct(season, level) of ``seasonal_steps``; zeros for series of two periods or less."""
    def one(y, v, w, lo, a, b, n):
        if n <= 2 * period:
            return np.zeros(b - a), np.zeros(b - a)
        return seasonal_steps(np.asarray(y, float), np.asarray(v, float), None if w is None else np.asarray(w, float), lo, a, b, n,
                              rounds, period, windows, degrees)

    def table(rows) -> pd.DataFrame:
        found = [one(*r) for r in rows]
        return pd.DataFrame({"season": pd.Series([f[0] for f in found], dtype=object), "level": pd.Series([f[1] for f in found], dtype=object)})

    kind = "season array<double>, level array<double>"
    if rho is None:
        @F.pandas_udf(kind)
        def plain(y: pd.Series, v: pd.Series, lo: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.DataFrame:
            return table((y, v, None, *rest) for y, v, *rest in zip(y, v, lo, a, b, n, strict=True))

        return plain(near, level, lo, start, stop, n)

    @F.pandas_udf(kind)
    def weighted(y: pd.Series, v: pd.Series, w: pd.Series, lo: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.DataFrame:
        return table(zip(y, v, w, lo, a, b, n, strict=True))

    return weighted(near, level, rho, lo, start, stop, n)

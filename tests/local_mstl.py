"""MSTL of one series in memory: what the block route of the decomposition is held against."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np


def default_windows(count: int) -> list[int]:
    return [7 + 4 * i for i in range(1, count + 1)]


def _odd_from(x: int) -> int:
    return x if x % 2 else x + 1


def loess_weights(xs: float, left: int, right: int, n: int, q: int, degree: int,
                  rho: np.ndarray | None = None) -> np.ndarray | None:
    """Weights of positions left..right for the fit at xs (positions from 1)."""
    j = np.arange(left, right + 1, dtype=float)
    h = max(xs - left, right - xs)
    if q > n:
        h += (q - n) // 2
    r = np.abs(j - xs)
    w = np.where(r <= 0.001 * h, 1.0, (1 - (r / h) ** 3) ** 3 if h > 0 else 1.0)
    w[r > 0.999 * h] = 0.0
    if h <= 0:
        w = np.ones_like(j)
    if rho is not None:
        w = w * rho
    total = w.sum()
    if total <= 0:
        return None
    w = w / total
    if h > 0 and degree > 0:
        centre = (w * j).sum()
        spread = (w * (j - centre) ** 2).sum()
        if math.sqrt(spread) > 0.001 * (n - 1):
            w = w * ((xs - centre) / spread * (j - centre) + 1)
    return w


def _left(i: int, n: int, q: int) -> int:
    """First position of the q-window used at position i."""
    return 1 if q >= n else min(max(i - (q + 1) // 2 + 1, 1), n - q + 1)


@lru_cache(maxsize=512)
def _loess_filter(n: int, q: int, degree: int):
    """(inner kernel, rows at the start, rows at the end) of an unweighted pass."""
    width = min(q, n)
    half = (q + 1) // 2
    if q >= n:
        full = np.vstack([loess_weights(i, 1, n, n, q, degree) for i in range(1, n + 1)])
        return None, full, None
    kernel = loess_weights(half, 1, width, n, q, degree)
    head = np.vstack([loess_weights(i, 1, width, n, q, degree) for i in range(1, half + 1)])
    tail = np.vstack([
        loess_weights(i, n - width + 1, n, n, q, degree) for i in range(n - width + half + 1, n + 1)
    ]) if width > half else np.zeros((0, width))
    return kernel, head, tail


def loess(y: np.ndarray, q: int, degree: int = 1, rho: np.ndarray | None = None) -> np.ndarray:
    n = len(y)
    if n < 2:
        return y.astype(float).copy()
    if rho is not None:
        out = np.empty(n)
        width = min(q, n)
        for i in range(1, n + 1):
            a = _left(i, n, q)
            w = loess_weights(i, a, a + width - 1, n, q, degree, rho[a - 1: a - 1 + width])
            out[i - 1] = y[i - 1] if w is None else w @ y[a - 1: a - 1 + width]
        return out
    kernel, head, tail = _loess_filter(n, q, degree)
    if kernel is None:
        return head @ y
    middle = np.convolve(y, kernel[::-1], mode="valid")
    half, width = (q + 1) // 2, min(q, n)
    out = np.empty(n)
    out[half - 1: half - 1 + len(middle)] = middle
    out[:half] = head @ y[:width]
    if len(tail):
        out[n - len(tail):] = tail @ y[n - width:]
    return out


def _smooth_cycle(y: np.ndarray, q: int, degree: int, rho: np.ndarray | None) -> np.ndarray:
    """Loess of one cycle-subseries, extended by one value at either end."""
    n = len(y)
    width = min(q, n)

    def end(xs: int, a: int) -> float:
        w = loess_weights(xs, a, a + width - 1, n, q, degree, None if rho is None else rho[a - 1: a - 1 + width])
        return float(w @ y[a - 1: a - 1 + width]) if w is not None else float("nan")

    inner = loess(y, q, degree, rho)
    first, last = end(0, 1), end(n + 1, max(1, n - width + 1))
    return np.concatenate([
        [inner[0] if math.isnan(first) else first], inner, [inner[-1] if math.isnan(last) else last]
    ])


DENSE_CYCLE = 1000


@lru_cache(maxsize=64)
def _cycle_operator(n: int, q: int, degree: int) -> np.ndarray:
    """(n + 2) x n matrix of ``_smooth_cycle`` without robustness weights."""
    return np.column_stack([_smooth_cycle(unit, q, degree, None) for unit in np.eye(n)])


def _smooth_cycles(free: np.ndarray, period: int, q: int, degree: int, rho: np.ndarray | None) -> np.ndarray:
    """All cycle-subseries, smoothed and extended by one period at either end."""
    n = len(free)
    out = np.empty(n + 2 * period)
    whole, extra = divmod(n, period)
    if rho is None and whole + 1 <= DENSE_CYCLE:
        for phases, k in ((range(extra), whole + 1), (range(extra, period), whole)):
            if len(phases):
                part = np.stack([free[p::period] for p in phases], axis=1)
                smooth = _cycle_operator(k, q, degree) @ part
                for i, p in enumerate(phases):
                    out[p::period] = smooth[:, i]
        return out
    for p in range(period):
        out[p::period] = _smooth_cycle(free[p::period], q, degree, None if rho is None else rho[p::period])
    return out


def _moving_mean(x: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(x, np.full(k, 1.0 / k), mode="valid")


def stl(y: np.ndarray, period: int, seasonal: int, trend: int | None = None, low_pass: int | None = None,
        seasonal_deg: int = 1, trend_deg: int = 1, low_pass_deg: int = 1, robust: bool = False,
        inner_iter: int | None = None, outer_iter: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(seasonal, trend) of one period."""
    n = len(y)
    nt = trend or _odd_from(math.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    nl = low_pass or _odd_from(period + 1)
    inner = inner_iter if inner_iter is not None else (2 if robust else 5)
    outer = outer_iter if outer_iter is not None else (15 if robust else 0)
    level, season, rho = np.zeros(n), np.zeros(n), None
    for round_no in range(outer + 1):
        for _ in range(inner):
            cycle = _smooth_cycles(y - level, period, seasonal, seasonal_deg, rho)
            low = loess(_moving_mean(_moving_mean(_moving_mean(cycle, period), period), 3), nl, low_pass_deg)
            season = cycle[period: period + n] - low
            level = loess(y - season, nt, trend_deg, rho)
        if round_no < outer:
            miss = np.abs(y - season - level)
            cap = 6 * np.median(miss)
            rho = np.where(miss <= 0.001 * cap, 1.0, np.where(miss <= 0.999 * cap, (1 - (miss / cap) ** 2) ** 2, 0.0)) \
                if cap > 0 else np.ones(n)
    return season, level


def mstl(y: np.ndarray, periods: Sequence[int], windows: Sequence[int] | None = None, iterate: int = 2,
         **stl_options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, one seasonal row per period, residual); periods of half the series or more are dropped."""
    if windows is None:
        periods, windows = sorted(periods), default_windows(len(periods))
    chosen = sorted((p, w) for p, w in zip(periods, windows) if p < len(y) / 2)
    seasonal = np.zeros((len(chosen), len(y)))
    rest, level = y.astype(float).copy(), np.zeros(len(y))
    for _ in range(1 if len(chosen) == 1 else iterate):
        for i, (p, w) in enumerate(chosen):
            rest = rest + seasonal[i]
            seasonal[i], level = stl(rest, p, w, **stl_options)
            rest = rest - seasonal[i]
    return level, seasonal, rest - level

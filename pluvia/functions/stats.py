"""Statistics as plain Column expressions (all JVM side).

Conventions: std and variance use n-1, quantiles interpolate linearly,
skewness and kurtosis are the bias-adjusted G1 and G2, correlations are
pairwise complete and NULL on a constant column (ANSI mode would raise).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def both(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both sides are present."""
    ok = both(a, b)
    x, y = F.when(ok, a), F.when(ok, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def safe_corr_over(a: Column, b: Column, window) -> Column:
    ok = both(a, b)
    x, y = F.when(ok, a), F.when(ok, b)
    return F.try_divide(
        F.covar_pop(x, y).over(window),
        F.stddev_pop(x).over(window) * F.stddev_pop(y).over(window),
    )


def skew_adjusted(c: Column) -> Column:
    """G1; 0 for a constant column, NULL below three values."""
    n = F.count(c).cast("double")
    return F.when(
        n >= 3, F.coalesce(F.skewness(c), F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2)
    )


def kurt_adjusted(c: Column) -> Column:
    """Excess G2; 0 for a constant column, NULL below four values."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return F.when(
        n >= 4,
        F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), F.lit(0.0)),
    )


AGGREGATES = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "median": F.median,
    "count": F.count,
    "skew": skew_adjusted,
    "kurt": kurt_adjusted,
}


def aggregate(name: str, c: Column) -> Column:
    """Aggregate by name; callers pick the list of names."""
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; known: {sorted(AGGREGATES)}")
    return AGGREGATES[name](c)


def box_cox(c: Column, lam: float) -> Column:
    if lam == 0:
        return F.log(c)
    return (F.pow(c, F.lit(float(lam))) - 1) / F.lit(float(lam))


def half_even(c: Column, scale: int = 0) -> Column:
    return F.bround(c, scale)


def clean_number(c: Column, sentinel: float) -> Column:
    """NaN and the feed's missing sentinel both become NULL."""
    return F.nullif(F.when(~F.isnan(c), c), F.lit(sentinel))


def label_ladder(c: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose threshold the value is strictly above."""
    out = F
    for bound, label in steps:
        out = out.when(c > bound, label)
    return F.when(c.isNotNull(), out.otherwise(otherwise))

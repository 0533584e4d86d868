"""Tail probabilities as Column expressions.

Normal tails use Cody's rational approximations of erfc (Math. Comp. 23, 1969),
normal quantiles use Wichura's AS 241, chi-square tails with an integer number
of degrees of freedom use their finite series.  Only Student's t needs a loop
and runs as an Arrow-batched function on small result tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Cody's coefficients, highest power first.
ERF_NUM = [1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2,
           3.77485237685302021e2, 3.20937758913846947e3]
ERF_DEN = [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3,
           2.84423683343917062e3]
MID_NUM = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594,
           6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
           1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3]
MID_DEN = [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
           1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
           3.43936767414372164e3, 1.23033935480374942e3]
FAR_NUM = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
           1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
FAR_DEN = [1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1,
           6.05183413124413191e-2, 2.33520497626869185e-3]

# AS 241 coefficients, highest power first.
MID_P = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
         45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
         133.14166789178437745, 3.387132872796366608]
MID_Q = [5226.495278852854561, 28729.085735721942674, 39307.89580009271061,
         21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
         42.313330701600911252, 1.0]
NEAR_P = [7.7454501427834140764e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
          1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550,
          4.63033784615654529590, 1.42343711074968357734]
NEAR_Q = [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
          1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940,
          2.05319162663775882187, 1.0]
FAR_P = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
         2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580,
         5.46378491116411436990, 6.65790464350110377720]
FAR_Q = [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
         7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
         5.99832206555887937690e-1, 1.0]


def _horner(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def _ratio(num: list[float], den: list[float], x: Column) -> Column:
    return _horner(num, x) / _horner(den, x)


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``: keeps the generated
    code of nested formulas small."""
    return F.transform(F.array(value.cast("double")), body)[0]


def erfc(x: Column) -> Column:
    """For a plain column; wrap longer expressions in ``let``."""
    a = F.abs(x)
    square = a * a
    near = 1 - a * _ratio(ERF_NUM, ERF_DEN, square)
    mid = F.exp(-square) * _ratio(MID_NUM, MID_DEN, a)
    inv = 1 / F.greatest(square, F.lit(1.0))
    far = F.exp(-square) / F.greatest(a, F.lit(1.0)) * (
        F.lit(1 / math.sqrt(math.pi)) - inv * _ratio(FAR_NUM, FAR_DEN, inv)
    )
    upper = F.when(a <= 0.46875, near).when(a <= 4.0, mid).otherwise(far)
    return F.when(x < 0, 2 - upper).otherwise(upper)


def normal_cdf(z: Column) -> Column:
    return 0.5 * erfc(-z / F.lit(math.sqrt(2)))


def normal_two_sided(z: Column) -> Column:
    return let(F.abs(z) / F.lit(math.sqrt(2)), erfc)


def normal_quantile(p: Column) -> Column:
    q = p - 0.5
    centre = q * _ratio(MID_P, MID_Q, F.lit(0.180625) - q * q)
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(NEAR_P, NEAR_Q, r - 1.6)).otherwise(_ratio(FAR_P, FAR_Q, r - 5))
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.when(q < 0, -tail).otherwise(tail))


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail for integer df: finite series, starting from df 2 or df 1."""
    return let(x, lambda v: _chi2_sf(v, df))


def _chi2_sf(x: Column, df: Column) -> Column:
    half = x / 2
    odd = df % 2 == 1
    first = F.when(odd, let(F.sqrt(half), erfc)).otherwise(F.exp(-half))
    # Terms half^a e^-half / gamma(a + 1) for a = df/2 - 1 down to 1/2 or 1.
    start = F.when(odd, F.exp(-half) * F.sqrt(half) * F.lit(2 / math.sqrt(math.pi))).otherwise(
        F.exp(-half) * half
    )
    count = F.floor((df - 1) / 2).cast("int")
    steps = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    zero = F.struct(start.cast("double").alias("term"), F.lit(0.0).alias("total"))

    def add(state, i):
        a = i + F.when(odd, F.lit(0.5)).otherwise(F.lit(1.0))
        return F.struct(
            (state["term"] * half / a).cast("double").alias("term"),
            (state["total"] + state["term"]).cast("double").alias("total"),
        )

    series = F.aggregate(steps, zero, add, lambda s: s["total"])
    return F.when(x <= 0, 1.0).when(count >= 1, first + series).otherwise(first)


def beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(t) + q * np.log1p(-t)
        ) / p
    tiny = 1e-300
    c = np.ones_like(t)
    d = 1 - (p + q) * t / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (
            m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    part = np.where(t <= 0, 0.0, front * h)
    return np.where(swap, 1 - part, part)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) for Student's t."""
    out = pd.Series(np.nan, index=t.index)
    ok = t.notna() & df.notna() & (df > 0)
    if ok.any():
        v = df[ok].to_numpy(float)
        tt = t[ok].to_numpy(float)
        out[ok] = beta_tail(v / 2, np.full(len(v), 0.5), v / (v + tt * tt))
    return out


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a (rank) correlation over n pairs."""
    dof = (n - 2).cast("double")
    t = r * F.sqrt(F.greatest(dof, F.lit(0.0)) / F.greatest((1 - r) * (1 + r), F.lit(1e-300)))
    return F.when(r.isNotNull() & (n > 2), t_two_sided(t, dof))


def yes_no(condition: Column) -> Column:
    return F.when(condition, "Yes").otherwise("No")

"""Discrete Fourier transforms of series of any length, in groups of about the square root of the length.

With n = n1 n2, places m = n2 m1 + m2 and frequencies k = k1 + n1 k2, the transform is n2 transforms of length n1 (one
for each m2), a twist by exp(-2 pi i m2 k1 / n), and n1 transforms of length n2 (one for each k1).  Each of the two steps
is a grouping in Spark, so a long series is spread over many tasks and costs O(n log n).  A length whose larger factor
does not fit a task (a large prime, say) goes through the chirp form: with k m = (k^2 + m^2 - (k - m)^2) / 2 the transform
is a convolution, which three transforms of a power of two give.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of one group in one task, at most.
GROUP_VALUES = 1 << 17


def _transform(at: pd.Series, re: pd.Series, im: pd.Series, length: pd.Series, twist: pd.Series, n: pd.Series, sign: pd.Series) -> pd.DataFrame:
    """Each row: values at places ``at`` of a group (zero elsewhere), transformed and twisted by the group's number."""
    out_re, out_im = [], []
    for places, x, y, size, group, whole, s in zip(at, re, im, length, twist, n, sign, strict=True):
        z = np.zeros(size, complex)
        z[np.asarray(places, np.int64)] = np.asarray(x, float) + 1j * np.asarray(y, float)
        z = np.fft.fft(z) if s < 0 else np.fft.ifft(z) * size
        if group:
            turn = (group * np.arange(size, dtype=np.int64)) % whole
            z = z * np.exp(s * 2j * np.pi * turn / whole)
        out_re.append(z.real)
        out_im.append(z.imag)
    return pd.DataFrame({"re": pd.Series(out_re, dtype=object), "im": pd.Series(out_im, dtype=object)})


def _grouped(rows: DataFrame, keys: list[str], group: str, place: str, length: Column, twist: Column, size: Column, sign: int, made: str) -> DataFrame:
    """One step: (keys, group, ``made``, re, im), the transform of each group over ``place``."""
    transform = F.pandas_udf(_transform, "re array<double>, im array<double>")
    met = rows.groupBy(*keys, group).agg(F.collect_list(F.struct(place, "re", "im")).alias("_c"))
    found = met.withColumn("_t", transform(F.col(f"_c.{place}"), F.col("_c.re"), F.col("_c.im"), length, twist, size, F.lit(sign)))
    return found.select(*keys, group, F.posexplode(F.arrays_zip("_t.re", "_t.im")).alias(made, "_z")).select(
        *keys, group, F.col(made).cast("long").alias(made), F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def four_step(rows: DataFrame, keys: Sequence[str], sign: int = -1) -> DataFrame:
    """Rows (keys, _size, _n1, m, re, im) to (keys, _size, _n1, k, re, im); absent places are zero.  Sign 1: the inverse,
    not divided by the size."""
    keys = [*keys, "_size", "_n1"]
    n2 = (F.col("_size") / F.col("_n1")).cast("long")
    split = rows.withColumns({"_m1": F.floor(F.col("m") / n2), "_m2": F.col("m") % n2})
    inner = _grouped(split, keys, "_m2", "_m1", F.col("_n1"), F.col("_m2"), F.col("_size"), sign, "_k1")
    outer = _grouped(inner, keys, "_k1", "_m2", n2, F.lit(0).cast("long"), F.col("_size"), sign, "_k2")
    return outer.select(*keys, (F.col("_k1") + F.col("_n1") * F.col("_k2")).alias("k"), "re", "im")


def _near_root(n: Column) -> Column:
    """The largest divisor up to the square root."""
    return F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(n.cast("double"))).cast("long")), lambda d: n % d == 0))


def _turned(rows: DataFrame, angle: Column) -> DataFrame:
    """Values times exp(i angle)."""
    c, s = F.cos(angle), F.sin(angle)
    return rows.withColumns({"re": F.col("re") * c - F.col("im") * s, "im": F.col("re") * s + F.col("im") * c})


def _chirp_form(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _n, k, re, im) for series (keys, _n, m, x) of lengths without a useful factor."""
    n, m = F.col("_n"), F.col("m")
    bits = F.ceil(F.log2((2 * n - 1).cast("double"))).cast("int")
    sized = rows.withColumns({"_size": F.pow(F.lit(2.0), bits).cast("long"), "_n1": F.pow(F.lit(2.0), F.floor(bits / 2)).cast("long")})
    own = [*keys, "_n", "_size", "_n1"]

    def angle(place: Column) -> Column:
        return F.pi() * ((place * place) % (2 * n)) / n

    data = _turned(sized.select(*own, "m", F.col("x").alias("re"), F.lit(0.0).alias("im")), -angle(m))
    both = sized.select(*own, "m", F.explode(F.when(m > 0, F.array(m, F.col("_size") - m)).otherwise(F.array(m))).alias("_place"))
    chirp = both.select(*own, F.col("_place").alias("m"), F.cos(angle(m)).alias("re"), F.sin(angle(m)).alias("im"))
    a = four_step(data, [*keys, "_n"])
    b = four_step(chirp, [*keys, "_n"]).withColumnsRenamed({"re": "_re", "im": "_im"})
    # Both transforms have each frequency once: a group of two rows is their product.
    tagged = a.select(*own, "k", "re", "im", F.lit(None).cast("double").alias("_re"), F.lit(None).cast("double").alias("_im")).unionByName(
        b.select(*own, "k", F.lit(None).cast("double").alias("re"), F.lit(None).cast("double").alias("im"), "_re", "_im"))
    met = tagged.groupBy(*own, "k").agg(*[F.max(c).alias(c) for c in ("re", "im", "_re", "_im")])
    product = met.select(*own, F.col("k").alias("m"), (F.col("re") * F.col("_re") - F.col("im") * F.col("_im")).alias("re"),
                         (F.col("re") * F.col("_im") + F.col("im") * F.col("_re")).alias("im"))
    back = four_step(product, [*keys, "_n"], sign=1).filter(F.col("k") < n)
    back = back.withColumns({c: F.col(c) / F.col("_size") for c in ("re", "im")})
    return _turned(back, -angle(F.col("k"))).select(*keys, "_n", "k", "re", "im")


def transform_series(rows: DataFrame, keys: Sequence[str], longest: int | None = None, group_values: int = GROUP_VALUES) -> DataFrame:
    """(keys, _n, k, re, im), all frequencies, of series (keys, _n, m, x) with x at each of the places 0 to _n - 1.

    ``longest``: a bound of the lengths; within ``group_values`` it makes the chirp form unnecessary.
    """
    keys = list(keys)
    sized = rows.withColumns({"m": F.col("m").cast("long"), "_n": F.col("_n").cast("long")}).withColumn("_n1", _near_root(F.col("_n")))
    fits = F.col("_n") / F.col("_n1") <= group_values
    direct = sized if longest is not None and longest <= group_values else sized.filter(fits)
    direct = direct.select(*keys, "_n", F.col("_n").alias("_size"), "_n1", "m", F.col("x").alias("re"), F.lit(0.0).alias("im"))
    found = four_step(direct, [*keys, "_n"]).select(*keys, "_n", "k", "re", "im")
    if longest is not None and longest <= group_values:
        return found
    return found.unionByName(_chirp_form(sized.filter(~fits).select(*keys, "_n", "m", "x"), keys))

"""Autoregressive forecasting of every series at once.

Orders are given like those of seasonal ARIMA models with or without outside
columns, but the fit is conditional least squares, not exact likelihood:
differencing and lags are window columns, moving-average terms come from the
residuals of a long autoregression (Hannan-Rissanen), and the coefficients of
a series are solved from its cross-product matrix.  Numbers therefore differ
from a state-space fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.functions.gram import gram_by_key, solve_by_key
from pluvia.functions.ordering import Series, over_frames
from pluvia.operators.evaluation import regression_metrics
from pluvia.operators.features import recent_rows

ROW_SCALE_FLOOR = 1e-12


def differencing_weights(d: int, seasonal_d: int, s: int) -> list[float]:
    """Coefficients of (1 - B)^d (1 - B^s)^D by lag, starting at lag 0."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    season = np.zeros(s + 1)
    if seasonal_d:
        season[0], season[s] = 1.0, -1.0
    for _ in range(seasonal_d):
        poly = np.convolve(poly, season)
    return poly.tolist()


@dataclass(frozen=True)
class ForecastModel:
    """order (p, d, q), seasonal order (P, D, Q, s), names of outside columns."""

    target: str
    order: tuple[int, int, int] = (3, 0, 3)
    seasonal_order: tuple[int, int, int, int] = (0, 0, 0, 0)
    exog: tuple[str, ...] = ()

    @property
    def ar_lags(self) -> list[int]:
        p, (big_p, _, _, s) = self.order[0], self.seasonal_order
        return sorted({*range(1, p + 1), *[s * i for i in range(1, big_p + 1)]})

    @property
    def ma_lags(self) -> list[int]:
        q, (_, _, big_q, s) = self.order[2], self.seasonal_order
        return sorted({*range(1, q + 1), *[s * i for i in range(1, big_q + 1)]})

    @property
    def weights(self) -> list[float]:
        return differencing_weights(self.order[1], self.seasonal_order[1], self.seasonal_order[3])

    @property
    def long_lag(self) -> int:
        """Order of the first-pass autoregression."""
        return max([10, *[2 * k for k in self.ar_lags + self.ma_lags]]) if self.ma_lags else 0

    def fit(self, df: DataFrame, *, by: Series) -> "FittedForecast":
        if not by.keys:
            raise ValueError("forecasting needs a series key; add a constant one for a single site")
        keys = list(by.keys)
        columns = [self.target, *self.exog]
        rows = df.select(*keys, by.order, *by.ties, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop(
            "any", subset=columns
        )
        w = self.weights
        span = len(w) - 1

        def differenced(c: str, window) -> Column:
            total = F.col(c)
            for lag, weight in enumerate(w):
                if lag and weight:
                    total = total + F.lit(weight) * F.lag(c, lag).over(window)
            return total

        moved = over_frames(rows, by, span, 0, lambda window: {
            f"_z{i}": differenced(c, window) for i, c in enumerate(columns)
        }).filter("_z0 IS NOT NULL")
        deep = max([0, self.long_lag, *self.ar_lags])
        framed = _with_past(moved, "_z0", deep, by)
        if self.ma_lags:
            first = self._solve(framed.filter(F.size("_past_z0") == deep), keys, [
                F.element_at("_past_z0", k) for k in range(1, self.long_lag + 1)
            ])
            framed = self._add_residuals(framed, first, keys, deep)
            framed = _with_past(framed, "_e", max(self.ma_lags), by)
            ready = framed.filter(
                (F.size("_past_z0") == deep) & (F.size("_past_e") == max(self.ma_lags))
                & F.forall("_past_e", lambda e: e.isNotNull())
            )
        else:
            framed = framed.withColumn("_e", F.lit(0.0))
            ready = framed.filter(F.size("_past_z0") == deep)
        inputs = [F.element_at("_past_z0", k) for k in self.ar_lags]
        inputs += [F.element_at("_past_e", k) for k in self.ma_lags]
        inputs += [F.col(f"_z{i}") for i in range(1, len(columns))]
        solved = self._solve(ready, keys, inputs)
        tail = self._tail(framed, keys, columns, by)
        return FittedForecast(self, by, solved.join(tail, keys))

    def _solve(self, rows: DataFrame, keys: list[str], inputs: list[Column]) -> DataFrame:
        """(keys, coef, sigma2, n_obs) of the regression of _z0 on the inputs."""
        design = rows.withColumn("_v", F.array(*inputs, F.col("_z0")))
        grams = gram_by_key(design, keys, "_v")

        def solve(g: np.ndarray, n: int):
            k = len(g) - 1
            scale = np.sqrt(np.maximum(np.diag(g)[:k], ROW_SCALE_FLOOR))
            xx = g[:k, :k] / np.outer(scale, scale)
            beta = np.linalg.pinv(xx, hermitian=True) @ (g[:k, k] / scale) / scale if k else np.zeros(0)
            ssr = max(float(g[k, k] - beta @ g[:k, k]), 0.0)
            return [(beta.tolist(), ssr / max(n, 1), n)]

        return solve_by_key(grams, keys, solve, [
            T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("sigma2", T.DoubleType()),
            T.StructField("n_obs", T.LongType()),
        ])

    def _add_residuals(self, framed: DataFrame, first: DataFrame, keys: list[str], deep: int) -> DataFrame:
        joined = framed.join(first.select(*keys, F.col("coef").alias("_b")), keys, "left")
        terms = F.zip_with(F.slice("_past_z0", 1, self.long_lag), "_b", lambda x, b: x * b)
        fitted = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
        return joined.withColumn(
            "_e", F.when(F.size("_past_z0") == deep, F.col("_z0") - fitted)
        ).drop("_b")

    def _tail(self, framed: DataFrame, keys: list[str], columns: list[str], by: Series) -> DataFrame:
        """The few last rows a recursion starts from, as arrays, newest first."""
        need = max([1, len(self.weights) - 1, *self.ar_lags, *self.ma_lags])
        last = recent_rows(framed, need, by=by)
        entry = F.struct(
            F.col(by.order).alias("at"), F.col("_z0").alias("z"), F.coalesce("_e", F.lit(0.0)).alias("e"),
            *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)],
        )
        ordered = F.reverse(F.array_sort(F.collect_list(entry)))
        return last.groupBy(*keys).agg(ordered.alias("tail")).withColumn("last_at", F.col("tail")[0]["at"])


def _with_past(df: DataFrame, column: str, depth: int, by: Series) -> DataFrame:
    """``_past<column>``: previous values, newest first (element 1 is lag 1)."""
    name = f"_past{column}"
    if depth == 0:
        return df.withColumn(name, F.array().cast("array<double>"))
    value = F.struct(F.col(column).alias("v"))  # keeps NULLs in place
    out = over_frames(df, by, depth, 0, lambda w: {
        name: F.collect_list(value).over(w.rowsBetween(-depth, -1))
    })
    return out.withColumn(name, F.reverse(F.transform(name, lambda s: s["v"])))


@dataclass(frozen=True)
class FittedForecast:
    model: ForecastModel
    by: Series
    table: DataFrame  # one row per series: coef, sigma2, n_obs, tail, last_at

    def forecast(self, steps: int, future: DataFrame | None = None) -> DataFrame:
        """(keys, step, forecast).  With outside columns ``future`` holds
        (keys, step, columns) with exactly the columns of the fit, in order."""
        m, keys = self.model, list(self.by.keys)
        if m.exog:
            given = [c for c in future.columns if c not in (*keys, "step")] if future is not None else []
            if given != list(m.exog):
                raise ValueError(f"outside columns {given} do not match those of the fit {list(m.exog)}")
            path = future.filter(F.col("step") <= steps).groupBy(*keys).agg(F.array_sort(F.collect_list(
                F.struct("step", *[F.col(c).cast("double").alias(c) for c in m.exog])
            )).alias("path"))
            rows = self.table.join(path, keys)
        else:
            rows = self.table.withColumn("path", F.lit(None).cast("array<struct<step:int>>"))
        schema = T.StructType([rows.schema[k] for k in keys] + [
            T.StructField("step", T.IntegerType()), T.StructField("forecast", T.DoubleType()),
        ])
        weights, ar, ma, exog = m.weights, m.ar_lags, m.ma_lags, m.exog

        def run(coef, tail, path) -> list[float]:
            z = [r["z"] for r in tail]
            e = [r["e"] for r in tail]
            levels = [[r[f"c{i}"] for r in tail] for i in range(1 + len(exog))]
            out = []
            for t in range(steps):
                total, at = 0.0, 0
                for k in ar:
                    total += coef[at] * z[k - 1]
                    at += 1
                for k in ma:
                    total += coef[at] * e[k - 1]
                    at += 1
                for i, c in enumerate(exog, start=1):
                    now = path[t][c]
                    moved = now + sum(w * levels[i][k - 1] for k, w in enumerate(weights) if k and w)
                    total += coef[at] * moved
                    at += 1
                    levels[i].insert(0, now)
                y = total - sum(w * levels[0][k - 1] for k, w in enumerate(weights) if k and w)
                z.insert(0, total)
                e.insert(0, 0.0)
                levels[0].insert(0, y)
                out.append(y)
            return out

        def expand(batches):
            for pdf in batches:
                made = []
                for row in pdf.to_dict("records"):
                    values = run(row["coef"], list(row["tail"]), row["path"])
                    made += [(*[row[k] for k in keys], i + 1, float(v)) for i, v in enumerate(values)]
                yield pd.DataFrame(made, columns=schema.names)

        return rows.select(*keys, "coef", "tail", "path").mapInPandas(expand, schema)

    def evaluate(self, test: DataFrame, future: DataFrame | None = None) -> DataFrame:
        """Regression metrics per series; ``test`` has (keys, step, target)."""
        keys = list(self.by.keys)
        steps = test.agg(F.max("step")).first()[0] or 0
        joined = test.select(*keys, "step", self.model.target).join(self.forecast(steps, future), [*keys, "step"])
        return regression_metrics(joined, self.model.target, "forecast", keys)


def ar_model(target: str, order=(3, 0, 3), seasonal_order=(0, 0, 0, 0), exog=()) -> ForecastModel:
    return ForecastModel(target, tuple(order), tuple(seasonal_order), tuple(exog))


def seasonal_ar_model(target: str, order=(3, 0, 3), seasonal_order=(1, 1, 1, 7), exog=()) -> ForecastModel:
    return ForecastModel(target, tuple(order), tuple(seasonal_order), tuple(exog))

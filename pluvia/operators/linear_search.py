"""Many linear models over all folds from a few passes.

Expanding folds train on the rows before their test part.  One aggregate adds up cross products by stretch between two
cuts; the sums of a fold's training rows are prefix sums of these, and every least-squares, ridge or lasso fit of a trial
is a small solve on them.  RMSE and R2 follow from the test part's sums alone, MAE from one more pass that scores all
trials of a batch with a matrix product.  Logistic trials are fitted together by Newton steps: each step is one pass that
adds up gradients and curvatures of all trials and folds.  Only sums leave the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.operators.evaluation import fold_bounds, roc_auc

#: Newton steps of logistic fits, at most, and the size of a step that ends them.
NEWTON_STEPS, NEWTON_SIZE = 30, 1e-9


def stretches(numbered: DataFrame, n_splits: int) -> tuple[Column, list[tuple[int, int, int]]]:
    """(stretch of a row, fold bounds): fold i trains on the stretches up to i and is tested on stretch i + 1."""
    bounds = fold_bounds(numbered.count(), n_splits)
    return sum((F.col("_pos") >= start).cast("int") for _, start, _ in bounds), bounds


def cross_products(rows: DataFrame, stretch: Column, columns: Sequence[Column], n_stretches: int) -> np.ndarray:
    """Sums of products of (1, columns) by stretch, from one map-side combined aggregate."""
    full = [F.lit(1.0), *[c.cast("double") for c in columns]]
    pairs = [(i, j) for i in range(len(full)) for j in range(i, len(full))]
    named = rows.select(stretch.alias("_s"), *[c.alias(f"_c{i}") for i, c in enumerate(full)])
    sums = named.groupBy("_s").agg(*[F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")).alias(f"_p{i}_{j}") for i, j in pairs])
    out = np.zeros((n_stretches, len(full), len(full)))
    for r in sums.collect():  # a row for each stretch
        for i, j in pairs:
            out[r["_s"], i, j] = out[r["_s"], j, i] = r[f"_p{i}_{j}"]
    return out


def scaling(gram: np.ndarray, normalize: bool) -> tuple[np.ndarray, np.ndarray]:
    """(means, population deviations) of the features, whose sums stand between the constant and the target."""
    n, sums, squares = gram[0, 0], gram[0, 1:-1], np.diag(gram)[1:-1]
    mean = sums / n
    spread = np.sqrt(np.maximum(squares / n - mean ** 2, 0))
    return mean, np.where((spread > 0) & normalize, spread, 1.0)


def fit_from_products(gram: np.ndarray, params: dict) -> np.ndarray:
    """(intercept, coefficients on the features as they are) of one fit from sums of products of (1, x.., y)."""
    kind, alpha = params.get("regression_type", "ridge"), float(params.get("alpha", 1.0))
    mean, spread = scaling(gram, params.get("normalize_features", True))
    n, level = gram[0, 0], gram[0, -1] / gram[0, 0]
    z = (gram[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(spread, spread)
    zy = (gram[1:-1, -1] - n * mean * level) / spread
    if kind == "lasso":
        w = _lasso(z / n, zy / n, alpha)
    elif kind in ("ridge", "linear"):
        w = np.linalg.lstsq(z + (alpha if kind == "ridge" else 0.0) * np.eye(len(z)), zy, rcond=None)[0]
    else:
        raise ValueError(f"unknown regression type {kind!r}; known are ridge, lasso and linear")
    w = w / spread
    return np.concatenate(([level - w @ mean], w))


def _lasso(z: np.ndarray, zy: np.ndarray, alpha: float, rounds: int = 10_000) -> np.ndarray:
    """Coordinate descent on the normal equations."""
    w = np.zeros(len(zy))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            if z[j, j] > 0:
                free = zy[j] - z[j] @ w + z[j, j] * w[j]
                w[j] = np.sign(free) * max(abs(free) - alpha, 0) / z[j, j]
        if np.abs(w - before).max(initial=0) <= 1e-12 * max(1.0, np.abs(w).max(initial=0)):
            break
    return w


def _absolute_errors(rows: DataFrame, stretch: Column, columns: list[Column], fits: np.ndarray) -> np.ndarray:
    """folds x trials: sums of absolute test errors; ``fits`` is folds x trials x (1 + features)."""
    folds, trials, _ = fits.shape

    def score(batches):
        sums = np.zeros((folds, trials))
        for batch in batches:
            s = batch.column(0).to_numpy()
            data = np.column_stack([c.to_numpy() for c in batch.columns[1:]])
            for f in range(folds):
                own = data[s == f + 1]
                if len(own):
                    guess = fits[f, :, 0] + own[:, :-1] @ fits[f, :, 1:].T
                    sums[f] += np.abs(own[:, -1:] - guess).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(folds * trials)), pa.array(sums.ravel())], names=["i", "v"])

    inputs = rows.select(stretch.alias("_s"), *[c.cast("double").alias(f"_c{i}") for i, c in enumerate(columns)]).filter("_s > 0")
    found = inputs.mapInArrow(score, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(folds * trials)
    for r in found:  # a row for each fold and trial
        out[r["i"]] = r["v"]
    return out.reshape(folds, trials)


def regression_trials(numbered: DataFrame, features: list[str], target: str, trials: list[dict], n_splits: int,
                      above: float | None = None) -> list[dict]:
    """For each trial the MAE, RMSE and R2 of every fold (lists).  ``above``: only rows whose target exceeds it take part."""
    stretch, bounds = stretches(numbered, n_splits)
    rows = numbered.filter(F.col(target) > above) if above is not None else numbered.filter(F.col(target).isNotNull())
    columns = [*map(F.col, features), F.col(target)]
    parts = cross_products(rows, stretch, columns, n_splits + 1)
    until = parts.cumsum(0)
    used = [f for f, *_ in bounds if until[f][0, 0] > 0 and parts[f + 1][0, 0] > 0]
    fits = np.zeros((n_splits, len(trials), len(features) + 1))
    for f in used:
        fits[f] = [fit_from_products(until[f], p) for p in trials]
    errors = _absolute_errors(rows, stretch, columns, fits)
    out: list[dict] = [{"MAE": [], "RMSE": [], "R2": [], "fits": []} for _ in trials]
    for f in used:
        test = parts[f + 1]
        n = test[0, 0]
        spread = test[-1, -1] - test[0, -1] ** 2 / n
        for t, fit in enumerate(fits[f]):
            v = np.concatenate((fit, [-1.0]))
            squares = max(float(v @ test @ v), 0.0)
            out[t]["MAE"].append(float(errors[f, t] / n))
            out[t]["RMSE"].append((squares / n) ** 0.5)
            out[t]["R2"].append(1 - squares / spread if spread > 0 else float("nan"))
            out[t]["fits"].append(fit.tolist())
    return out


def _newton_sums(rows: DataFrame, stretch: Column, columns: list[Column], fits: np.ndarray, scales: list) -> np.ndarray:
    """folds x trials x (1 + k) x (2 + k): gradients and curvatures of the log loss at these coefficients."""
    folds, trials, size = fits.shape

    def add(batches):
        sums = np.zeros((folds, trials, size, size + 1))
        for batch in batches:
            s = batch.column(0).to_numpy()
            data = np.column_stack([c.to_numpy() for c in batch.columns[1:]])
            for f in range(folds):
                own = data[s <= f]
                if not len(own) or scales[f] is None:
                    continue
                mean, spread = scales[f]
                z = np.column_stack((np.ones(len(own)), (own[:, :-1] - mean) / spread))
                chance = 1 / (1 + np.exp(-np.clip(z @ fits[f].T, -500, 500)))
                sums[f, :, :, 0] += (chance - own[:, -1:]).T @ z
                weight = chance * (1 - chance)
                for i in range(size):
                    sums[f, :, i, 1:] += weight.T @ (z * z[:, i: i + 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["i", "v"])

    inputs = rows.select(stretch.alias("_s"), *[c.cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    found = inputs.mapInArrow(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(folds * trials * size * (size + 1))
    for r in found:  # sums of the models, a few numbers each
        out[r["i"]] = r["v"]
    return out.reshape(folds, trials, size, size + 1)


def fit_logistic(rows: DataFrame, stretch: Column, columns: list[Column], trials: list[dict], n_splits: int) -> tuple[np.ndarray, list]:
    """(folds x trials x (1 + k) coefficients on scaled features, scaling of each fold; None: one class only)."""
    parts = cross_products(rows, stretch, columns, n_splits + 1)
    until = parts.cumsum(0)
    rain, count = until[:, 0, -1], until[:, 0, 0]
    scales: list = [[scaling(until[f], p.get("normalize_features", True)) for p in trials[:1]][0] if 0 < rain[f] < count[f] else None
                    for f in range(n_splits)]
    penalty = np.array([1 / float(p.get("C", 1.0)) for p in trials])
    fits = np.zeros((n_splits, len(trials), len(columns)))
    ridge = np.diag([0.0, *[1.0] * (len(columns) - 1)])
    for _ in range(NEWTON_STEPS):
        sums = _newton_sums(rows, stretch, columns, fits, scales)
        moved = 0.0
        for f in range(n_splits):
            if scales[f] is None:
                continue
            for t in range(len(trials)):
                w, own = fits[f, t], penalty[t] * ridge
                step = np.linalg.lstsq(sums[f, t, :, 1:] + own, sums[f, t, :, 0] + own @ w, rcond=None)[0]
                step *= min(1.0, 20 / max(np.abs(step).max(), 1e-300))
                fits[f, t] -= step
                moved = max(moved, np.abs(step).max())
        if moved <= NEWTON_SIZE:
            break
    return fits, scales


def classification_trials(numbered: DataFrame, features: list[str], target: str, above: float, trials: list[dict], n_splits: int) -> list[list[float]]:
    """For each trial the AUC of every fold with both classes, by logistic regression of the given C."""
    stretch, _ = stretches(numbered, n_splits)
    rows = numbered.filter(F.col(target).isNotNull())
    rain = (F.col(target) > above).cast("double")
    fits, scales = fit_logistic(rows, stretch, [*map(F.col, features), rain], trials, n_splits)
    raw = []
    for f in range(n_splits):
        if scales[f] is None:
            raw.append(None)
            continue
        mean, spread = scales[f]
        w = fits[f, :, 1:] / spread
        raw.append(np.column_stack((fits[f, :, 0] - w @ mean, w)))

    def score(batches):
        for batch in batches:
            s, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.column_stack([c.to_numpy() for c in batch.columns[2:]])
            for f in range(n_splits):
                own = s == f + 1
                if raw[f] is None or not own.any():
                    continue
                lines = raw[f][:, :1] + raw[f][:, 1:] @ x[own].T
                n = int(own.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n * len(trials), f, np.int32)), pa.array(np.repeat(np.arange(len(trials), dtype=np.int32), n)),
                     pa.array(np.tile(label[own].astype(np.int32), len(trials))), pa.array(lines.ravel())], names=["fold", "trial", "rain", "line"])

    inputs = rows.select(stretch.alias("_s"), rain.alias("_r"), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(features)]).filter("_s > 0")
    scored = inputs.mapInArrow(score, "fold int, trial int, rain int, line double")
    # The order of the linear predictor is that of the chance.
    found = roc_auc(scored, "rain", "line", ["fold", "trial"]).collect()
    out: list[list[float]] = [[] for _ in trials]
    for r in sorted(found, key=lambda r: (r["trial"], r["fold"])):
        if r["ROC_AUC"] is not None:
            out[r["trial"]].append(float(r["ROC_AUC"]))
    return out


def search_table(numbered: DataFrame, features: list[str], target: str, trials: list[dict], n_splits: int = 3) -> DataFrame:
    """(trial, regression_type, alpha, MAE, RMSE, R2): mean scores of every trial over the folds."""
    scores = regression_trials(numbered, features, target, trials, n_splits)
    rows = [(t, p.get("regression_type", "ridge"), float(p.get("alpha", 1.0)), *[float(np.mean(s[m])) for m in ("MAE", "RMSE", "R2")])
            for t, (p, s) in enumerate(zip(trials, scores, strict=True))]
    return numbered.sparkSession.createDataFrame(rows, "trial int, regression_type string, alpha double, MAE double, RMSE double, R2 double")

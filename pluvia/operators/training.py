"""Cross-validation, parameter search and training of several rain models."""

from __future__ import annotations

import dataclasses
import math
import random
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators.evaluation import (
    fold_bounds,
    prepare_data,
    regression_aggregates,
    roc_auc,
)
from pluvia.operators.linear_search import classification_trials, regression_trials
from pluvia.operators.rain_models import RainModel


def _fold_scores(
    model: RainModel, train: DataFrame, test: DataFrame, rows_bound: int | None = None
) -> dict[str, float | None]:
    """AUC (both classes present) and amount errors of one fold; a two-stage
    model is judged on its rainy days, a single-stage one on all days."""
    scored = model.fit(train).predict(test)
    rain = F.col(model.target) > model.classification_threshold
    rows = scored.withColumn("_rain", rain.cast("int"))
    score = "p_rain" if model.two_stage else "_hit"
    if not model.two_stage:
        rows = rows.withColumn("_hit", (F.col("amount") > model.classification_threshold).cast("double"))
    truth = F.when(rain, F.col(model.target)) if model.two_stage else F.col(model.target)
    made = regression_aggregates(truth.cast("double"), F.col("amount"))
    errors = rows.agg(*[c.alias(n) for n, c in made.items()]).first().asDict()
    auc = roc_auc(rows, "_rain", score, rows_bound=rows_bound).first()
    return {"ROC_AUC": auc["ROC_AUC"] if auc else None, **errors}


def _folds(numbered: DataFrame, n_splits: int):
    """(test rows, train, test) of every fold."""
    for _, train_end, test_end in fold_bounds(numbered.count(), n_splits):
        pos = F.col("_pos")
        test = numbered.filter((pos >= train_end) & (pos < test_end))
        yield test_end - train_end, numbered.filter(pos < train_end), test


def cross_validate(model: RainModel, numbered: DataFrame, n_splits: int = 5) -> DataFrame:
    """(metric, mean, std, scores, folds, failed_folds, errors) over expanding-window folds.

    ``numbered`` carries ``_pos``.  ``folds`` counts the folds that have the metric; a fold that cannot be fitted is
    counted in ``failed_folds`` and its error is listed."""
    scores: dict[str, list[float]] = {"ROC_AUC": [], "MAE": [], "RMSE": [], "R2": []}
    errors = []
    for size, train, test in _folds(numbered, n_splits):
        try:
            found = _fold_scores(model, train, test, size)
        except Exception as e:
            errors.append(f"{type(e).__name__}: {str(e)[:300]}")
            continue
        for name, value in found.items():
            if value is not None and not math.isnan(value):
                scores[name].append(float(value))
    rows = []
    for name, values in scores.items():
        mean = sum(values) / len(values) if values else None
        std = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)) if values else None
        if values or errors:
            rows.append((name, mean, std, values, len(values), len(errors), errors))
    return numbered.sparkSession.createDataFrame(
        rows, "metric string, mean double, std double, scores array<double>, folds int, failed_folds int, errors array<string>"
    )


def draw(space: dict[str, dict], rng: random.Random) -> dict:
    """One parameter set from {name: {type, choices | low, high}}."""
    out = {}
    for name, spec in space.items():
        kind = spec["type"]
        if kind == "categorical":
            out[name] = rng.choice(spec["choices"])
        elif kind == "int":
            out[name] = rng.randint(spec["low"], spec["high"])
        elif kind == "float":
            out[name] = rng.uniform(spec["low"], spec["high"])
        elif kind == "loguniform":
            out[name] = math.exp(rng.uniform(math.log(spec["low"]), math.log(spec["high"])))
        else:
            raise ValueError(f"unknown parameter type {kind!r}")
    return out


#: Trials that run at the same time; their fits share the cluster.
PARALLEL_TRIALS = 4


def _best(drawn: list[dict], values: list[float], maximise: bool) -> dict:
    best = max(values) if maximise else min(values)
    return drawn[values.index(best)]


def _draws(space: dict, trials: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    return [draw(space, rng) for _ in range(trials)]


#: Parameters that ``linear_search`` knows; trials of others, and of other families, are fitted one by one.
SUMMED = {"alpha", "regression_type", "normalize_features"}


def _from_sums(model: RainModel, space: dict, fixed: dict, known: set[str]) -> bool:
    return model.family == "linear" and set(space) <= known and set(fixed) <= known | {"C", "max_iter"}


def _search(space, trials, seed, score, maximise) -> dict:
    """Seeded random search; trials are drawn first and run a few at a time.  A failed trial counts as the worst, and
    if all fail the last error is raised."""
    drawn = _draws(space, trials, seed)
    worst = -math.inf if maximise else math.inf
    errors = []

    def run(params):
        try:
            return score(params)
        except Exception as e:
            errors.append(e)
            return worst

    with ThreadPoolExecutor(PARALLEL_TRIALS) as pool:
        values = list(pool.map(run, drawn))
    if errors and len(errors) == trials:
        raise errors[-1]
    return _best(drawn, values, maximise)


def _classifier_auc(model: RainModel, train: DataFrame, test: DataFrame, rows_bound: int) -> float | None:
    """AUC of the rain label; the amount model plays no part in it."""
    fitted = model.fit_classifier(model.labelled(train))
    scored = fitted.transform(model.labelled(test)).withColumn("p_rain", vector_to_array("probability")[1])
    auc = roc_auc(scored.withColumn("_rain", F.col("_rain").cast("int")), "_rain", "p_rain", rows_bound=rows_bound).first()
    return auc["ROC_AUC"] if auc else None


def _rainy_mae(model: RainModel, train: DataFrame, test: DataFrame) -> float | None:
    """Mean absolute error of the amount on rainy rows; the classifier plays no part in it."""
    fitted = model.fit_amount(model.labelled(train).filter("_rain = 1"))
    wet = model.labelled(test).filter("_rain = 1")
    if fitted is None:
        return wet.agg(F.avg(F.abs("_y"))).first()[0]
    return fitted.transform(wet).agg(F.avg(F.abs(F.col("_y") - F.col("prediction")))).first()[0]


def _mean(values: list[float | None], empty: float) -> float:
    kept = [v for v in values if v is not None]
    return sum(kept) / len(kept) if kept else empty


def search_two_stage(
    model: RainModel, numbered: DataFrame, classification_space: dict, regression_space: dict,
    n_trials: int = 100, n_splits: int = 3, seed: int = 42,
) -> tuple[dict, dict]:
    """Half the trials maximise the classifier's cross-validated AUC, the other half
    minimise the amount model's rainy-day MAE; neither depends on the other model.
    Linear models of all trials are fitted and scored together (``linear_search``)."""
    trials, limit = max(1, n_trials // 2), model.classification_threshold
    folds = list(_folds(numbered, n_splits))

    def auc(params):
        chosen = dataclasses.replace(model, classification_params=params)
        return _mean([_classifier_auc(chosen, train, test, size) for size, train, test in folds], 0.0)

    if _from_sums(model, classification_space, model.params, {"C"}):
        drawn = _draws(classification_space, trials, seed)
        found = classification_trials(numbered, model.features, model.target, limit, [{**model.params, **p} for p in drawn], n_splits)
        best_c = _best(drawn, [_mean(v, 0.0) for v in found], True)
    else:
        best_c = _search(classification_space, trials, seed, auc, True)

    def mae(params):
        chosen = dataclasses.replace(model, regression_params=params)
        return _mean([_rainy_mae(chosen, train, test) for _, train, test in folds], math.inf)

    if _from_sums(model, regression_space, model.params, SUMMED):
        drawn = _draws(regression_space, trials, seed)
        found = regression_trials(numbered, model.features, model.target, [{**model.params, **p} for p in drawn], n_splits, limit)
        return best_c, _best(drawn, [_mean(v["MAE"], math.inf) for v in found], False)
    return best_c, _search(regression_space, trials, seed, mae, False)


def search_single_stage(
    model: RainModel, numbered: DataFrame, space: dict, metric: str = "mae", n_trials: int = 100,
    n_splits: int = 3, seed: int = 42,
) -> dict:
    """Minimises mae or rmse, or maximises r2, over the folds."""
    name, maximise = {"mae": "MAE", "rmse": "RMSE", "r2": "R2"}[metric], metric == "r2"
    worst = -math.inf if maximise else math.inf
    if _from_sums(model, space, model.params, SUMMED):
        drawn = _draws(space, n_trials, seed)
        found = regression_trials(numbered, model.features, model.target, [{**model.params, **p} for p in drawn], n_splits)
        return _best(drawn, [_mean(v[name], worst) for v in found], maximise)
    folds = list(_folds(numbered, n_splits))

    def score(params):
        one = dataclasses.replace(model, two_stage=False, params={**model.params, **params})
        return _mean([_fold_scores(one, train, test, size)[name] for size, train, test in folds], worst)

    return _search(space, n_trials, seed, score, maximise)


def train_with_search(
    model: RainModel, numbered: DataFrame, spaces: dict, n_trials: int = 100, n_splits: int = 3, seed: int = 42,
):
    """(fitted model with the best parameters, what was found and how long it took)."""
    start = time.time()
    if model.two_stage:
        c, r = search_two_stage(
            model, numbered, spaces["classification"], spaces["regression"], n_trials, n_splits, seed
        )
        chosen = dataclasses.replace(model, classification_params=c, regression_params=r)
        found = {"best_classification_params": c, "best_regression_params": r}
    else:
        best = search_single_stage(model, numbered, spaces["single_stage"], "mae", n_trials, n_splits, seed)
        chosen = dataclasses.replace(model, params={**model.params, **best})
        found = {"best_params": best}
    return chosen.fit(numbered), {**found, "optimization_time": time.time() - start}


def train_models(
    df: DataFrame, target: str, models: dict[str, RainModel], features: list[str], order: str,
    ties: tuple[str, ...] = (), spaces: dict[str, dict] | None = None, n_trials: int = 100,
    cv_splits: int = 5, test_size: float = 0.2, seed: int = 42,
) -> dict[str, dict]:
    """Prepare once, then per model: (search), fit, hold-out metrics, cross-validation.

    An error is kept under its model's name.
    """
    train, test = prepare_data(df, target, features, order, ties, test_size)
    out: dict[str, dict] = {}
    for name, model in models.items():
        start = time.time()
        try:
            if spaces and name in spaces:
                fitted, found = train_with_search(
                    model, train, spaces[name], n_trials, max(3, cv_splits - 2), seed
                )
            else:
                fitted, found = model.fit(train), None
            out[name] = {
                "model": fitted, "evaluation": fitted.evaluate(test),
                "cross_validation": cross_validate(fitted.model, train, cv_splits),
                "optimization": found, "training_time": time.time() - start,
            }
        except Exception as e:
            out[name] = {"error": f"{type(e).__name__}: {e}"}
    return out


def results_table(spark, results: dict[str, dict]) -> DataFrame:
    """One row per model: its hold-out metrics, or its error."""
    out = None
    for name, one in results.items():
        if "error" in one:
            row = spark.createDataFrame([(name, one["error"])], "model string, error string")
        else:
            row = one["evaluation"].select(F.lit(name).alias("model"), F.lit(None).cast("string").alias("error"), "*")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out

"""Fits and scores from cross products against fits of the rows themselves."""

import numpy as np
import pandas as pd
import pytest

from pluvia.operators import evaluation as ev
from pluvia.operators import linear_search as ls
from pluvia.operators import rain_models as rm
from pluvia.operators import training as tr

N, SPLITS = 400, 3


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    a, b = rng.normal(5, 3, N), rng.gamma(2, 4, N)
    y = np.maximum(0, 0.8 * a - 0.3 * b + rng.normal(0, 2, N))
    return pd.DataFrame({"a": a, "b": b, "same": a * 0 + 2.0, "y": y, "_pos": np.arange(N)})


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data).repartition(4).cache()


def folds(data):
    for f, start, stop in tr.fold_bounds(N, SPLITS):
        yield data.iloc[:start], data.iloc[start:stop]


def ridge(train, alpha, features):
    x, y = train[features].to_numpy(), train["y"].to_numpy()
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z = (x - mean) / sd
    w = np.linalg.pinv(z.T @ z + alpha * np.eye(len(features))) @ z.T @ (y - y.mean())
    return lambda t: y.mean() + ((t[features].to_numpy() - mean) / sd) @ w


@pytest.mark.parametrize("above", [None, 0.1])
def test_ridge_trials(rows, data, above):
    features, trials = ["a", "b", "same"], [{"alpha": 0.1}, {"alpha": 50.0}, {"regression_type": "linear"}]
    got = ls.regression_trials(rows, features, "y", trials, SPLITS, above)
    for t, p in enumerate(trials):
        for i, (train, test) in enumerate(folds(data)):
            if above is not None:
                train, test = train[train["y"] > above], test[test["y"] > above]
            guess = ridge(train, p.get("alpha", 0.0), features)(test)
            miss = test["y"] - guess
            assert got[t]["MAE"][i] == pytest.approx(np.abs(miss).mean(), rel=1e-8)
            assert got[t]["RMSE"][i] == pytest.approx(np.sqrt((miss ** 2).mean()), rel=1e-8)
            assert got[t]["R2"][i] == pytest.approx(1 - (miss ** 2).sum() / ((test["y"] - test["y"].mean()) ** 2).sum(), rel=1e-8)


def test_lasso_meets_its_conditions(rows, data):
    alpha = 0.3
    got = ls.regression_trials(rows, ["a", "b"], "y", [{"regression_type": "lasso", "alpha": alpha}], SPLITS)[0]
    for (train, _), fit in zip(folds(data), got["fits"], strict=True):
        x, y = train[["a", "b"]].to_numpy(), train["y"].to_numpy()
        z = (x - x.mean(0)) / x.std(0)
        rest = y - fit[0] - x @ np.array(fit[1:])
        slope = z.T @ rest / len(y)  # the optimum: each slope is alpha at a coefficient that is not zero, at most alpha at others
        for s, w in zip(slope, np.array(fit[1:]) * x.std(0), strict=True):
            assert s == pytest.approx(alpha * np.sign(w), abs=1e-8) if w else abs(s) <= alpha + 1e-8


def test_logistic_trials(rows, data):
    trials = [{"C": 0.01}, {"C": 1.0}, {"C": 100.0}]
    stretch, _ = ls.stretches(rows, SPLITS)
    rain = (ls.F.col("y") > 0.1).cast("double")
    fits, scales = ls.fit_logistic(rows, stretch, [ls.F.col("a"), ls.F.col("b"), rain], trials, SPLITS)
    aucs = ls.classification_trials(rows, ["a", "b"], "y", 0.1, trials, SPLITS)
    for i, (train, test) in enumerate(folds(data)):
        x, y = train[["a", "b"]].to_numpy(), (train["y"] > 0.1).to_numpy(float)
        mean, sd = scales[i]
        np.testing.assert_allclose(mean, x.mean(0))
        np.testing.assert_allclose(sd, x.std(0))
        z = np.column_stack((np.ones(len(x)), (x - mean) / sd))
        for t, p in enumerate(trials):
            w = fits[i, t]
            slope = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.array([0, *w[1:]]) / p["C"]
            np.testing.assert_allclose(slope, 0, atol=1e-6)
            line = (test[["a", "b"]].to_numpy() - mean) / sd @ w[1:]
            wet = (test["y"] > 0.1).to_numpy()
            pairs = line[wet][:, None] - line[~wet][None, :]
            assert aucs[t][i] == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean())


def test_searches_take_the_best_trial(rows, data, monkeypatch):
    model = rm.RainModel("linear", ["a", "b"], "y", two_stage=False)
    space = {"regression_type": {"type": "categorical", "choices": ["ridge", "lasso"]}, "alpha": {"type": "loguniform", "low": 0.01, "high": 10.0}}
    monkeypatch.setattr(tr, "_fold_scores", None)  # nothing is fitted one by one
    best = tr.search_single_stage(model, rows, space, n_trials=40)
    drawn = tr._draws(space, 40, 42)
    scores = ls.regression_trials(rows, ["a", "b"], "y", drawn, 3)
    assert best == min(zip(drawn, scores, strict=True), key=lambda x: np.mean(x[1]["MAE"]))[0]
    c, r = tr.search_two_stage(rm.RainModel("linear", ["a", "b"], "y"), rows, {"C": {"type": "loguniform", "low": 0.1, "high": 10.0}},
                               {"alpha": {"type": "float", "low": 0.1, "high": 5.0}}, n_trials=10)
    assert 0.1 <= c["C"] <= 10 and 0.1 <= r["alpha"] <= 5


def test_a_fold_of_one_class_has_no_score(spark, data):
    dry = spark.createDataFrame(data.assign(y=np.where(data["_pos"] < 250, 0.0, data["y"])))
    found = ls.classification_trials(dry, ["a"], "y", 0.1, [{"C": 1.0}], SPLITS)
    assert len(found[0]) < SPLITS


def test_rows_are_numbered_by_day(spark):
    """Null days first, ties inside a day, and the route in pieces for a day that is too large."""
    rng = np.random.default_rng(1)
    rows = [(None if d == 0 else int(d), i) for i, d in enumerate(rng.integers(0, 9, 200))]
    df = spark.createDataFrame(rows, "day int, id int").repartition(5)
    want = {i: p for p, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    for block_rows in (None, 100, 5):
        assert {r.id: r["_pos"] for r in ev.numbered_rows(df, "day", ["id"], block_rows).collect()} == want
    assert ev.numbered_rows(df.limit(0), "day", ["id"]).count() == 0

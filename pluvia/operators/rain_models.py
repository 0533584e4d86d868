"""Two-stage and single-stage rain models on MLlib.

Stage one classifies rain or no rain on all rows, stage two regresses the
amount on rainy rows; a single-stage model regresses on all rows.  A family
supplies the estimators; subclass ``Family`` to add one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia import constants as C
from pluvia.operators.evaluation import combined_prediction, evaluate_single_stage, evaluate_two_stage

SEED = 42


class Family:
    """Estimator factory.  ``rows`` and ``label_std`` describe the training rows."""

    scaled = False

    def classifier(self, params: dict, rows: int) -> Estimator:
        raise NotImplementedError

    def regressor(self, params: dict, rows: int, label_std: float) -> Estimator:
        raise NotImplementedError


class Linear(Family):
    """Logistic regression, and ridge, lasso or plain least squares.

    MLlib's penalties are per row and relative to the label's spread, so they
    are rescaled to ``alpha`` on the sum of squares (ridge), ``alpha`` on the
    mean (lasso) and ``C`` of the logistic loss; the factor (n - 1) / n turns
    the scaler's sample deviation into the population one.
    """

    scaled = True

    def classifier(self, params, rows):
        inverse = float(params.get("C", 1.0))
        ratio = self._ratio(params, rows)
        return LogisticRegression(
            maxIter=int(params.get("max_iter", 1000)), regParam=ratio / (inverse * rows),
            standardization=False, tol=1e-7,
        )

    def regressor(self, params, rows, label_std):
        kind, alpha = params.get("regression_type", "ridge"), float(params.get("alpha", 1.0))
        ratio = self._ratio(params, rows)
        common = {"standardization": False, "maxIter": 1000, "tol": 1e-8}
        if kind == "ridge":
            return LinearRegression(
                regParam=alpha * ratio * label_std / rows, elasticNetParam=0.0, solver="normal", **common
            )
        if kind == "lasso":
            return LinearRegression(regParam=alpha * ratio ** 0.5, elasticNetParam=1.0, **common)
        if kind == "linear":
            return LinearRegression(regParam=0.0, **common)
        raise ValueError(f"unknown regression type {kind!r}; known are ridge, lasso and linear")

    @staticmethod
    def _ratio(params: dict, rows: int) -> float:
        return (rows - 1) / rows if params.get("normalize_features", True) and rows > 1 else 1.0


class Forest(Family):
    """Random forest; a missing depth means MLlib's limit of 30."""

    def _settings(self, params, subset):
        return {
            "numTrees": int(params.get("n_estimators", 100)), "maxDepth": int(params.get("max_depth") or 30),
            "minInstancesPerNode": int(params.get("min_samples_leaf", 1)), "featureSubsetStrategy": subset,
            "seed": int(params.get("random_state", SEED)),
        }

    def classifier(self, params, rows):
        return RandomForestClassifier(**self._settings(params, "sqrt"))

    def regressor(self, params, rows, label_std):
        return RandomForestRegressor(**self._settings(params, "all"))


class Boosted(Family):
    """Gradient boosting, 100 rounds of depth 6 by default."""

    defaults = {"max_depth": 6, "min_child": 1}

    def _settings(self, params):
        return {
            "maxIter": int(params.get("n_estimators", 100)),
            "maxDepth": int(params.get("max_depth", self.defaults["max_depth"])),
            "stepSize": float(params.get("learning_rate", 0.1)),
            "subsamplingRate": float(params.get("subsample", 0.8)),
            "featureSubsetStrategy": str(params.get("colsample", 0.8)),
            "minInstancesPerNode": int(params.get("min_child", self.defaults["min_child"])),
            "seed": int(params.get("random_state", SEED)),
        }

    def classifier(self, params, rows):
        return GBTClassifier(**self._settings(params))

    def regressor(self, params, rows, label_std):
        return GBTRegressor(**self._settings(params))


class BoostedSmallLeaves(Boosted):
    """Boosting with about 31 leaves (depth 5) and at least 20 rows per leaf."""

    defaults = {"max_depth": 5, "min_child": 20}


FAMILIES: dict[str, Family] = {
    "linear": Linear(), "random_forest": Forest(), "xgboost": Boosted(), "lightgbm": BoostedSmallLeaves(),
}


@dataclass(frozen=True)
class RainModel:
    """What to fit: family name or object, feature columns, target, parameters."""

    family: str | Family
    features: list[str]
    target: str
    two_stage: bool = True
    classification_threshold: float = C.RAIN_THRESHOLD
    params: dict = field(default_factory=dict)
    classification_params: dict = field(default_factory=dict)
    regression_params: dict = field(default_factory=dict)

    @property
    def maker(self) -> Family:
        return FAMILIES[self.family] if isinstance(self.family, str) else self.family

    def labelled(self, df: DataFrame) -> DataFrame:
        """Adds the amount ``_y`` and the rain label ``_rain``."""
        label = F.col(self.target).cast("double")
        return df.withColumns({
            "_y": label, "_rain": (F.col(self.target) > self.classification_threshold).cast("double"),
        })

    def fit_classifier(self, rows: DataFrame) -> PipelineModel:
        params = {**self.params, **self.classification_params}
        estimator = self.maker.classifier(params, rows.count())
        estimator.setLabelCol("_rain")
        return Pipeline(stages=[*self._inputs(params), estimator.setFeaturesCol("_x")]).fit(rows)

    def fit_amount(self, rows: DataFrame) -> PipelineModel | None:
        return self._regression(rows, {**self.params, **self.regression_params})

    def fit(self, df: DataFrame) -> "FittedRainModel":
        rows = self.labelled(df)
        if not self.two_stage:
            return FittedRainModel(self, single=self.fit_amount(rows))
        return FittedRainModel(self, classifier=self.fit_classifier(rows), regressor=self.fit_amount(rows.filter("_rain = 1")))

    def _regression(self, rows: DataFrame, params: dict) -> PipelineModel | None:
        facts = rows.agg(F.count("_y").alias("n"), F.stddev_pop("_y").alias("sd")).first()
        if not facts["n"]:
            return None
        estimator = self.maker.regressor(params, facts["n"], facts["sd"] or 1.0)
        estimator.setLabelCol("_y")
        return Pipeline(stages=[*self._inputs(params), estimator.setFeaturesCol("_x")]).fit(rows)

    def _inputs(self, params: dict) -> list:
        if self.maker.scaled and params.get("normalize_features", True):
            return [
                VectorAssembler(inputCols=self.features, outputCol="_raw"),
                StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
            ]
        return [VectorAssembler(inputCols=self.features, outputCol="_x")]


@dataclass(frozen=True)
class FittedRainModel:
    model: RainModel
    classifier: PipelineModel | None = None
    regressor: PipelineModel | None = None
    single: PipelineModel | None = None

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Adds p_rain, amount and combined (two-stage) or amount (single-stage)."""
        kept = df.columns
        if not self.model.two_stage:
            return self.single.transform(df).withColumnRenamed("prediction", "amount").select(*kept, "amount")
        scored = self.classifier.transform(df).withColumn(
            "p_rain", vector_to_array("probability")[1]
        ).select(*kept, "p_rain")
        if self.regressor is None:
            both = scored.withColumn("amount", F.lit(0.0))
        else:
            both = self.regressor.transform(scored).withColumnRenamed("prediction", "amount").select(
                *kept, "p_rain", "amount"
            )
        return both.withColumn("combined", combined_prediction(F.col("p_rain"), F.col("amount"), threshold))

    def evaluate(self, df: DataFrame) -> DataFrame:
        """One row of test metrics."""
        scored = self.predict(df)
        if self.model.two_stage:
            return evaluate_two_stage(
                scored, self.model.target, "p_rain", "amount", self.model.classification_threshold
            )
        return evaluate_single_stage(scored, self.model.target, "amount")

    def _stages(self) -> dict[str, PipelineModel]:
        named = {"classification": self.classifier, "regression": self.regressor, "single_stage": self.single}
        return {n: m for n, m in named.items() if m is not None}

    def coefficients(self, spark) -> DataFrame:
        """(stage, feature, coefficient), the intercept under its own name."""
        rows = []
        for stage, fitted in self._stages().items():
            last = fitted.stages[-1]
            rows += [(stage, f, float(c)) for f, c in zip(self.model.features, last.coefficients.toArray())]
            rows.append((stage, "intercept", float(last.intercept)))
        return spark.createDataFrame(rows, "stage string, feature string, coefficient double")

    def feature_importance(self, spark) -> DataFrame:
        """(stage, feature, importance) of tree families."""
        rows = [
            (stage, f, float(v)) for stage, fitted in self._stages().items()
            for f, v in zip(self.model.features, fitted.stages[-1].featureImportances.toArray())
        ]
        return spark.createDataFrame(rows, "stage string, feature string, importance double")


def compare_approaches(fitted: list[FittedRainModel], test: DataFrame) -> DataFrame:
    """One row per fitted model: approach, test rows and its metrics."""
    out = None
    for one in fitted:
        row = one.evaluate(test).select(
            F.lit(str(one.model.family)).alias("family"),
            F.lit("two_stage" if one.model.two_stage else "single_stage").alias("approach"), "*",
        )
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out

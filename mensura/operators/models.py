"""Tree models through ``pyspark.ml``: fitting, grouped cross-validation, sampled search, comparison, storage."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.operators.evaluation import residuals

FAMILIES = ("forest", "boosted")

# Search spaces: name -> (kind, low, high) or (kind, choices); depth is bounded by what Spark's trees allow (30).
SPACES: dict[str, dict[str, tuple]] = {
    "forest": {
        "numTrees": ("step", 150, 600, 50), "maxDepth": ("int", 8, 30), "minInstancesPerNode": ("int", 1, 8),
        "featureSubsetStrategy": ("choice", ["sqrt", "log2", "all"]), "bootstrap": ("choice", [True, False]),
        "minInfoGain": ("log", 1e-8, 1e-2),
    },
    "boosted": {
        "maxIter": ("step", 150, 700, 50), "maxDepth": ("int", 2, 10), "stepSize": ("log", 0.01, 0.2),
        "subsamplingRate": ("float", 0.55, 1.0), "featureSubsetStrategy": ("fraction", 0.55, 1.0),
        "minInstancesPerNode": ("int", 1, 12),
    },
}

AT_ONCE = {"forest": 2, "boosted": 8}  # trials fitted side by side: forests are whole on the driver, boosted trees are many short jobs


def _regressor(family: str, label: str, params: Mapping | None = None, seed: int = fixed.SEED):
    kinds = {"forest": RandomForestRegressor, "boosted": GBTRegressor}
    if family not in kinds:
        raise ValueError(f"unknown model family: {family}")
    # Else each group of nodes sends whole trees to the tasks; the trees are the same.
    own = {"cacheNodeIds": True} if family == "forest" else {}
    return kinds[family](featuresCol="_features", labelCol=label, seed=seed, **{**own, **dict(params or {})})


def _stages(family: str, features: Sequence[str], label: str, params: Mapping | None = None, seed: int = fixed.SEED):
    """Mean imputation fitted with the model, then the assembled vector, then the trees."""
    filled = [f"_filled_{i}" for i in range(len(features))]
    return [
        Imputer(inputCols=list(features), outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="_features", handleInvalid="error"),
        _regressor(family, label, params, seed),
    ]


def _numbers(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in [*features, label]})


def fit(df: DataFrame, family: str, features: Sequence[str], label: str, params: Mapping | None = None,
        seed: int = fixed.SEED) -> PipelineModel:
    return Pipeline(stages=_stages(family, features, label, params, seed)).fit(_numbers(df, features, label))


def fit_forest(df: DataFrame, features: Sequence[str], label: str, params: Mapping | None = None) -> PipelineModel:
    return fit(df, "forest", features, label, params)


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, params: Mapping | None = None) -> PipelineModel:
    return fit(df, "boosted", features, label, params)


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str,
            row_id: str = "source_index") -> DataFrame:
    """``source_index, actual, predicted, residual``."""
    scored = model.transform(_numbers(df, features, label))
    return residuals(scored.select(F.col(row_id).alias("source_index"), F.col(label).alias("actual"),
                                   F.col("prediction").alias("predicted")))


def draw(space: Mapping[str, tuple], n: int, seed: int = fixed.SEED) -> list[dict]:
    """``n`` settings sampled from a space: int, step, float, log-uniform, choice, or a fraction given as text."""
    dice = random.Random(seed)
    settings = []
    for _ in range(n):
        one = {}
        for name, (kind, *spec) in space.items():
            if kind == "choice":
                one[name] = dice.choice(spec[0])
            elif kind == "int":
                one[name] = dice.randint(*spec)
            elif kind == "step":
                one[name] = dice.randrange(spec[0], spec[1] + 1, spec[2])
            elif kind == "log":
                one[name] = math.exp(dice.uniform(math.log(spec[0]), math.log(spec[1])))
            elif kind == "float":
                one[name] = dice.uniform(*spec)
            elif kind == "fraction":
                one[name] = f"{dice.uniform(*spec):.3f}"
            else:
                raise ValueError(f"unknown kind of range: {kind}")
        settings.append(one)
    return settings


def grouped_cv(df: DataFrame, family: str, features: Sequence[str], label: str, fold: str, settings: Sequence[Mapping],
               folds: int, parallelism: int = 2, seed: int = fixed.SEED) -> DataFrame:
    """Trials table ``number, value (mean MAE over folds), params``; imputation is fitted inside every fold."""
    stages = _stages(family, features, label, seed=seed)
    trees = stages[-1]
    maps = [{trees.getParam(k): v for k, v in one.items()} for one in settings]
    judge = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="mae")
    validator = CrossValidator(
        estimator=Pipeline(stages=stages), estimatorParamMaps=maps, evaluator=judge, numFolds=folds, foldCol=fold,
        parallelism=parallelism, seed=seed,
    )
    rows = _numbers(df, features, label).select(*features, label, F.col(fold).cast("int").alias(fold))
    scores = validator.fit(rows).avgMetrics
    table = [(i, float(v), json.dumps(dict(s), sort_keys=True)) for i, (v, s) in enumerate(zip(scores, settings))]
    return df.sparkSession.createDataFrame(table, "number int, value double, params string")


def search(df: DataFrame, family: str, features: Sequence[str], label: str, fold: str, n: int, folds: int,
           space: Mapping[str, tuple] | None = None, parallelism: int | None = None, seed: int = fixed.SEED) -> DataFrame:
    """Cross-validate ``n`` sampled settings, as many at once as suits the family unless told."""
    settings = draw(space or SPACES[family], n, seed)
    return grouped_cv(df, family, features, label, fold, settings, folds, parallelism or AT_ONCE.get(family, 2), seed)


def best_params(trials: DataFrame) -> dict:
    """Parameters of the trial with the lowest error, the earliest on a tie."""
    return json.loads(trials.orderBy("value", "number").first()["params"])


def fit_predict_best(train: DataFrame, test: DataFrame, family: str, features: Sequence[str], label: str,
                     trials: DataFrame, row_id: str = "source_index", seed: int = fixed.SEED) -> tuple[PipelineModel, DataFrame]:
    """Refit the best setting on all train rows and predict the held-out rows."""
    model = fit(train, family, features, label, best_params(trials), seed)
    return model, predict(model, test, features, label, row_id)


def importances(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, seed: int = fixed.SEED) -> DataFrame:
    """Per feature: forest importance and whether it reaches the mean importance."""
    model = fit(df, "forest", features, label, {"numTrees": trees}, seed)
    scores = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    mean = sum(scores) / len(scores)
    rows = [(f, s, s >= mean) for f, s in zip(features, scores)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, kept boolean")


def save_model(model: PipelineModel, path: str, metadata: Mapping, df: DataFrame) -> None:
    """The fitted model, and its metadata (columns, seed, metrics ...) as a one-row table beside it."""
    model.write().save(path + "/model")
    row = [(k, json.dumps(v, sort_keys=True)) for k, v in metadata.items()]
    df.sparkSession.createDataFrame(row, "name string, value string").coalesce(1).write.parquet(path + "/metadata")


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    table = spark.read.parquet(path + "/metadata")
    return PipelineModel.load(path + "/model"), {r["name"]: json.loads(r["value"]) for r in table.collect()}

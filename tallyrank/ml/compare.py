"""Train and test error of several regressors side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.ml.adaboost import AdaBoostR2
from tallyrank.ml.gradient import GradientBoosting
from tallyrank.ml.knn import knn_predict
from tallyrank.ml.median import MedianBoosting
from tallyrank.ml.split import rmse, with_split
from tallyrank.ml.stack import assembler
from tallyrank.plans.features import FEATURES


def forest(label: str = "rating", trees: int = 400, depth: int = 30, **params) -> RandomForestRegressor:
    """All features at every split; Spark limits the depth to 30."""
    return RandomForestRegressor(
        featuresCol="features", labelCol=label, predictionCol="predicted", numTrees=trees,
        maxDepth=depth, featureSubsetStrategy="all", seed=7, **params,
    )


def gradient_boosting(label: str = "rating", rounds: int = 400, **params) -> GradientBoosting:
    settings = {"lossType": "squared", "stepSize": 0.1, "maxDepth": 3, "seed": 7}
    return GradientBoosting(
        featuresCol="features", labelCol=label, predictionCol="predicted", maxIter=rounds,
        **(settings | params),
    )


def boosting(label: str = "rating", rounds: int = 400, **params) -> AdaBoostR2:
    return AdaBoostR2(
        featuresCol="features", labelCol=label, predictionCol="predicted", maxIter=rounds, **params
    )


def median_boosting(label: str = "rating", rounds: int = 400, **params) -> MedianBoosting:
    return MedianBoosting(
        featuresCol="features", labelCol=label, predictionCol="predicted", maxIter=rounds, **params
    )


def split_errors(predictions: DataFrame, name: str, label: str = "rating", weight: str | None = None) -> DataFrame:
    """(model, split, rmse) rows from predictions that carry their split."""
    return predictions.groupBy("split").agg(rmse(label, "predicted", weight).alias("rmse")).select(
        F.lit(name).alias("model"), "split", "rmse"
    )


def compare_models(
    table: DataFrame, stack=None, *, trees: int = 400, rounds: int = 400, depth: int = 30,
    test_percent: int = 25, neighbours: int = 5, label: str = "rating",
) -> DataFrame:
    """Errors of nearest neighbours, forest, boosting, gradient boosting and a fitted stack."""
    vectors = assembler().transform(with_split(table, test_percent=test_percent))
    train = vectors.where(F.col("split") == "train")
    near = knn_predict(train, vectors, FEATURES, label, k=neighbours)
    rows = [split_errors(vectors.join(near, "id"), "nearest_neighbours", label)]
    for name, estimator in (
        ("forest", forest(label, trees, depth)),
        ("boosting", boosting(label, rounds)),
        ("gradient_boosting", gradient_boosting(label, rounds)),
    ):
        rows.append(split_errors(estimator.fit(train).transform(vectors), name, label))
    if stack is not None:
        rows.append(split_errors(stack.transform(vectors.drop("features")), "stack", label))
    return reduce(DataFrame.unionByName, rows)

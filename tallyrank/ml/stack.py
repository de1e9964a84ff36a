"""The two-stage stack: boosted trees whose score becomes a feature of gradient boosting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.ml import search
from tallyrank.ml.adaboost import AdaBoostR2
from tallyrank.ml.gradient import GradientBoosting
from tallyrank.ml.median import MedianBoosting
from tallyrank.ml.split import train_test_split, with_folds
from tallyrank.plans.features import FEATURES

FIRST = "first_score"


def assembler(features: Sequence[str] = FEATURES, out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out)


def first_stage(label: str = "rating", **params) -> AdaBoostR2:
    return AdaBoostR2(featuresCol="features", labelCol=label, predictionCol=FIRST, **params)


def second_stage(label: str = "rating", **params) -> GradientBoosting:
    settings = {"lossType": "absolute", "stepSize": 0.1, "maxIter": 500, "maxDepth": 3, "seed": 7}
    return GradientBoosting(
        featuresCol="stacked", labelCol=label, predictionCol="predicted", **(settings | params)
    )


def median_stage(label: str = "rating", **params) -> MedianBoosting:
    """A second stage whose leaves are exact medians; it can be searched in stages."""
    settings = {"stepSize": 0.1, "maxIter": 500, "maxDepth": 3, "seed": 7}
    return MedianBoosting(featuresCol="stacked", labelCol=label, predictionCol="predicted", **(settings | params))


def stack_pipeline(first: AdaBoostR2, second: GradientBoosting, features: Sequence[str] = FEATURES) -> Pipeline:
    """Assemble, score with the first stage, assemble with that score, fit the second stage.

    The second stage learns from scores the first gave to its own training rows.
    """
    return Pipeline(stages=[
        assembler(features), first, assembler([*features, FIRST], "stacked"), second,
    ])


def fit_out_of_fold(
    df: DataFrame, first: AdaBoostR2, second: GradientBoosting, folds: int = 4, features: Sequence[str] = FEATURES
) -> PipelineModel:
    """As the pipeline, but the second stage learns from scores of rows the first did not see."""
    vectors, stacked = assembler(features), assembler([*features, FIRST], "stacked")
    tagged = with_folds(vectors.transform(df), folds)
    parts = [
        first.fit(tagged.where(F.col("fold") != i)).transform(tagged.where(F.col("fold") == i))
        for i in range(folds)
    ]
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return PipelineModel(stages=[
        vectors, first.fit(tagged), stacked, second.fit(stacked.transform(scored)),
    ])


@dataclass(frozen=True)
class StackResult:
    """What a training run leaves: the model, its hold-out rows, its errors, and whether the
    second stage got as good as the first on the hold-out rows."""

    model: PipelineModel
    holdout: DataFrame
    errors: dict[tuple[str, str], float]
    reached: bool


def train_stack(
    df: DataFrame, *, first_space=None, second_space=None, draws: int = 2, folds: int = 4,
    max_rounds: int | None = 3, seed: int = 7, parallelism: int = 4, first_params=None, second_params=None,
    label: str = "rating", store: search.Store | None = None,
) -> StackResult:
    """The whole training run on a table without missing values.

    Splits 80/20, takes cross-validated training errors of both stages at their
    defaults, searches the first stage, then searches the second until it beats
    the first on the hold-out rows.
    """
    first, second = first_stage(label, **(first_params or {})), second_stage(label, **(second_params or {}))
    first_space = first_space or search.boosting_space(first)
    second_space = second_space or search.gradient_space(second)
    vectors, stacked = assembler(), assembler([*FEATURES, FIRST], "stacked")
    train, holdout = train_test_split(df)
    train, held = vectors.transform(train), vectors.transform(holdout)
    errors, cached = {}, [train.persist(), held.persist()]
    try:
        errors["first", "train"] = search.cv_rmse(first, train, folds, label, parallelism)
        best_first = search.random_search(
            first, train, first_space, draws, folds, seed, label=label, parallelism=parallelism, store=store
        ).bestModel
        errors["first", "test"] = search.holdout_rmse(best_first, held, FIRST, label)
        train2 = stacked.transform(best_first.transform(train))
        held2 = stacked.transform(best_first.transform(held))
        cached += [train2.persist(), held2.persist()]
        errors["second", "train"] = search.cv_rmse(second, train2, folds + 1, label, parallelism)
        retrained = search.retrain_until(
            second, train2, held2, second_space, errors["first", "test"], max_rounds, draws, folds, seed, label,
            parallelism, store,
        )
    finally:
        for table in cached:
            table.unpersist()
    errors["second", "test"] = min(retrained.errors)
    model = PipelineModel(stages=[vectors, best_first, stacked, retrained.model])
    return StackResult(model, holdout, errors, retrained.reached)


def error_rows(spark: SparkSession, errors: dict[tuple[str, str], float]) -> DataFrame:
    """(stage, split, rmse) rows."""
    return spark.createDataFrame(
        [(stage, split, float(v)) for (stage, split), v in errors.items()],
        "stage string, split string, rmse double",
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def batch_score(model: PipelineModel, table: DataFrame, titles: DataFrame) -> DataFrame:
    """Predictions for all items with the columns to display; the first-stage score goes.

    What is displayed goes along with its row, so only the titles are brought together with the items.
    """
    display = ["views", "rating", "image", "link", "season"]
    scored = model.transform(table.select(*FEATURES, *display)).select(*FEATURES, "predicted", *display)
    return scored.join(titles.select("id", "title"), "id")


def feature_importances(spark: SparkSession, model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, importance) of the second stage."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame(
        list(zip([*features, FIRST], map(float, values))), "feature string, importance double"
    )

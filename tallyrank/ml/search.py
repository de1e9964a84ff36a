"""Cross-validated errors, random search and retraining until a model is good enough.

Staged: a boosted model of many rounds holds all models of fewer. Settings that differ in their
rounds alone share one fit per fold, which is scored at each of the counts. Fits of different
settings and folds run side by side, as one boosting round leaves most of a cluster idle.

Resumable: with a store, the scores of every fold that is done and every model that was chosen are
written under a key made of the settings and the training data; a driver that starts again reads them.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.param import Param
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.ml.split import rmse, with_folds

# The parameter ranges the searches draw from.
BOOST_LOSSES = ("linear", "square", "exponential")
BOOST_RATES = (0.15, 0.25, 0.29, 0.33, 0.5, 0.6, 0.9)
BOOST_ROUNDS = (250, 1500)
GRADIENT_DEPTHS = (3, 4, 5)
GRADIENT_RATES = (0.2, 0.3, 0.4)
GRADIENT_ROUNDS = (500, 3000)


@dataclass(frozen=True)
class Between:
    """Whole numbers from ``low`` up to but without ``high``."""

    low: int
    high: int


def boosting_space(learner: Estimator, rounds: tuple[int, int] = BOOST_ROUNDS) -> dict[Param, object]:
    """What a search of the first stage draws from."""
    return {learner.loss: BOOST_LOSSES, learner.stepSize: BOOST_RATES, learner.maxIter: Between(*rounds)}


def gradient_space(learner: Estimator, rounds: tuple[int, int] = GRADIENT_ROUNDS) -> dict[Param, object]:
    """What a search of the second stage draws from."""
    return {learner.maxDepth: GRADIENT_DEPTHS, learner.stepSize: GRADIENT_RATES, learner.maxIter: Between(*rounds)}


def draw_param_maps(space: dict[Param, object], draws: int, seed: int) -> list[dict[Param, object]]:
    """``draws`` random parameter maps; a space value is a list of choices or a ``Between``."""
    source = random.Random(seed)

    def draw(choice):
        if isinstance(choice, Between):
            return source.randrange(choice.low, choice.high)
        return source.choice(list(choice))

    return [{p: draw(c) for p, c in space.items()} for _ in range(draws)]


class Store:
    """Finished work under a folder that outlives the driver; each entry is written whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def get(self, key: str) -> list[float] | None:
        path = f"{self.path}/scores/{key}"
        if not self._exists(f"{path}/_SUCCESS"):
            return None
        return [r["score"] for r in self.spark.read.parquet(path).orderBy("at").collect()]

    def put(self, key: str, scores: Sequence[float]) -> None:
        rows = [(i, float(s)) for i, s in enumerate(scores)]
        self.spark.createDataFrame(rows, "at int, score double").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/scores/{key}"
        )

    def save(self, key: str, model: Model) -> None:
        model.write().overwrite().save(f"{self.path}/models/{key}")

    def load(self, key: str) -> Model:
        return DefaultParamsReader.loadParamsInstance(f"{self.path}/models/{key}", self.spark)


def fingerprint(df: DataFrame) -> str:
    """Changes with any row of a table, not with their order."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first()
    return f"{row[0]}:{row[1]}"


def _key(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def _named(estimator: Estimator, settings: dict[Param, object]) -> dict[str, object]:
    """All settings of an estimator under a parameter map."""
    return {p.name: v for p, v in estimator.extractParamMap(settings).items()}


def weight_column(learner: Estimator | Model) -> str | None:
    return learner.getOrDefault("weightCol") if learner.hasParam("weightCol") and learner.isDefined("weightCol") else None


def _side_by_side(function, arguments: Iterable[tuple], parallelism: int) -> list:
    """Results of a function that starts Spark jobs, for several arguments at a time."""
    spark = SparkSession.getActiveSession()

    def call(argument: tuple):
        return inheritable_thread_target(spark)(function)(*argument)

    with ThreadPoolExecutor(max_workers=max(parallelism, 1)) as pool:
        return list(pool.map(call, list(arguments)))


def _score(model: Model, test: DataFrame, evaluator: RegressionEvaluator) -> float:
    """What the evaluator says, but for R² of rows with weights: its variance does not count them as repeated rows."""
    scored = model.transform(test)
    if evaluator.getMetricName() != "r2" or not evaluator.isDefined("weightCol"):
        return evaluator.evaluate(scored)
    label, predicted, weight = F.col(evaluator.getLabelCol()), F.col(evaluator.getPredictionCol()), F.col(evaluator.getWeightCol())
    mean = test.agg(F.try_divide(F.sum(weight * label), F.sum(weight))).first()[0]
    lost, spread = (F.sum(weight * F.pow(label - other, F.lit(2.0))) for other in (predicted, F.lit(mean)))
    share = scored.agg(F.try_divide(lost, spread)).first()[0]
    return math.nan if share is None else 1 - share


def _staged_scores(model: Model, rounds: Sequence[int], test: DataFrame, evaluator: RegressionEvaluator) -> list[float]:
    return [_score(model.upto(n), test, evaluator) for n in rounds]


def fold_scores(
    estimator: Estimator, df: DataFrame, settings: Sequence[dict[Param, object]], folds: int, metric: str,
    label: str = "rating", parallelism: int = 4, key: str = "id", store: Store | None = None,
) -> list[list[float]]:
    """For each of the settings its score on every hash fold; nothing is fitted on all rows.

    Rows that carry a ``fold`` keep it; those of an estimator with a weight column count by their weight.
    """
    evaluator = RegressionEvaluator(
        labelCol=label, predictionCol=estimator.getOrDefault("predictionCol"), metricName=metric
    )
    if weight_column(estimator):
        evaluator.setWeightCol(weight_column(estimator))
    tagged = df if "fold" in df.columns else with_folds(df, folds, key)
    data = fingerprint(df) if store else ""
    staged = getattr(type(estimator), "staged", False)
    groups: dict[str, list[int]] = {}
    for i, chosen in enumerate(settings):
        named = _named(estimator, chosen)
        groups.setdefault(_key({k: v for k, v in named.items() if not (staged and k == "maxIter")}), []).append(i)

    def scores(members: list[int], fold: int) -> list[float]:
        rounds = [_named(estimator, settings[i]).get("maxIter") for i in members]
        entry = _key(type(estimator).__name__, [_named(estimator, settings[i]) for i in members], fold, folds, metric, label, data)
        done = store.get(entry) if store else None
        if done is None:
            train, test = tagged.where(F.col("fold") != fold), tagged.where(F.col("fold") == fold)
            if staged:
                model = estimator.fit(train, {**settings[members[0]], estimator.maxIter: max(rounds)})
                done = _staged_scores(model, rounds, test, evaluator)
            else:
                # equal settings share a fit
                done = [_score(estimator.fit(train, settings[members[0]]), test, evaluator)] * len(members)
            if store:
                store.put(entry, done)
        return done

    tasks = [(members, fold) for members in groups.values() for fold in range(folds)]
    out: list[list[float]] = [[0.0] * folds for _ in settings]
    for (members, fold), found in zip(tasks, _side_by_side(scores, tasks, parallelism)):
        for i, score in zip(members, found):
            out[i][fold] = score
    return out


def cv_rmse(
    estimator: Estimator, df: DataFrame, folds: int = 4, label: str = "rating", parallelism: int = 4
) -> float:
    """Root of the mean of the folds' squared errors."""
    return math.sqrt(math.fsum(fold_scores(estimator, df, [{}], folds, "mse", label, parallelism)[0]) / folds)


@dataclass(frozen=True)
class Search:
    """What a search drew, how each draw did on every fold, which is best, and the model of it."""

    settings: list[dict[str, object]]
    scores: list[list[float]]
    best: int
    bestModel: Model


def best_draw(scores: Sequence[Sequence[float]], larger: bool) -> int:
    """The draw with the best mean score, the first of equal ones; scores that are no numbers lose."""
    means = [math.fsum(row) / len(row) for row in scores]
    order = [m if not math.isnan(m) else (-math.inf if larger else math.inf) for m in means]
    return order.index(max(order) if larger else min(order))


def random_search(
    estimator: Estimator, df: DataFrame, space: dict[Param, object], draws: int = 2, folds: int = 4,
    seed: int = 7, metric: str = "r2", label: str = "rating", parallelism: int = 4, store: Store | None = None,
) -> Search:
    """Scores random draws on folds and fits the best one on all rows."""
    settings = draw_param_maps(space, draws, seed)
    scores = fold_scores(estimator, df, settings, folds, metric, label, parallelism, store=store)
    best = best_draw(scores, larger=metric == "r2")
    names = [{p.name: v for p, v in s.items()} for s in settings]
    entry = _key("refit", type(estimator).__name__, _named(estimator, settings[best]), label, fingerprint(df)) if store else ""
    if store and store.get(entry) is not None:
        return Search(names, scores, best, store.load(entry))
    model = estimator.fit(df, settings[best])
    if store:
        store.save(entry, model)
        # the score marks the model as whole
        store.put(entry, [math.fsum(scores[best]) / folds])
    return Search(names, scores, best, model)


def holdout_rmse(model: Model, holdout: DataFrame, predicted: str, label: str = "rating") -> float:
    return model.transform(holdout).agg(rmse(label, predicted, weight_column(model))).first()[0]


@dataclass(frozen=True)
class Retrained:
    """The best model, the hold-out error of every round, each round's search, and whether one was good enough."""

    model: Model
    errors: list[float]
    searches: list[Search]
    reached: bool


def retrain_until(
    estimator: Estimator, train: DataFrame, holdout: DataFrame, space: dict[Param, object],
    threshold: float, max_rounds: int | None = 5, draws: int = 2, folds: int = 4, seed: int = 7,
    label: str = "rating", parallelism: int = 4, store: Store | None = None,
) -> Retrained:
    """Repeats the search with new seeds until the hold-out error is at or below the threshold.

    Gives up after ``max_rounds``, never if that is None. With a store, rounds that a former run
    has finished are read from it, and its unfinished one goes on where it stopped.
    """
    best, errors, searches = None, [], []
    for turn in itertools.count():
        if turn == max_rounds:
            break
        found = random_search(
            estimator, train, space, draws, folds, seed + turn, label=label, parallelism=parallelism, store=store
        )
        error = holdout_rmse(found.bestModel, holdout, estimator.getOrDefault("predictionCol"), label)
        if not errors or error < min(errors):
            best = found.bestModel
        errors.append(error)
        searches.append(found)
        if error <= threshold:
            break
    return Retrained(best, errors, searches, bool(errors) and min(errors) <= threshold)

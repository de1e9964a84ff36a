"""AdaBoost.R2 (Drucker 1997) on weighted decision trees.

Each round fits a tree to weighted rows; well predicted rows lose weight. The
prediction is the weighted median of the trees. Trees see the weights themselves
in place of a weighted bootstrap sample, which makes a round reproducible. Equal rows
are kept once, with the sum of their weights, in blocks of binned rows: a level of a tree is one
short pass that sends one histogram per partition, and a round's losses are one pass more. Where
one partition holds all distinct rows, all rounds are one task, which does the same to its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasCheckpointInterval, HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasStepSize,
    HasWeightCol,
)
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
    MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tallyrank.ml.gradient import Tree, blocked, candidate_borders, cells, grown, load_trees, save_trees
from tallyrank.ml.held import Block, Near, Spread
from tallyrank.ml.trees import TREES_AT_ONCE, in_parts, tree_expression, weighted_groups

LOSSES = ("linear", "square", "exponential")
# Trees of more nodes together are scored from their arrays; as expressions they would grow too large.
MOST_NODES = 127
#: Distinct rows of a partition, unless there are more than these in each anyway.
ROWS = 1 << 15
#: Rows scored at a time.
NEAR = 1 << 11


def loss_column(error: Column, largest: float, loss: str) -> Column:
    """Loss in [0, 1] of an absolute error relative to the largest one."""
    relative = error / F.lit(largest)
    if loss == "linear":
        return relative
    if loss == "square":
        return relative * relative
    if loss == "exponential":
        return 1 - F.exp(-relative)
    raise ValueError(f"loss must be one of {LOSSES}")


def reweighted(weight: Column, loss: Column, beta: float, rate: float) -> Column:
    return weight * F.pow(F.lit(beta), (1 - loss) * rate)


def weighted_pairs(values: list[Column], weights: list[float]) -> Column:
    """(value, weight) structs for the weighted median."""
    return F.array(*[
        F.struct(v.alias("value"), F.lit(float(w)).alias("weight")) for v, w in zip(values, weights)
    ])


def weighted_median(pairs: Column, total: float) -> Column:
    """The first value, in ascending order, at which half of the total weight is reached."""
    half = 0.5 * total * (1 - 1e-12)
    start = F.struct(F.lit(0.0).alias("reached"), F.lit(None).cast("double").alias("value"))

    def step(state, pair):
        reached = state["reached"] + pair["weight"]
        hit = F.when(reached >= half, pair["value"])
        return F.struct(reached.alias("reached"), F.coalesce(state["value"], hit).alias("value"))

    return F.aggregate(F.array_sort(pairs), start, step, lambda state: state["value"])


class Round(NamedTuple):
    """What a round does to the weights: its tree, largest error, loss, beta, rate and a factor for all."""

    tree: Tree
    largest: float
    loss: str
    beta: float
    rate: float
    factor: float


def _losses(error: np.ndarray, largest: float, loss: str) -> np.ndarray:
    relative = error / largest
    return relative if loss == "linear" else relative * relative if loss == "square" else -np.expm1(-relative)


def _unpacked(row, width: int, kind: type) -> Block:
    label = np.frombuffer(row["label"])
    return np.frombuffer(row["bins"], dtype=kind).reshape(width, len(label)), label, np.frombuffer(row["weight"])


def _errors(block: Block, tree: Tree) -> np.ndarray:
    bins, label, _ = block
    return np.abs(label - tree.value[tree.follow(bins, tree.cut)])


def _weighed(block: Block, done: Round) -> Block:
    """A block with the weights that a round leaves."""
    bins, label, weight = block
    lost = _losses(_errors(block, done.tree), done.largest, done.loss)
    return bins, label, weight * done.beta ** ((1 - lost) * done.rate) * done.factor


def _histograms(blocks: Iterator[Block], tree: Tree, frontier: np.ndarray, width: int) -> np.ndarray:
    out = 0
    for bins, label, weight in blocks:
        out = out + cells(bins, label, weight, tree, frontier, width)
    return out


def _sums(blocks: Iterator[Block], tree: Tree, largest: float | None) -> np.ndarray:
    """Largest error, sum of weights, rows and weighted sums of errors and their squares; with a
    largest error the weighted sum of exponential losses instead of these."""
    out = None
    for block in blocks:
        weight, error = block[2], _errors(block, tree)
        more = (weight @ error, weight @ (error * error)) if largest is None else (weight @ _losses(error, largest, "exponential"),)
        found = np.array((error.max(), weight.sum(), len(error), *more))
        out = found if out is None else _both(out, found)
    return out


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate((np.maximum(a[:1], b[:1]), a[1:] + b[1:]))


def _mean_loss(rows: Near | Spread, tree: Tree, loss: str) -> tuple[float, float, float, float]:
    """Largest error, sum of weights, rows and mean loss: one pass, but for the exponential loss."""

    def summed(largest: float | None) -> list[float]:
        return rows.gathered(partial(_sums, tree=tree, largest=largest), _both).tolist()

    largest, total, count, first, second = summed(None)
    if not largest:
        return largest, total, count, 0.0
    if loss == "linear":
        return largest, total, count, first / largest / total
    if loss == "square":
        return largest, total, count, second / largest / largest / total
    return largest, total, count, summed(largest)[3] / total


def _boosted(
    rows: Near | Spread, borders: list[list[float]], depth: int, rounds: int, rate: float, loss: str
) -> tuple[list[Tree], list[float]]:
    """The trees of at most so many rounds, and their weights."""
    trees, weights = [], []

    def counted(tree: Tree, frontier: np.ndarray, width: int) -> np.ndarray | None:
        work = partial(_histograms, tree=tree, frontier=frontier, width=width)
        return rows.gathered(work, size=len(frontier) * len(borders) * width * 2)

    for _ in range(rounds):
        tree = grown(counted, borders, depth)
        largest, total, count, mean_loss = _mean_loss(rows, tree, loss)
        if mean_loss <= 0 or mean_loss >= 0.5:
            if mean_loss <= 0 or not trees:
                trees.append(tree)
                weights.append(1.0)
            break
        beta = mean_loss / (1 - mean_loss)
        trees.append(tree)
        weights.append(rate * math.log(1 / beta))
        # scaled by the sum before the update, so that weights never underflow
        rows.step(Round(tree, largest, loss, beta, rate, count / total))
    return trees, weights


class _BoostParams(
    HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasStepSize, HasSeed, HasCheckpointInterval,
    HasWeightCol,
):
    loss = Param(Params._dummy(), "loss", "linear, square or exponential", TypeConverters.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of each tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "candidate splits per feature and one more", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(
            maxIter=50, stepSize=1.0, loss="linear", maxDepth=3, maxBins=32, seed=7, checkpointInterval=10
        )


class AdaBoostR2(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Weighted-median boosting of regression trees."""

    #: a model holds those of fewer rounds, see ``upto``
    staged = True

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=50,
        stepSize=1.0, loss="linear", maxDepth=3, maxBins=32, seed=7, checkpointInterval=10, weightCol=None,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> AdaBoostR2Model:
        rate, loss = self.getOrDefault("stepSize"), self.getOrDefault("loss")
        if loss not in LOSSES:
            raise ValueError(f"loss must be one of {LOSSES}")
        own = self.getWeightCol() if self.isDefined("weightCol") else None
        groups = weighted_groups(dataset, self.getFeaturesCol(), self.getLabelCol(), own).persist(StorageLevel.MEMORY_AND_DISK)
        trees, weights, spread = [], [], None
        try:
            array = vector_to_array("features")
            count, width = groups.agg(F.count(F.lit(1)), F.max(F.size(array))).first()
            if not count:
                return self._copyValues(AdaBoostR2Model())
            names = [f"f{i}" for i in range(width)]
            # every pass starts a task per partition, so few groups are kept in few
            rows = groups.coalesce(-(-count // ROWS)).select(*[array[i].alias(n) for i, n in enumerate(names)], "label", "weight")
            borders = candidate_borders(rows, names, self.getOrDefault("maxBins"))
            kind = np.uint8 if max(map(len, borders), default=0) < 256 else np.uint16
            packed = rows.mapInArrow(lambda batches: blocked(batches, borders), "bins binary, label binary, weight binary").rdd
            blocks = packed.map(partial(_unpacked, width=len(names), kind=kind))
            work = partial(
                _boosted, borders=borders, depth=self.getOrDefault("maxDepth"), rounds=self.getOrDefault("maxIter"),
                rate=rate, loss=loss,
            )
            if count <= ROWS:
                trees, weights = blocks.mapPartitions(lambda held: [work(Near(held, _weighed))]).first()
            else:
                spread = Spread(blocks, _weighed, self.getOrDefault("checkpointInterval"))
                trees, weights = work(spread)
        finally:
            if spread:
                spread.close()
            groups.unpersist()
        return self._copyValues(AdaBoostR2Model(trees, weights))


def _medians(trees: Sequence[Tree], weights: Sequence[float]):
    """The weighted median of the trees from one column per feature, as :func:`weighted_median` has it."""
    # equal values are met in the order of their weights
    order = np.argsort(weights, kind="stable")
    trees, weight = [trees[i] for i in order], np.asarray(weights, dtype=float)[order]
    half = 0.5 * math.fsum(weights) * (1 - 1e-12)

    @F.pandas_udf("double")
    def median(*columns: pd.Series) -> pd.Series:
        x, out = np.stack([c.to_numpy(dtype=float) for c in columns]), np.empty(len(columns[0]))
        # some rows at a time, so that what the trees say of them stays small
        for start in range(0, len(out), NEAR):
            near = np.ascontiguousarray(x[:, start:start + NEAR])
            values = np.stack([t.value[t.follow(near, t.bound)] for t in trees], axis=1)
            by = np.argsort(values, axis=1, kind="stable")
            place = (np.cumsum(weight[by], axis=1) >= half).argmax(axis=1)[:, None]
            out[start:start + NEAR] = np.take_along_axis(values, np.take_along_axis(by, place, axis=1), axis=1)[:, 0]
        return pd.Series(out)

    return median


class AdaBoostR2Model(Model, _BoostParams, MLReadable, MLWritable):
    """Trees and their weights; predicts the weighted median."""

    def __init__(self, trees=(), weights=()):
        super().__init__()
        self.trees, self.weights = list(trees), list(weights)

    def upto(self, rounds: int) -> AdaBoostR2Model:
        """The model that fewer rounds would have given."""
        return self._copyValues(AdaBoostR2Model(self.trees[:rounds], self.weights[:rounds]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Scores few small trees as expressions; others from their arrays."""
        if not self.trees:
            return dataset.withColumn(self.getPredictionCol(), F.lit(None).cast("double"))

        def pairs(start: int, values: list[Column]) -> Column:
            return weighted_pairs(values, self.weights[start:start + TREES_AT_ONCE])

        if sum(tree.numNodes for tree in self.trees) > MOST_NODES:
            return self._by_arrays(dataset)
        values = [F.expr(tree_expression(tree.toDebugString, "_array")) for tree in self.trees]
        scored, parts = in_parts(dataset, self.getFeaturesCol(), values, pairs, "_pairs")
        median = weighted_median(F.concat(*parts), math.fsum(self.weights))
        return scored.withColumn(self.getPredictionCol(), median).drop(*parts)

    def _by_arrays(self, dataset: DataFrame) -> DataFrame:
        array, width = vector_to_array(self.getFeaturesCol()), max(int(t.feature.max()) for t in self.trees) + 1
        median = _medians(self.trees, self.weights)(*[array[i] for i in range(max(width, 1))])
        return dataset.withColumn(self.getPredictionCol(), median)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: AdaBoostR2Model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(
            self.model, path, self.sparkSession, extraMetadata={"weights": self.model.weights}
        )
        save_trees(self.sparkSession, self.model.trees, f"{path}/trees")


class _ModelReader(MLReader):
    def load(self, path: str) -> AdaBoostR2Model:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = AdaBoostR2Model(load_trees(self.sparkSession, f"{path}/trees"), metadata["weights"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model

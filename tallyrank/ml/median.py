"""Gradient boosting of the absolute error.

The start is the median of the labels. A round fits a tree to the signs of the residuals, puts
the median of its residuals in the place of each leaf's value, and adds the tree times the rate.
Medians are exact and weighted (the smallest value at which half of the weight is reached), found
by rank selection per leaf, so no leaf's residuals are ever ordered in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasCheckpointInterval, HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasStepSize,
)
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
    MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tallyrank.ml.trees import in_parts, tree_expression, weighted_groups
from tallyrank.operators.ordering import exact_quantiles, range_bounds, range_count
from tallyrank.operators.selection import half_reached, in_ranges, select_ranks
from tallyrank.session import cut_lineage


class _MedianParams(
    HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasStepSize, HasSeed, HasCheckpointInterval
):
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of each tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "candidate splits per feature and one more", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(maxIter=100, stepSize=0.1, maxDepth=3, maxBins=32, seed=7, checkpointInterval=10)


class MedianBoosting(Estimator, _MedianParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees whose leaves are medians of residuals."""

    #: a model holds those of fewer rounds, see ``upto``
    staged = True

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=100,
        stepSize=0.1, maxDepth=3, maxBins=32, seed=7, checkpointInterval=10,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianBoostingModel:
        rate, every = self.getOrDefault("stepSize"), self.getOrDefault("checkpointInterval")
        learner = DecisionTreeRegressor(
            featuresCol="features", labelCol="sign", weightCol="weight", predictionCol="fitted", leafCol="leaf",
            maxDepth=self.getOrDefault("maxDepth"), maxBins=self.getOrDefault("maxBins"),
            seed=self.getOrDefault("seed"),
        )
        start = exact_quantiles(dataset.select(F.col(self.getLabelCol()).alias("label")), ["label"], (0.5,)).first()
        start = float(start["p50"]) if start else 0.0
        groups = weighted_groups(dataset, self.getFeaturesCol(), self.getLabelCol())
        current = groups.select("features", "label", "weight", (F.col("label") - start).alias("left"))
        trees, gains, bounds, kept = [], [], [], []
        try:
            for turn in range(self.getOrDefault("maxIter")):
                if turn % every == 0:
                    current = cut_lineage(current)
                    # borders only balance the work, so they may lag behind the residuals
                    bounds = range_bounds(current, ["left"], range_count(current, None))[0]
                current = current.persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(current)
                signed = current.withColumn("sign", F.when(F.col("left") > 0, 1.0).otherwise(-1.0))
                tree = learner.fit(signed)
                placed = tree.transform(signed).select("features", "label", "weight", "left", F.col("leaf").cast("int").alias("leaf"))
                medians = select_ranks(in_ranges(placed, "left", bounds), ["leaf"], "left", "weight", {"median": half_reached})
                # one row per leaf
                found = {r["leaf"]: r["median"] for r in medians.select("leaf", "median").collect()}
                leaves = [found[i] * rate for i in range((tree.numNodes + 1) // 2)]
                trees.append(tree_expression(tree.toDebugString, "_array", leaves))
                gains.append(tree.featureImportances.toArray())
                step = F.element_at(F.array(*map(F.lit, leaves)), F.col("leaf") + 1)
                current = placed.select("features", "label", "weight", (F.col("left") - step).alias("left"))
                while len(kept) > 2:
                    kept.pop(0).unpersist()
        finally:
            for table in kept:
                table.unpersist()
        return self._copyValues(MedianBoostingModel(start, trees, [g.tolist() for g in gains]))


class MedianBoostingModel(Model, _MedianParams, MLReadable, MLWritable):
    """A start and trees, each an expression over an array of features, with their importances."""

    def __init__(self, start: float = 0.0, trees=(), gains=()):
        super().__init__()
        self.start, self.trees, self.gains = start, list(trees), list(gains)

    def upto(self, rounds: int) -> MedianBoostingModel:
        """The model that fewer rounds would have given."""
        return self._copyValues(MedianBoostingModel(self.start, self.trees[:rounds], self.gains[:rounds]))

    @property
    def featureImportances(self) -> DenseVector:
        """Mean of the trees' importances, in shares."""
        total = [sum(column) for column in zip(*self.gains)]
        return Vectors.dense([t / sum(total) if sum(total) else 0.0 for t in total])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = [F.expr(tree) for tree in self.trees]
        scored, parts = in_parts(
            dataset, self.getFeaturesCol(), values, lambda _, some: reduce(add, some), "_sum"
        )
        total = reduce(add, [F.col(p) for p in parts], F.lit(self.start))
        return scored.withColumn(self.getPredictionCol(), total).drop(*parts)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: MedianBoostingModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"start": self.model.start})
        rows = [(i, t, g) for i, (t, g) in enumerate(zip(self.model.trees, self.model.gains))]
        table = self.sparkSession.createDataFrame(rows, "at int, tree string, gains array<double>")
        table.coalesce(1).write.parquet(f"{path}/trees")


class _ModelReader(MLReader):
    def load(self, path: str) -> MedianBoostingModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/trees").orderBy("at").collect()
        model = MedianBoostingModel(metadata["start"], [r["tree"] for r in rows], [list(r["gains"]) for r in rows])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model

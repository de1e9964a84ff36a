"""Gradient boosting of the squared or the absolute error, on rows kept in blocks.

The method is MLlib's: features are cut at candidate borders, the first tree is fitted to the labels,
every other one to the negative gradient at the sum so far, and a node takes the border that lowers
the variance most. What differs is how rows are kept. A block holds the bin numbers, labels and sums
of many rows as arrays, so that a level of a tree costs one short pass over the blocks and sends one
histogram per partition. Candidate borders come from all rows: the middles between distinct values
where these are few, approximate quantiles elsewhere. Where blocks stay, see :mod:`tallyrank.ml.held`.

Gradients of the absolute error are signs, so a pass counts rows: the bins of some features, the
node and the sign are one number per row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasCheckpointInterval, HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasStepSize,
    HasWeightCol,
)
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
    MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.ml.held import Block, Near, Spread
from tallyrank.session import write_through

LOSSES = ("squared", "absolute")
#: Rows of a block.
BLOCK = 1 << 17
#: Rows up to which all rounds are one task, and rows of a partition where there are many.
ROWS, PART = 1 << 15, 1 << 22
#: Cells of features that are counted together.
TOGETHER = 1 << 10
#: Inner nodes of a tree up to which rows are taken through it node by node.
FEW_NODES = 32


@dataclass
class Tree:
    """Nodes as arrays: a leaf has feature -1; a row goes right if its bin is beyond ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def follow(self, x: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The node each row ends in; ``x`` has a row per feature, ``limits`` is ``cut`` for bins, ``bound`` for values."""
        inner = np.flatnonzero(self.feature >= 0)
        if len(inner) <= FEW_NODES:
            # children come after their node, so one look at each node will do
            at = np.zeros(x.shape[1], dtype=np.int16)
            for node in inner:
                f, limit, left = self.feature[node], limits[node], np.int16(self.left[node])
                at = np.where(at == np.int16(node), left + (x[f] > x.dtype.type(limit)), at)
            return at
        at, rows = np.zeros(x.shape[1], dtype=np.int32), np.arange(x.shape[1])
        while len(rows):
            here = at[rows]
            rows, here = rows[self.feature[here] >= 0], here[self.feature[here] >= 0]
            at[rows] = self.left[here] + (x[self.feature[here], rows] > limits[here])
        return at


    @property
    def numNodes(self) -> int:
        return len(self.feature)

    @property
    def toDebugString(self) -> str:
        """The tree as MLlib prints its own."""
        lines, todo = [f"tree of {self.numNodes} nodes"], [(0, "")]
        while todo:
            node, condition = todo.pop()
            if condition:
                lines.append(condition)
            f, bound, left = int(self.feature[node]), float(self.bound[node]), int(self.left[node])
            if f < 0:
                lines.append(f"Predict: {float(self.value[node])!r}")
            else:
                todo += [(left + 1, f"Else (feature {f} > {bound!r})"), (left, f"If (feature {f} <= {bound!r})")]
        return "\n".join(lines)


_COLUMNS = ("feature", "cut", "bound", "left", "value", "gain")


def save_trees(spark: SparkSession, trees: Sequence[Tree], path: str) -> None:
    rows = [(i, *[getattr(t, c).tolist() for c in _COLUMNS]) for i, t in enumerate(trees)]
    spark.createDataFrame(
        rows, "at int, feature array<int>, cut array<int>, bound array<double>, left array<int>, value array<double>, gain array<double>"
    ).coalesce(1).write.parquet(path)


def load_trees(spark: SparkSession, path: str) -> list[Tree]:
    rows = spark.read.parquet(path).orderBy("at").collect()
    return [Tree(*[np.array(r[c]) for c in _COLUMNS]) for r in rows]


def candidate_borders(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Inner borders of each feature, at most ``bins`` - 1."""
    counts = rows.agg(*[F.approx_count_distinct(f) for f in features]).first()
    few = [f for f, n in zip(features, counts) if n <= 2 * bins]
    found = rows.agg(*[F.array_sort(F.collect_set(f)).alias(f) for f in few]).first().asDict() if few else {}
    out: dict[str, list[float]] = {
        f: [a + (b - a) / 2 for a, b in zip(v, v[1:])] for f, v in found.items() if len(v) <= bins
    }
    rest = [f for f in features if f not in out]
    if rest:
        cuts = rows.approxQuantile(rest, [i / bins for i in range(1, bins)], 0.25 / bins)
        out |= {f: sorted({b for b in cut if math.isfinite(b)}) for f, cut in zip(rest, cuts)}
    return [out[f] for f in features]


def blocked(batches: Iterator[pa.RecordBatch], borders: list[list[float]]) -> Iterator[pa.RecordBatch]:
    """One row per block: bin numbers, labels and what follows them as bytes."""
    kind = np.uint8 if max(map(len, borders), default=0) < 256 else np.uint16

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        bins = np.stack([
            np.searchsorted(np.array(b, dtype=float), table.column(i).to_numpy(), side="left").astype(kind)
            for i, b in enumerate(borders)
        ])
        rest = [table.column(i).to_numpy().astype(float) for i in range(len(borders), table.num_columns)]
        return pa.RecordBatch.from_arrays(
            [pa.array([v.tobytes()], pa.binary()) for v in (bins, *rest)], ["bins", *table.column_names[len(borders):]]
        )

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n >= BLOCK:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def _unpacked(row, borders: list[list[float]]) -> Block:
    """Bins, labels and sums, and weights where rows have them."""
    kind = np.uint8 if max(map(len, borders), default=0) < 256 else np.uint16
    label = np.frombuffer(row["label"], dtype=float)
    weight = [np.frombuffer(row["weight"], dtype=float)] if "weight" in row else []
    return np.frombuffer(row["bins"], dtype=kind).reshape(len(borders), len(label)), label, np.zeros(len(label)), *weight


def _added(block: Block, tree: Tree) -> Block:
    bins, label, total, *weight = block
    return bins, label, total + tree.value[tree.follow(bins, tree.cut)], *weight


def _histograms(blocks: Iterator[Block], tree: Tree, frontier: np.ndarray, loss: str | None, widths: Sequence[int]) -> np.ndarray:
    """(frontier, feature, bin, 2): rows and sums of what is fitted; ``loss`` None fits the labels."""
    first = next(blocks)
    blocks = itertools.chain([first], blocks)
    if loss == "absolute" and len(first) == 3:
        return _signs(blocks, tree, frontier, widths)
    out = 0
    for bins, label, total, *weight in blocks:
        target = label if loss is None else 2 * (label - total) if loss == "squared" else np.where(label - total < 0, -1.0, 1.0)
        out = out + cells(bins, target, weight[0] if weight else None, tree, frontier, max(widths))
    return out


def _together(widths: Sequence[int]) -> list[list[int]]:
    """Features in groups whose bins taken together are not many."""
    groups: list[list[int]] = []
    for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
        for group in groups:
            if math.prod(widths[g] for g in group) * widths[f] <= TOGETHER:
                group.append(f)
                break
        else:
            groups.append([f])
    return groups


def _signs(blocks: Iterator[Block], tree: Tree, frontier: np.ndarray, widths: Sequence[int]) -> np.ndarray:
    """:func:`cells` of the signs of residuals: features are counted some together, apart for each sign."""
    groups, nodes = _together(widths), len(frontier)
    sizes = [math.prod(widths[f] for f in group) for group in groups]
    # rows that are in none of the nodes are counted behind them
    counts = [np.zeros((nodes + 1) * size * 2, dtype=np.int64) for size in sizes]
    kind = np.uint16 if (nodes + 1) * max(sizes) * 2 <= 1 << 16 else np.int64
    place = np.full(len(tree.feature), nodes, dtype=kind)
    place[frontier] = np.arange(nodes)
    for bins, label, total in blocks:
        above, local = ~(label - total < 0), place[tree.follow(bins, tree.cut)]
        for group, size, count in zip(groups, sizes, counts):
            cell = local * kind(widths[group[0]]) + bins[group[0]]
            for f in group[1:]:
                cell *= kind(widths[f])
                cell += bins[f]
            cell *= kind(2)
            cell += above
            count += np.bincount(cell, minlength=len(count))
    out = np.zeros((nodes, len(widths), max(widths), 2))
    for group, count in zip(groups, counts):
        count = count.reshape(nodes + 1, *[widths[f] for f in group], 2)[:nodes]
        for i, f in enumerate(group):
            below, above = np.moveaxis(count.sum(axis=tuple(1 + j for j in range(len(group)) if j != i)), -1, 0)
            out[:, f, :widths[f], 0], out[:, f, :widths[f], 1] = below + above, above - below
    return out


def cells(
    bins: np.ndarray, target: np.ndarray, weight: np.ndarray | None, tree: Tree, frontier: np.ndarray, width: int
) -> np.ndarray:
    """(frontier, feature, bin, 2): weights, or rows where there are none, and sums of ``target``."""
    place = np.full(len(tree.feature), -1)
    place[frontier] = np.arange(len(frontier))
    local = place[tree.follow(bins, tree.cut)]
    target = target if weight is None else weight * target
    if (local < 0).any():
        inside = local >= 0
        bins, target, local = bins[:, inside], target[inside], local[inside]
        weight = None if weight is None else weight[inside]
    local = local * width
    out = np.empty((len(frontier), len(bins), width, 2))
    for f in range(len(bins)):
        cell = local + bins[f]
        out[:, f, :, 0] = np.bincount(cell, weight, len(frontier) * width).reshape(-1, width)
        out[:, f, :, 1] = np.bincount(cell, target, len(frontier) * width).reshape(-1, width)
    return out


def grown(counted: Callable[..., np.ndarray | None], borders: list[list[float]], depth: int) -> Tree | None:
    """The next tree, one pass a level; None without rows. Values are not yet scaled.

    ``counted`` gives the sum of :func:`cells` over all rows for a tree, its frontier and a width, None without rows.
    """
    width = max(map(len, borders), default=0) + 1
    feature, cut, bound, left, value, gain = [-1], [0], [0.0], [-1], [0.0], [0.0]
    frontier = [0]

    def tree() -> Tree:
        return Tree(np.array(feature), np.array(cut), np.array(bound), np.array(left), np.array(value), np.array(gain))

    for level in range(max(depth, 1)):
        found = counted(tree(), np.array(frontier), width)
        if found is None:
            return None
        n, s = found[..., 0], found[..., 1]
        all_n, all_s = n[:, 0].sum(axis=1), s[:, 0].sum(axis=1)
        if level == 0:
            value[0] = all_s[0] / all_n[0]
            if depth == 0:
                break
        n_left, s_left = np.cumsum(n, axis=2)[..., :-1], np.cumsum(s, axis=2)[..., :-1]
        # added up from the other end: weights that are no whole numbers would leave a rest where nothing is
        n_right, s_right = (np.cumsum(v[..., ::-1], axis=2)[..., ::-1][..., 1:] for v in (n, s))
        whole = (all_s ** 2 / all_n)[:, None, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            better = np.where(
                (n_left > 0) & (n_right > 0), s_left ** 2 / n_left + s_right ** 2 / n_right - whole, -np.inf
            )
        following = []
        for i, node in enumerate(frontier):
            if not better[i].size:
                continue
            f, b = np.unravel_index(np.argmax(better[i]), better[i].shape)
            best = better[i, f, b]
            # what rounding leaves of a sum of squares is no gain
            if not best > 1e-12 * max(whole[i, 0, 0], abs(s[i]).max() ** 2 / all_n[i]):
                continue
            feature[node], cut[node], bound[node], left[node], gain[node] = int(f), int(b), borders[f][b], len(feature), float(best)
            for count, total in ((n_left[i, f, b], s_left[i, f, b]), (n_right[i, f, b], s_right[i, f, b])):
                following.append(len(feature))
                for column, what in ((feature, -1), (cut, 0), (bound, 0.0), (left, -1), (value, total / count), (gain, 0.0)):
                    column.append(what)
        frontier = following
        if not frontier:
            break
    return tree()


def _boosted(
    rows: Near | Spread, borders: list[list[float]], depth: int, rounds: int, rate: float, loss: str
) -> list[Tree]:
    trees, widths = [], [len(b) + 1 for b in borders]
    for _ in range(rounds):

        def counted(tree: Tree, frontier: np.ndarray, width: int) -> np.ndarray | None:
            work = partial(_histograms, tree=tree, frontier=frontier, loss=loss if trees else None, widths=widths)
            return rows.gathered(work, size=len(frontier) * len(borders) * width * 2)

        tree = grown(counted, borders, depth)
        tree.value = tree.value * (rate if trees else 1.0)
        trees.append(tree)
        rows.step(tree)
    return trees


class _GradientParams(
    HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasStepSize, HasSeed, HasCheckpointInterval,
    HasWeightCol,
):
    lossType = Param(Params._dummy(), "lossType", "squared or absolute", TypeConverters.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of each tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "candidate splits per feature and one more", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(
            maxIter=20, stepSize=0.1, lossType="squared", maxDepth=5, maxBins=32, seed=7, checkpointInterval=10
        )


class GradientBoosting(Estimator, _GradientParams, DefaultParamsReadable, DefaultParamsWritable):
    """Gradient boosted regression trees; nothing is drawn, so the seed has no effect.

    With a weight column a row counts as often as its weight says, but for the choice of candidate borders.
    """

    #: a model holds those of fewer rounds, see ``upto``
    staged = True

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=20, stepSize=0.1,
        lossType="squared", maxDepth=5, maxBins=32, seed=7, checkpointInterval=10, weightCol=None,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> GradientBoostingModel:
        loss, rate = self.getOrDefault("lossType"), self.getOrDefault("stepSize")
        if loss not in LOSSES:
            raise ValueError(f"lossType must be one of {LOSSES}")
        array = vector_to_array(self.getFeaturesCol())
        first = dataset.select(F.size(array)).first()
        width = first[0] if first else 0
        names = [f"f{i}" for i in range(width)]
        kept = {"label": self.getLabelCol()} | ({"weight": self.getWeightCol()} if self.isDefined("weightCol") else {})
        rows = dataset.select(
            *[array[i].alias(n) for i, n in enumerate(names)], *[F.col(c).cast("double").alias(a) for a, c in kept.items()]
        )
        if not width:
            return self._copyValues(GradientBoostingModel())
        # written, as the rows may be dear to work out and are read more than once from here
        rows = write_through(rows, "boosting-rows")
        count = rows.count()
        if not count:
            return self._copyValues(GradientBoostingModel((), width))
        borders = candidate_borders(rows, names, self.getOrDefault("maxBins"))
        kinds = ", ".join(f"{c} binary" for c in ("bins", *kept))
        rows = rows.coalesce(1) if count <= ROWS else rows
        packed = rows.mapInArrow(lambda batches: blocked(batches, borders), kinds).rdd
        blocks = packed.map(partial(_unpacked, borders=borders))
        work = partial(
            _boosted, borders=borders, depth=self.getOrDefault("maxDepth"), rounds=self.getOrDefault("maxIter"),
            rate=rate, loss=loss,
        )
        if count <= ROWS:
            trees = blocks.mapPartitions(lambda held: [work(Near(held, _added))]).first()
        else:
            # a pass starts a task per partition, so there are no more than the cores, unless these would hold much
            parts = max(dataset.sparkSession.sparkContext.defaultParallelism, -(-count // PART))
            spread = Spread(blocks.coalesce(parts), _added, self.getOrDefault("checkpointInterval"))
            try:
                trees = work(spread)
            finally:
                spread.close()
        return self._copyValues(GradientBoostingModel(trees, width))


class GradientBoostingModel(Model, _GradientParams, MLReadable, MLWritable):
    """Trees whose values are added up; the rate is part of the values."""

    def __init__(self, trees=(), width: int = 0):
        super().__init__()
        self.trees, self.width = list(trees), width

    def upto(self, rounds: int) -> GradientBoostingModel:
        """The model that fewer rounds would have given."""
        return self._copyValues(GradientBoostingModel(self.trees[:rounds], self.width))

    @property
    def featureImportances(self) -> DenseVector:
        """Shares of what the splits of all trees gain."""
        total = np.zeros(self.width)
        for tree in self.trees:
            np.add.at(total, tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0])
        return Vectors.dense((total / total.sum() if total.sum() else total).tolist())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.trees:
            return dataset.withColumn(self.getPredictionCol(), F.lit(0.0))
        trees = self.trees

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            x, total = np.stack([c.to_numpy(dtype=float) for c in columns]), np.zeros(len(columns[0]))
            for tree in trees:
                total += tree.value[tree.follow(x, tree.bound)]
            return pd.Series(total)

        array = vector_to_array(self.getFeaturesCol())
        return dataset.withColumn(self.getPredictionCol(), predicted(*[array[i] for i in range(self.width)]))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: GradientBoostingModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"width": self.model.width})
        save_trees(self.sparkSession, self.model.trees, f"{path}/trees")


class _ModelReader(MLReader):
    def load(self, path: str) -> GradientBoostingModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        trees = load_trees(self.sparkSession, f"{path}/trees")
        model = GradientBoostingModel(trees, metadata["width"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model

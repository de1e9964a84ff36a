"""What the boosted models share: weighted groups of equal rows, and trees as SQL expressions."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrank.session import scratch_path

TREES_AT_ONCE = 100
_BRANCH = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)")


def weighted_groups(dataset: DataFrame, features: str, label: str, weight: str | None = None) -> DataFrame:
    """(features, label, weight): equal rows once, with their number, or the sum of their weights.

    Equal rows get equal predictions and errors in every round, so they stay alike throughout, and
    a round costs what the distinct rows cost.
    """
    rows = dataset.select(
        vector_to_array(features).alias("features"), F.col(label).cast("double").alias("label"),
        (F.col(weight) if weight else F.lit(1)).cast("double").alias("weight"),
    )
    groups = rows.groupBy("features", "label").agg(F.sum("weight").alias("weight"))
    return groups.select(array_to_vector("features").alias("features"), "label", "weight")


def equal_rows(rows: DataFrame, weight: str = "weight") -> DataFrame:
    """Rows that are equal in all columns once, with their number.

    For models of features of few values: every fit and every error then costs what the distinct rows cost.
    """
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias(weight))


def tree_expression(described: str, features: str, leaves: list[float] | None = None) -> str:
    """A tree, as its description prints it, as one SQL expression over an array of features.

    ``leaves`` gives other values of the leaves, in the order in which they are numbered.
    """
    lines = [line.strip() for line in described.splitlines()[1:] if line.strip()]
    numbered = iter(leaves or ())

    def node(at: int) -> tuple[str, int]:
        if lines[at].startswith("Predict:"):
            value = next(numbered) if leaves is not None else float(lines[at].split(":")[1])
            return f"{value!r}D", at + 1
        _, feature, _, bound = _BRANCH.match(lines[at]).groups()
        yes, at = node(at + 1)
        no, at = node(at + 1)
        return f"if({features}[{feature}] <= {float(bound)!r}D, {yes}, {no})", at

    return node(0)[0]


def in_parts(dataset: DataFrame, features: str, values: list[Column], combine, out: str) -> tuple[DataFrame, list[str]]:
    """Adds ``combine`` of some trees' values at a time as columns named after ``out``, so that plans stay small.

    ``values`` read the features from the array column ``_array``.
    """
    kept, parts = dataset.columns, []
    scored = dataset.withColumn("_array", vector_to_array(features))
    for start in range(0, len(values), TREES_AT_ONCE):
        part = combine(start, values[start:start + TREES_AT_ONCE])
        scored = scored.select(*kept, "_array", *parts, part.alias(f"{out}{start}"))
        parts.append(f"{out}{start}")
    return scored.drop("_array"), parts


def node_table(spark: SparkSession, model: Model) -> DataFrame:
    """(tree, node, feature, gain, rows, predicted, left, right) of a tree or of many.

    Read from the files of the saved model, so the nodes of large forests never pass through the
    driver. A leaf has no feature. ``rows`` counts the training rows that reach a node.
    """
    path = scratch_path(spark, "nodes")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    many = "nodeData" in data.columns
    node = "nodeData." if many else ""

    def of(name: str) -> Column:
        return F.col(f"{node}{name}")

    leaf = of("leftChild") < 0
    return data.select(
        (F.col("treeID") if many else F.lit(0)).cast("int").alias("tree"), of("id").alias("node"),
        F.when(~leaf, of("split.featureIndex")).alias("feature"), F.when(~leaf, of("gain")).alias("gain"),
        of("rawCount").alias("rows"), of("prediction").alias("predicted"),
        F.when(~leaf, of("leftChild")).alias("left"), F.when(~leaf, of("rightChild")).alias("right"),
    )


def importances(nodes: DataFrame, names: Sequence[str], per_tree: bool = False) -> DataFrame:
    """(feature, importance): each feature's share of what all splits gain, weighted by their rows.

    ``per_tree`` makes the gains of each tree add up to one first, as a forest does.
    """
    gained = nodes.where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("g"))
    if per_tree:
        gained = gained.withColumn("g", F.col("g") / F.sum("g").over(Window.partitionBy("tree")))
    # one row per feature
    total = gained.groupBy("feature").agg(F.sum("g").alias("g"))
    labels = F.array(*[F.struct(F.lit(i).alias("feature"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    every = nodes.sparkSession.range(1).select(F.inline(labels))
    share = F.coalesce(F.try_divide("g", F.sum("g").over(Window.partitionBy(F.lit(0)))), F.lit(0.0))
    return every.join(total, "feature", "left").select(F.col("name").alias("feature"), share.alias("importance"))

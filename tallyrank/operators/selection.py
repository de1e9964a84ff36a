"""Exact order statistics without ordering the rows.

Values carry the number of the range they fall into. Counts per range tell which ranges hold a
wanted rank; only the rows of these are looked at again, and only there equal values are counted
and put in order. So what is shuffled is a count per range, and then a share of the rows that
shrinks with the number of ranges, however many distinct values there are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"
#: Whether a rank is reached, from the weight of all values up to one and the weight of all.
Reached = Callable[[Column, Column], Column]


def splits(bounds: Sequence[float]) -> list[float]:
    """Outer and inner borders; without inner ones any number serves as the one a split needs."""
    return [float("-inf"), *(bounds or [0.0]), float("inf")]


def in_ranges(df: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """Adds the range number of a column of doubles; any borders give the same results."""
    tagged = Bucketizer(splits=splits(bounds), inputCol=value, outputCol=RANGE, handleInvalid="keep").transform(df)
    return tagged.withColumn(RANGE, F.col(RANGE).cast("int"))


def at_rank(edge: Callable[[Column], Column]) -> Reached:
    """The value at a 0-based rank, given by the number of values."""
    return lambda upto, total: upto > edge(total)


def half_reached(upto: Column, total: Column) -> Column:
    """The lower weighted median; a hair less than a half, as weights may be sums of doubles."""
    return upto >= total * (0.5 * (1 - 1e-12))


def select_ranks(
    values: DataFrame, by: Sequence[str], value: str, weight: str, picks: Mapping[str, Reached],
) -> DataFrame:
    """(by, _total, picks): for each pick the first value at which it is reached, one row per group.

    ``values`` holds (by, value, weight) and the range number. Groups must be few, such as the
    columns of a profile or the leaves of a tree: a row per group and pick is sent to every task.
    """
    by = list(by)
    ranges = values.groupBy(*by, RANGE).agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.select(
        *by, RANGE, "_sum", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
        F.sum("_sum").over(Window.partitionBy(*by)).alias("_total"),
    )
    hit, total = F.lit(False), F.col("_total")
    for reached in picks.values():
        hit = hit | (reached(F.col("_before") + F.col("_sum"), total) & ~reached(F.col("_before"), total))
    wanted = placed.where(hit).select(*by, RANGE, "_before", "_total")
    counted = values.join(F.broadcast(wanted), [*by, RANGE]).groupBy(*by, RANGE, "_before", "_total", value).agg(
        F.sum(weight).alias("_sum")
    )
    inside = Window.partitionBy(*by, RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ordered = counted.withColumn("_upto", F.col("_before") + F.sum("_sum").over(inside))
    return ordered.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        *[F.min(F.when(reached(F.col("_upto"), total), F.col(value))).alias(name) for name, reached in picks.items()],
    )

"""Profiles, histograms and binned counts of single columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.functions.scalars import known, known_in, present, round_even
from tallyrank.operators.aggregate import count_present
from tallyrank.operators.ordering import exact_quantiles


def _rows_from_struct(one_row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per struct column of a one-row table."""
    return one_row.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("s")).select("s.*")


def _stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    types = dict(df.dtypes)
    packed = []
    for c in columns:
        v = F.when(present(c, types[c]), F.col(c).cast("double"))
        packed.append(F.struct(
            F.lit(c).alias("metric"), F.count(v).alias("count"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        ).alias(c))
    return _rows_from_struct(df.agg(*packed), columns)


def describe(df: DataFrame, columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75), ranges)
    return _stats(df, columns).join(quartiles, "metric", "left").select(
        "metric", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def metric_summary(df: DataFrame, columns: Sequence[str], digits: int = 1) -> DataFrame:
    """Deviation, mean, median and maximum per column, rounded half to even."""
    medians = exact_quantiles(df, columns, (0.5,)).withColumnRenamed("p50", "median")
    joined = _stats(df, columns).join(medians, "metric", "left")
    return joined.select(
        "metric", *[round_even(c, digits).alias(c) for c in ("std", "mean", "median", "max")]
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Name, type, position and non-missing count of every column."""
    counts = df.agg(*count_present(df))
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"), F.lit(name).alias("column_name"),
            F.lit(dtype).alias("data_type"), F.col(name).alias("n_present"),
        )
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def histograms(df: DataFrame, bins: Mapping[str, int]) -> DataFrame:
    """(metric, bin, low, high, n): equal-width bins over each column's range, the last one closed.

    Empty bins stay with 0; a constant column gets a range of half a unit to each side. One
    pass finds all ranges, one counts all bins.
    """
    size = F.create_map(*[part for c, n in bins.items() for part in (F.lit(c), F.lit(n))])[F.col("metric")]
    rows = F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in bins
    ]))
    values = df.select(rows).where(present("x", "double"))
    flat = F.when(F.min("x") == F.max("x"), 0.5).otherwise(0.0)
    # one row per column
    extents = values.groupBy("metric").agg((F.min("x") - flat).alias("lo"), (F.max("x") + flat).alias("hi"))
    position = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * size)
    counted = values.join(F.broadcast(extents), "metric").groupBy(
        "metric", F.least(position, size - 1).cast("bigint").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    grid = extents.withColumn("width", (F.col("hi") - F.col("lo")) / size).select(
        "metric", "lo", "width", F.explode(F.sequence(F.lit(0).cast("bigint"), (size - 1).cast("bigint"))).alias("bin")
    )
    return grid.join(counted, ["metric", "bin"], "left").select(
        "metric", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """The histogram of one column."""
    return histograms(df, {column: bins}).drop("metric")


def fixed_bins(
    df: DataFrame, column: str, start: int, stop: int, step: int, overflow: bool = False
) -> DataFrame:
    """Counts in half-open bins of a fixed width, empty bins kept.

    Values outside ``[start, stop)`` are left out; with ``overflow`` those at or
    above ``stop`` are counted in one more bin that begins there.
    """
    x = known(F.col(column).cast("double"))
    low = (F.floor((x - start) / step) * step + start).cast("bigint")
    inside = x >= start
    if overflow:
        low = F.when(x >= stop, F.lit(stop).cast("bigint")).otherwise(low)
    else:
        inside = inside & (x < stop)
    counted = df.where(inside).groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("n"))
    last = stop if overflow else stop - step
    grid = df.sparkSession.range(start, last + 1, step).toDF("low")
    return grid.join(counted, "low", "left").select(
        "low", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def global_min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value of each column, as one row; NaN is no value."""
    return df.select(*[known_in(df, c) for c in columns]).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def long_form(df: DataFrame, key: str, target: str, features: Sequence[str]) -> DataFrame:
    """(feature, key, x, y) rows for scatter charts."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features
    ]))
    return df.select(F.col(key), F.col(target).alias("y"), pairs.alias("p")).select(
        "p.feature", key, "p.x", "y"
    )


def filtered_count(df: DataFrame, condition: Column, counted: str) -> DataFrame:
    """Non-missing ``counted`` values on the rows that meet the condition."""
    return df.where(condition).agg(F.count(known_in(df, counted)).alias("n"))

"""Grouped aggregates over the child table and null-aware ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrank.functions.scalars import all_present, present, share
from tallyrank.operators.ordering import RANGE, range_bounds, range_count, with_ranges


def grouped(df: DataFrame, keys: str | Sequence[str], *aggregates: Column) -> DataFrame:
    """Group after dropping rows whose key is missing."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.where(all_present(df, keys)).groupBy(*keys).agg(*aggregates)


def conditional_share(condition: Column, counted: str, empty: str = "null") -> Column:
    """Non-missing ``counted`` on the matching rows over non-missing on all rows.

    A group without a matching row gets NULL (``empty="null"``) or 0
    (``empty="zero"``); 0/0 is NULL.
    """
    value = F.col(counted)
    ratio = share(F.count(F.when(condition, value)), F.count(value))
    if empty == "zero":
        return ratio
    return F.when(F.count(F.when(condition, F.lit(1))) > 0, ratio)


def count_present(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """One non-missing count per column, under the column's own name."""
    types = dict(df.dtypes)
    columns = df.columns if columns is None else columns
    return [F.count(F.when(present(c, types[c]), 1)).alias(c) for c in columns]


def group_count_all(df: DataFrame, key: str) -> DataFrame:
    """Non-missing count of every other column per group."""
    return grouped(df, key, *count_present(df, [c for c in df.columns if c != key]))


def group_cardinality(df: DataFrame, key: str) -> DataFrame:
    """How many groups the key makes."""
    return df.agg(F.countDistinct(key).alias("n_groups"))


def aligned_ratio(left: DataFrame, right: DataFrame, key: str, part: str, whole: str) -> DataFrame:
    """Full outer alignment of two keyed tables, then part / whole."""
    joined = left.select(key, part).join(right.select(key, whole), key, "full")
    return joined.withColumn("ratio", share(F.col(part), F.col(whole)))


def key_coverage(df: DataFrame, key: str) -> DataFrame:
    """Smallest and largest key, their span, distinct keys and how many are missing."""
    stats = df.agg(
        F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.countDistinct(key).alias("n_keys")
    )
    span = F.col("max_key") - F.col("min_key")
    return stats.select(
        "min_key", "max_key", span.alias("span"), "n_keys",
        (span + 1 - F.col("n_keys")).alias("n_missing"),
    )


def key_gaps(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """(after, before): the pairs of neighbouring keys with integers missing between them.

    The distinct keys are cut into ranges; each looks for its own gaps, and a
    table with one row per range tells where the next one begins.
    """
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("after")).distinct()
    keys = with_ranges(keys, "after", range_bounds(keys, ["after"], range_count(df, ranges))[0])
    # one row per range: the rows are as many as the ranges
    starts = keys.groupBy(RANGE).agg(F.min("after").alias("start")).select(
        RANGE, F.lead("start").over(Window.orderBy(RANGE)).alias("start")
    )
    inside = F.lead("after").over(Window.partitionBy(RANGE).orderBy("after"))
    following = keys.withColumn("before", inside).join(F.broadcast(starts), RANGE)
    return following.select("after", F.coalesce("before", "start").alias("before")).where("before > after + 1")


def missing_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys between the smallest and the largest that never occur."""
    return key_gaps(df, key).select(F.explode(F.expr("sequence(after + 1, before - 1)")).alias(key))


def missing_count(df: DataFrame, key: str) -> Column:
    """How many keys are missing, as a scalar subquery; none of them is listed."""
    return key_gaps(df, key).agg(F.coalesce(F.expr("sum(before - after - 1)"), F.lit(0)).alias("n")).scalar()

"""Global order at scale: running totals, row numbers, back-fill, exact quantiles.

A window without a partition key runs in one task. Here the order column is cut
into ranges of about equal row counts first; each range is handled on its own,
and a table with one row per range carries the totals (or the next value) across
range borders. Unless given, there are four ranges to a shuffle partition, so
that ranges falling together by hash leave no partition with much more than others.

If one order value holds the rows of several ranges, ranges are cut over the order value and
the columns that settle ties, and over the rows' hash where these are equal too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrank.functions.scalars import known_in
from tallyrank.operators.selection import RANGE, Reached, at_rank, select_ranks, splits
from tallyrank.session import write_through


def range_count(df: DataFrame, ranges: int | None) -> int:
    return ranges or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, columns: Sequence[str], ranges: int) -> list[list[float]]:
    """Inner borders that split each numeric column into about equal parts."""
    if ranges < 2:
        return [[] for _ in columns]
    found = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).approxQuantile(
        list(columns), [i / ranges for i in range(1, ranges)], 0.5 / ranges
    )
    return [sorted({b for b in borders if math.isfinite(b)}) for borders in found]


class Borders(NamedTuple):
    """Inner borders of ranges, and whether one value holds the rows of more than two of these."""

    inner: list[float]
    crowded: bool


def borders(df: DataFrame, order: str, ranges: int) -> Borders:
    """Borders that split a numeric column into about equal parts, where its values allow."""
    if ranges < 2:
        return Borders([], False)
    found = df.select(F.col(order).cast("double").alias(order)).approxQuantile(
        order, [i / ranges for i in range(1, ranges)], 0.5 / ranges
    )
    crowded = any(a == b for a, b in zip(found, found[3:]))
    return Borders(sorted({b for b in found if math.isfinite(b)}), crowded)


def _last(order: str) -> Column:
    return F.col(order).asc_nulls_last()


def spread_ranges(df: DataFrame, order: str, tie: Sequence[str], ranges: int) -> DataFrame:
    """Adds the range number, ranges being about equal even where most rows share one order value.

    Written once, as the sums of the ranges and their rows must see the same ranges.
    """
    keys = [_last(order), *tie, F.xxhash64(*df.columns, F.lit("spread"))]
    cut = df.repartitionByRange(ranges, *keys).withColumn(RANGE, F.spark_partition_id())
    return write_through(cut, "spread")


def in_order(
    df: DataFrame, order: str, tie: Sequence[str], ranges: int | None, found: Borders | None = None
) -> DataFrame:
    """Adds a range number that grows with the order value and the ties."""
    count = range_count(df, ranges)
    found = found or borders(df, order, count)
    if found.crowded:
        return spread_ranges(df, order, tie, max(count, len(found.inner) + 1))
    return with_ranges(df, order, found.inner)


def with_ranges(df: DataFrame, order: str, bounds: Sequence[float]) -> DataFrame:
    """Adds the range number; missing order values come last, dealt by hash into as many ranges
    as there are others."""
    tagged = df.withColumn("_order", F.col(order).cast("double"))
    tagged = Bucketizer(
        splits=splits(bounds), inputCol="_order", outputCol=RANGE, handleInvalid="keep"
    ).transform(tagged)
    last = len(bounds) + 2 + F.pmod(F.xxhash64(*[c for c in df.columns if c != order], F.lit(0)), F.lit(len(bounds) + 1)).cast("int")
    missing = F.col("_order").isNull() | F.isnan("_order")
    return tagged.withColumn(RANGE, F.when(missing, last).otherwise(F.col(RANGE).cast("int"))).drop("_order")


def _carry(df: DataFrame, small: DataFrame, by: Sequence[str], bounded: bool) -> DataFrame:
    """Joins the one-row-per-range table; a bounded number of groups bounds its size."""
    return df.join(F.broadcast(small) if bounded else small, [*by, RANGE], "left")


def _accumulate(
    tagged: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: str, out: str, bounded: bool
) -> DataFrame:
    """Running sum ``out`` and group total ``_total`` over rows that carry their range."""
    inside = Window.partitionBy(*by, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*by, RANGE).agg(F.sum(value).alias("_sum"))
        .select(
            *by, RANGE, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
            F.sum("_sum").over(Window.partitionBy(*by)).alias("_total"),
        )
    )
    placed = tagged.withColumn("_inside", F.sum(value).over(inside))
    return (
        _carry(placed, offsets, by, bounded)
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_inside", "_before", RANGE)
    )


def running_total(
    df: DataFrame,
    order: str,
    value: str | Column,
    out: str,
    *,
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    ranges: int | None = None,
    bounds: Borders | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` in the order of a numeric column.

    Where that column is not unique, ``tie`` names the columns that settle the
    order of equal values. Borders already known spare the look at the data.
    """
    by = list(by)
    tagged = in_order(df, order, tie, ranges, bounds).withColumn(
        "_value", F.col(value) if isinstance(value, str) else value
    )
    placed = _accumulate(tagged, by, [_last(order), *tie], "_value", out, bounded=not by)
    return placed.drop("_value", "_total")


def row_positions(df: DataFrame, order: str, out: str = "position", **options) -> DataFrame:
    """0-based position of each row in the order of a unique numeric column."""
    numbered = running_total(df, order, F.lit(1).cast("bigint"), out, **options)
    return numbered.withColumn(out, F.col(out) - 1)


def strided_slices(
    df: DataFrame, order: str, slices: Mapping[str, tuple[int, int | None, int]], out: str = "position",
    name: str = "slice",
) -> DataFrame:
    """Rows ``start, start + step, …`` below ``stop`` of every named slice, from one numbering.

    Rows without an order value stand last, whatever the slice. A row in several
    slices comes once for each.
    """
    at = F.col(out)

    def inside(start: int, stop: int | None, step: int):
        hit = (at >= start) & ((at - start) % step == 0)
        return hit if stop is None else hit & (at < stop)

    hits = F.array_compact(F.array(*[F.when(inside(*s), F.lit(n)) for n, s in slices.items()]))
    return row_positions(df, order, out).withColumn(name, F.explode(hits))


def strided_sample(
    df: DataFrame, order: str, start: int, stop: int | None, step: int, out: str = "position"
) -> DataFrame:
    """Rows ``start, start + step, …`` below ``stop`` in the given order (Python slice)."""
    return strided_slices(df, order, {"": (start, stop, step)}, out, "_slice").drop("_slice")


def backfill(
    df: DataFrame,
    columns: Sequence[str],
    order: str,
    *,
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Replaces a missing value, NaN included, by the next non-missing one; trailing ones become NULL.

    ``tie`` names the columns that settle the order of equal order values.

    Windows run in descending order: a frame that starts at the current row would
    be evaluated anew for every row, one that ends there grows by a row at a time.
    """
    by, names = list(by), df.columns
    df = df.withColumns({c: known_in(df, c) for c in columns})
    tagged = in_order(df, order, tie, ranges)
    place = [F.desc_nulls_first(order), *[F.desc(c) for c in tie]]
    inside = Window.partitionBy(*by, RANGE).orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    # rows without an order value stand last
    at = F.struct(F.col(order).isNull().alias("missing"), F.col(order).alias("at"), *tie)
    first = tagged.groupBy(*by, RANGE).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_first_{c}") for c in columns]
    )
    following = first.select(
        *by, RANGE,
        *[F.last(f"_first_{c}", ignorenulls=True).over(after).alias(f"_next_{c}") for c in columns],
    )
    local = tagged.withColumns(
        {f"_local_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns}
    )
    filled = {c: F.coalesce(F.col(f"_local_{c}"), F.col(f"_next_{c}")) for c in columns}
    return _carry(local, following, by, bounded=not by).select(
        *[filled[c].alias(c) if c in filled else F.col(c) for c in names]
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], ranges: int | None = None
) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row per column, one field per probability.

    All columns are cut into ranges of about equal counts; only rows of the ranges that hold a
    wanted rank are put in order.
    """
    columns = list(columns)
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    bounds = range_bounds(wide, columns, range_count(df, ranges))
    tagged = Bucketizer(
        splitsArray=[splits(b) for b in bounds],
        inputCols=columns, outputCols=[f"{RANGE}_{c}" for c in columns], handleInvalid="keep",
    ).transform(wide)
    values = tagged.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("metric"), F.col(c).alias("value"),
            F.col(f"{RANGE}_{c}").cast("int").alias(RANGE), F.lit(1).alias("n"),
        )
        for c in columns
    ]))).where(F.col("value").isNotNull() & ~F.isnan("value"))

    def rank(p: float, side: Callable[[Column], Column]) -> Reached:
        return at_rank(lambda total: side(F.lit(float(p)) * (total - 1)))

    ends = {f"{n}{i}": rank(p, f) for i, p in enumerate(probabilities) for n, f in (("lo", F.floor), ("hi", F.ceil))}
    found = select_ranks(values, ["metric"], "value", "n", ends)
    picks = []
    for i, p in enumerate(probabilities):
        at, lo, hi = F.lit(float(p)) * (F.col("_total") - 1), F.col(f"lo{i}"), F.col(f"hi{i}")
        # equal ends need no interpolation, and infinite ones allow none
        picks.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at))).alias(quantile_name(p)))
    return found.select("metric", *picks)


def quantile_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")

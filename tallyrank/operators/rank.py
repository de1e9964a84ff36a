"""Top-k per key and the cascade of sort, cut and filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrank.spec import Stage

SALT = "_salt"


def topk(
    df: DataFrame,
    order: Sequence[str],
    limit: int,
    *,
    by: Sequence[str] = (),
    tie: str = "id",
    rank: str | None = None,
) -> DataFrame:
    """The first ``limit`` rows per key by descending expressions; ties go to the smaller ``tie``.

    Without keys this is a global sort-and-limit. With keys, Spark cuts every
    group on the map side before the shuffle, for limits up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``. Beyond it a group is cut
    in salted parts first, so that no task ever sorts a whole hot group.
    """
    by = list(by)
    ordering = [*[F.expr(o).desc_nulls_last() for o in order], F.col(tie).asc()]
    if not by:
        cut = df.orderBy(*ordering).limit(limit)
        if rank is None:
            return cut
        return cut.withColumn(rank, F.row_number().over(Window.orderBy(*ordering)).cast("bigint"))
    spark = df.sparkSession
    if limit > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        salted = df.withColumn(SALT, F.pmod(F.xxhash64(tie), F.lit(parts)))
        df = _cut(salted, [*by, SALT], ordering, limit, "_rank").drop(SALT, "_rank")
    cut = _cut(df, by, ordering, limit, rank or "_rank")
    return cut if rank else cut.drop("_rank")


def _cut(df: DataFrame, by: list[str], ordering: list, limit: int, name: str) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*ordering)
    return df.withColumn(name, F.row_number().over(window).cast("bigint")).where(F.col(name) <= limit)


def kth_floor(df: DataFrame, values: dict[str, Column], k: int, key: str, parts: int = 1024) -> DataFrame:
    """One struct: per value a bound at or below its k-th largest, NULL with too few rows.

    Rows are split by a hash of ``key`` into a fixed number of parts. The maxima
    of the parts belong to different rows, so the k-th largest of them never lies
    above the k-th largest of all rows, and with many parts it lies close to it.
    """
    parts = max(parts, 8 * k)
    tops = df.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("_part")).agg(
        *[F.max(v).alias(name) for name, v in values.items()]
    )
    return tops.agg(F.struct(*[
        F.get(F.sort_array(F.collect_list(name), asc=False), F.lit(k - 1)).alias(name) for name in values
    ]).alias("floor"))


def cascade(
    df: DataFrame, stages: Sequence[Stage], *, by: Sequence[str] = (), tie: str = "id"
) -> DataFrame:
    """Runs the stages one after the other within each key.

    Keys added by a stage come after those already there, so rows placed by the
    first window's shuffle stay where they are for all later windows.
    """
    by = list(by)
    for stage in stages:
        if stage.expand:
            name, values = stage.expand
            df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
            by = [*by, name]
        df = topk(df, stage.order, stage.limit, by=by, tie=tie)
        if stage.keep:
            df = df.where(F.expr(stage.keep))
    return df


def dedupe_keys(df: DataFrame, keys: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """One row per key; keys already in ``known`` are skipped."""
    fresh = df.dropDuplicates(list(keys))
    if known is not None:
        fresh = fresh.join(known.select(*keys), list(keys), "left_anti")
    return fresh

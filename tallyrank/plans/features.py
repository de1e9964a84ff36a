"""Item cleaning and the per-item feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.functions.scalars import all_present, four_year_flag, known_in, share
from tallyrank.functions.text import matches
from tallyrank.operators.impute import dropna_any, impute_mean
from tallyrank.operators.ordering import backfill
from tallyrank.session import partition_count, write_through
from tallyrank.spec import ItemSpec, LineSpec

FEATURES = (
    "id", "number_in_season", "title_len", "cycle_year",
    "mean_words", "max_words", "group_share", "n_places",
)
#: Lines of a partition, and parts that the lines of one item and place are dealt into at most.
ROWS, DEALT = 500_000, 16
IMPUTED = ("rating", "group_share", "max_words", "mean_words", "n_places")


def clean_items(
    items: DataFrame,
    spec: ItemSpec = ItemSpec(),
    *,
    fill: str | None = None,
    keep_urls: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """Typed item rows with ``title_len`` and ``cycle_year``; the title itself goes.

    ``fill`` back-fills every missing value in key order, ``"before"`` or
    ``"after"`` the year flag is taken.
    """
    urls = [F.col(spec.image).alias("image"), F.col(spec.link).alias("link")] if keep_urls else []
    cleaned = items.select(
        F.col(spec.key).alias("id"),
        F.to_date(spec.aired).alias("air_date"),
        F.col(spec.season).alias("season"),
        F.col(spec.number).alias("number_in_season"),
        *([F.col(spec.series).alias("number_in_series")] if spec.series else []),
        known_in(items, spec.views).alias("views"),
        known_in(items, spec.rating).alias("rating"),
        *urls,
        F.length(spec.title).cast("bigint").alias("title_len"),
    )
    flag = four_year_flag("air_date").cast("bigint")
    if fill == "before":
        cleaned = _backfilled(cleaned, ranges)
    cleaned = cleaned.withColumn("cycle_year", flag)
    return _backfilled(cleaned, ranges) if fill == "after" else cleaned


def _backfilled(df: DataFrame, ranges: int | None) -> DataFrame:
    return backfill(df, [c for c in df.columns if c != "id"], "id", ranges=ranges)


def line_features(
    lines: DataFrame, spec: LineSpec, group_term: str, *, case_sensitive: bool = True, empty: str = "null",
    rows: int = ROWS,
) -> DataFrame:
    """All per-item aggregates of the lines from one grouping.

    Items and places together are nearly as many as the lines, so sums before a shuffle would only
    fill memory. Lines are dealt by item, place and the part they were read in, about ``rows`` to a
    partition, then their sums by item: an item with many lines costs a few rows per place in the end.
    """
    key, place = spec.key, spec.place_key
    in_group = matches(spec.name, group_term, case_sensitive=case_sensitive)
    needed = lines.where(all_present(lines, [key])).select(
        F.col(key).alias("id"), F.col(place).alias("_place"), known_in(lines, spec.words).alias("_words"),
        F.col(spec.speaking).isNotNull().alias("_value"), F.coalesce(in_group, F.lit(False)).alias("_in"),
        (F.spark_partition_id() % DEALT).alias("_from"),
    )
    parts = partition_count(lines, rows)
    by = ["id", "_place", "_from"]
    sums = needed.repartition(parts, *by).groupBy(*by).agg(
        F.sum(F.col("_words").cast("double")).alias("_words"), F.count("_words").alias("_counted"),
        F.max("_words").alias("_most"), F.count_if("_value").alias("_values"),
        F.count_if(F.col("_value") & F.col("_in")).alias("_in_values"), F.count_if("_in").alias("_in_rows"),
    )
    ratio = share(F.sum("_in_values"), F.sum("_values"))
    return sums.repartition(parts, "id").groupBy("id").agg(
        (F.sum("_words") / F.sum("_counted")).alias("mean_words"),
        F.max("_most").cast("double").alias("max_words"),
        (ratio if empty == "zero" else F.when(F.sum("_in_rows") > 0, ratio)).alias("group_share"),
        F.countDistinct("_place").cast("double").alias("n_places"),
    )


def item_features(
    cleaned: DataFrame,
    lines: DataFrame,
    group_term: str,
    spec: LineSpec = LineSpec(),
    **options,
) -> DataFrame:
    """The cleaned items with their line aggregates; items without lines keep NULLs."""
    return cleaned.join(line_features(lines, spec, group_term, **options), "id", "left")


def model_table(features: DataFrame) -> DataFrame:
    """The feature table with the model columns mean-imputed, as doubles.

    The features are written first: the means need a pass of their own, and the
    lines behind the features are to be scanned once.
    """
    return impute_mean(write_through(features, "features"), IMPUTED)


def speaking_lines(
    lines: DataFrame, spec: LineSpec = LineSpec(), drop: Sequence[str] = ()
) -> DataFrame:
    """Complete rows (over all columns) that are spoken, without the dropped columns."""
    missing = [c for c in drop if c not in lines.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return dropna_any(lines).drop(*drop).where(F.col(spec.speaking))

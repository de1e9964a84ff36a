"""Tidy tables behind the charts: (series, x, y) rows, not drawings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The display labels of the model features.
LABELS = {
    "id": "Item number", "number_in_season": "Number in season", "title_len": "Title length",
    "cycle_year": "Cycle year", "mean_words": "Average line length", "max_words": "Longest line",
    "group_share": "Share of group lines", "n_places": "Places", "first_score": "First-stage score",
}


def time_series(df: DataFrame, day: str, values: Sequence[str], key: str = "id") -> DataFrame:
    """One row per item and series in date order; each value stays with its own date."""
    dated = df.where(F.col(day).isNotNull())
    points = F.inline(F.array(*[
        F.struct(F.lit(v).alias("series"), F.col(v).cast("double").alias("y")) for v in values
    ]))
    return dated.select(F.col(day).alias("x"), key, points).orderBy("x", key, "series")


def predicted_vs_actual(predictions: DataFrame, target: str = "rating") -> DataFrame:
    """Actual and predicted value per item in key order."""
    return predictions.select("id", target, "predicted").orderBy("id")


def labelled_importances(importances: DataFrame, labels: dict[str, str] = LABELS) -> DataFrame:
    """Importance rows with display labels, most important first."""
    label = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
    return importances.withColumn(
        "label", F.coalesce(F.try_element_at(label, F.col("feature")), F.col("feature"))
    ).orderBy(F.desc("importance"), "feature")

"""Filling and dropping missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.functions.scalars import all_present, present


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replaces missing values by the mean of the column over the whole table.

    All means come from one one-row scalar subquery.
    """
    types = dict(df.dtypes)
    means = df.agg(
        F.struct(*[F.avg(F.when(present(c, types[c]), F.col(c))).alias(c) for c in columns])
    ).scalar()
    return df.withColumns(
        {c: F.when(present(c, types[c]), F.col(c).cast("double")).otherwise(means[c]) for c in columns}
    )


def fill_constant(df: DataFrame, value: float = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """Replaces missing numbers by a constant."""
    return df.na.fill(value, subset=list(columns) if columns else None)


def dropna_any(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drops rows with a missing value in any (or any of the given) columns."""
    return df.where(all_present(df, columns or df.columns))

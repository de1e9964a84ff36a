"""Splits and folds from a hash of the key: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_bucket(key: str, buckets: int, salt: str = "") -> Column:
    """A number in ``[0, buckets)`` from the first 32 bits of the key's MD5; salt it for a new draw."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(salt)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def with_split(df: DataFrame, key: str = "id", test_percent: int = 20, salt: str = "") -> DataFrame:
    """Adds ``split``: ``train`` or ``test``."""
    is_train = hash_bucket(key, 100, salt) < 100 - test_percent
    return df.withColumn("split", F.when(is_train, "train").otherwise("test"))


def train_test_split(
    df: DataFrame, key: str = "id", test_percent: int = 20, salt: str = ""
) -> tuple[DataFrame, DataFrame]:
    tagged = with_split(df, key, test_percent, salt)
    return tuple(tagged.where(F.col("split") == s).drop("split") for s in ("train", "test"))


def with_folds(df: DataFrame, folds: int, key: str = "id", out: str = "fold") -> DataFrame:
    return df.withColumn(out, hash_bucket(key, folds, "fold"))


def rmse(target: str, predicted: str, weight: str | None = None) -> Column:
    """Root of the mean squared error; with a weight column a row counts as often as it says."""
    square = F.pow(F.col(target) - F.col(predicted), F.lit(2.0))
    return F.sqrt(F.try_divide(F.sum(square * F.col(weight)), F.sum(weight)) if weight else F.avg(square))

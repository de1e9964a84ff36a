"""Answering a stream of preference requests from the stored recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyrank.plans.recommend import lookup


def read_requests(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Request files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def answer_requests(
    requests: DataFrame, store: DataFrame, default: dict, out: str, checkpoint: str
) -> StreamingQuery:
    """Joins the stream to the static store and appends the answers; holds no state."""
    return (
        lookup(requests, store, default).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    )

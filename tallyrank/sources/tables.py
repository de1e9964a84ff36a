"""CSV sources, lookup lists and the result store."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Texts a CSV reader takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

OVERFLOW = "_overflow"


def _schema(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | StructType,
    *,
    lenient: bool = False,
    by_name: bool = False,
    multi_line: bool = False,
    na_values: Sequence[str] = NA_TOKENS,
) -> DataFrame:
    """Headered CSV with doubled quotes; NA-like texts become NULL.

    The schema names the columns in file order, or, with ``by_name``, those to
    take from a file with more columns or another order. ``lenient`` drops rows
    with too many fields and keeps short ones, padded with NULL. ``multi_line``
    lets quoted fields span lines; Spark then reads each file in one piece, so it
    is for small files only. Files of one path must have the same header
    with ``by_name``: their columns are taken by position.
    """
    schema = _schema(schema)
    fields = schema.fields
    if by_name:
        header = spark.read.options(header=True, quote='"', escape='"').csv(path).columns
        _same_headers(spark, path)
        missing = [f.name for f in fields if f.name not in header]
        if missing:
            raise ValueError(f"no such columns in {path}: {missing}")
        typed = {f.name: f for f in fields}
        fields = [typed.get(name, StructField(name, StringType())) for name in header]
    if lenient:
        fields = [*fields, StructField(OVERFLOW, StringType())]
    df = (
        spark.read.schema(StructType(fields))
        .options(header=True, quote='"', escape='"', mode="PERMISSIVE", multiLine=multi_line)
        .csv(path)
    )
    if lenient:
        df = df.where(F.col(OVERFLOW).isNull())
    return df.select(*[_without_na(f, na_values).alias(f.name) for f in schema.fields])


def _same_headers(spark: SparkSession, path: str) -> None:
    """Refuses a path whose files have different first lines; one file needs no look."""
    lines = spark.read.text(path)
    if len(lines.inputFiles()) < 2:
        return
    first = (
        lines.select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("i"))
        .where("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "i").alias("header"))
    )
    headers = [r[0] for r in first.select("header").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"files in {path} have different headers: {headers}")


def _without_na(field: StructField, na_values: Sequence[str]):
    column, kind = F.col(field.name), field.dataType.typeName()
    if kind == "string":
        return F.when(~column.isin(*na_values), column)
    if kind in ("double", "float"):
        return F.when(~F.isnan(column), column)
    return column


def read_lookup(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One-column list whose rows end in a stray delimiter."""
    df = spark.read.schema(f"`{name}` string, _rest string").option("header", True).csv(path)
    return df.select(name).where(F.col(name).isNotNull())


def write_store(results: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Persists a key → record table as a new version below ``path``.

    A version is listed once it is whole, so that readers meanwhile find the one before.
    """
    version = f"{time.time_ns():020d}"
    writer = results.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{path}/data/{version}")
    listed = results.sparkSession.createDataFrame([(version,)], "version string")
    listed.write.mode("append").parquet(f"{path}/versions")


def read_store(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """The latest whole version of a store."""
    version = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    reader = spark.read if schema is None else spark.read.schema(_schema(schema))
    return reader.parquet(f"{path}/data/{version}")


def write_series(series: DataFrame, path: str) -> None:
    """Persists chart data (series, x, y) as headered CSV."""
    series.write.mode("overwrite").option("header", True).csv(path)

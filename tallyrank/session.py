"""Shared scratch space: written tables and checkpoints every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Scratch paths given out by this process.
_GIVEN: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    names none gets a folder of its own; a cluster without one is an error,
    because a machine-local folder would not outlive its machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tallyrank-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch folder."""
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _GIVEN.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this process has put under the scratch folder by :func:`scratch_path`."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _GIVEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_GIVEN.pop())
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later work restarts from files, not from the source."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def write_through(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back, so that several
    readers share one computation and losing an executor does not repeat it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows dealt by ``key``, about ``rows`` to a partition, where shuffles by default would bring more to one.

    For a large table that is sorted to be joined: memory of a task would grow with the table.
    """
    parts = partition_count(df, rows)
    few = parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if few else df.repartition(parts, key)


def partition_count(df: DataFrame, rows: int) -> int:
    """How many partitions hold about ``rows`` rows each, and no fewer than shuffles have by default."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))

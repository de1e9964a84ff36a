"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled at a time inside a Python worker.
SLICE = 256

#: Rows that go to a Python worker at a time, and rows read from a file at a time, where :func:`lower_batches` holds.
BATCH, READ = 1024, 512
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH, "spark.sql.parquet.columnarReaderBatchSize": READ}


def lower_batches(spark: SparkSession) -> dict[str, str]:
    """Limits batches of the session to ``BATCH`` and ``READ`` rows; returns its settings before.

    A batch of texts is held several times, in the JVM outside its heap and in the Python
    worker; what is read at a time is an array in the heap that grows by doubling.
    """
    before = {name: spark.conf.get(name) for name in _BATCHES}
    for name, most in _BATCHES.items():
        spark.conf.set(name, str(min(int(before[name]), most) if int(before[name]) > 0 else most))
    return before


def small_batches(work: Callable) -> Callable:
    """Runs the jobs of ``work(df, …)`` under :func:`lower_batches`.

    What is only planned here and run later keeps the session's own settings.
    """

    @wraps(work)
    def bounded(df: DataFrame, *args, **kwargs):
        before = lower_batches(df.sparkSession)
        try:
            return work(df, *args, **kwargs)
        finally:
            for name, value in before.items():
                df.sparkSession.conf.set(name, value)

    return bounded


#: What operators keep in a worker from one task to the next: by the operator's name, how to let go of it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, let_go: Callable[[], None]) -> None:
    """Notes how a worker lets go of what ``owner`` keeps there between tasks."""
    _KEPT[owner] = let_go


def works_for(owner: str) -> None:
    """In a worker: lets go of what other operators than ``owner`` keep there.

    Spark uses workers again for whatever comes next, so that the vocabulary of a stage long
    over would stay beside all that a later one needs.
    """
    for name, let_go in _KEPT.items():
        if name != owner:
            let_go()


def fresh(name: str) -> str:
    """A column name no input has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where a lambda needs it many times."""
    return F.transform(F.array(value), use)[0]


def remainder(column: str | Column, divisor: int) -> Column:
    """crc32 of a value's decimal text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % divisor


def share_of(total: Column | int, bound: int) -> Column:
    """Share of rows to keep so that about ``bound`` of ``total`` remain."""
    total = total if isinstance(total, Column) else F.lit(total)
    return F.least(F.lit(1.0), F.lit(float(bound)) / F.greatest(total, F.lit(1)))


def drawn(share: Column, *parts: str | Column) -> Column:
    """Whether a hash of ``parts`` falls into the leading ``share`` of all hashes."""
    return F.pmod(F.xxhash64(F.lit("draw"), *parts), F.lit(1 << 30)) < share * float(1 << 30)


def texts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a column of strings, with the position of their first row."""
    for start in range(0, len(column), SLICE):
        yield start, column.slice(start, SLICE).to_pylist()


def arrays(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[list[pa.Array]]:
    """The named columns of each batch with rows."""
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(batch.schema.get_field_index(n)) for n in names]


def code_points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once in a worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; extra ones cannot clash with what an operator adds."""
    return df.select(*columns)

"""Small scalar expressions shared by the operators and plans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def four_year_flag(day: str | Column) -> Column:
    """1 in years divisible by four, else 0; a missing day gives 0."""
    return F.when(F.year(col(day)) % 4 == 0, 1).otherwise(0)


def share(part: Column, whole: Column) -> Column:
    """part / whole, missing when the whole is 0 or missing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def round_even(column: str | Column, digits: int) -> Column:
    return F.bround(col(column), digits)


def flag_text(column: str | Column) -> Column:
    """A boolean written as ``True`` or ``False``."""
    return F.initcap(col(column).cast("string"))


def parse_flag(column: str | Column) -> Column:
    """``'True'`` in any case is true, every other text is false."""
    return F.coalesce(F.lower(F.trim(col(column).cast("string"))) == "true", F.lit(False))


def composite_key(*columns: str | Column) -> Column:
    """The columns joined by single spaces into one text key."""
    return F.concat_ws(" ", *[col(c) for c in columns])


def present(column: str | Column, dtype: str) -> Column:
    """True where the value is neither NULL nor NaN."""
    column = col(column)
    ok = column.isNotNull()
    return ok & ~F.isnan(column) if dtype in ("double", "float") else ok


def known(column: str | Column, dtype: str = "double") -> Column:
    """The value, with NaN as NULL: both mean that it is missing."""
    column = col(column)
    return F.when(~F.isnan(column), column) if dtype in ("double", "float") else column


def known_in(df: DataFrame, name: str) -> Column:
    """A column of a table by its type, under its own name, with NaN as NULL."""
    return known(name, dict(df.dtypes)[name]).alias(name)


def at_least(column: str | Column, bound: float) -> Column:
    """True from ``bound`` on; a missing value, NaN included, is not there."""
    return known(column) >= bound


def all_present(df: DataFrame, columns: Sequence[str]) -> Column:
    """True where none of the columns is missing; plain null checks reach the file scan."""
    types = dict(df.dtypes)
    return reduce(and_, [present(c, types[c]) for c in columns])

"""Substring flags and scores over text columns, all native expressions.

A missing text never matches; it still counts as a row, so it lands in the
complement of a flag.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(term: str) -> str:
    return term.strip().lower()


def lowered(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(column.cast("string"))


def matches(
    column: str | Column, term: str, *, case_sensitive: bool = False, word_boundary: bool = False
) -> Column:
    """True where ``term`` occurs literally in the column, false for missing text."""
    column = F.col(column) if isinstance(column, str) else column
    text, wanted = (column, term) if case_sensitive else (lowered(column), normalise(term))
    if word_boundary:
        hit = text.rlike(rf"\b{re.escape(wanted)}\b")
    else:
        hit = text.contains(F.lit(wanted))
    return F.coalesce(hit, F.lit(False))


def contains_flag(column: str | Column, term: str, **options) -> Column:
    """1 where the term occurs, else 0."""
    return matches(column, term, **options).cast("int")


def contains_complement(column: str | Column, term: str, **options) -> Column:
    """1 where the term does not occur, else 0."""
    return F.lit(1) - contains_flag(column, term, **options)


def any_flag(column: str | Column, terms: Sequence[str], **options) -> Column:
    """1 where at least one of the terms occurs, else 0."""
    return reduce(lambda a, b: a | b, [matches(column, t, **options) for t in terms]).cast("int")


def keyword_score(column: str | Column, terms: Sequence[str], **options) -> Column:
    """How many of the terms occur at least once (0 … number of terms)."""
    return reduce(add, [contains_flag(column, t, **options) for t in terms])


def song_flags(
    text: str | Column, name: str | Column, text_terms: Sequence[str], name_terms: Sequence[str], **options
) -> Column:
    """One point for a text term plus one for a name term (0 … 2)."""
    return any_flag(text, text_terms, **options) + any_flag(name, name_terms, **options)


def polarity(score: Column, top: int | Column, wanted: bool | Column) -> Column:
    """The score when it is wanted, else its distance from the top score."""
    wanted = F.lit(wanted) if isinstance(wanted, bool) else wanted
    return F.when(wanted, score).otherwise(top - score)


def odds(matched: Column, unmatched: Column) -> Column:
    """Matched over unmatched rows; infinite when every row matches."""
    return F.when(unmatched == 0, F.lit(float("inf"))).otherwise(matched / unmatched)

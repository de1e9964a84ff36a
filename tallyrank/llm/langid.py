"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams, the most frequent
first. A document gets such a list of its own; the out-of-place distance to a language is
the sum, over the document's n-grams, of how far each stands from its place in the
language's list, or the longest possible way if it is not there. The nearest language wins.

Definitions. Text is lower-cased; every run of code points that are not letters is one
word border; n-grams of 1 to 3 code points may take in a border at either end, never
inside. Equal counts are ordered by the n-gram's code points, equal distances by the
language's name. ``score`` is 1 less the distance as a share of the longest possible one.
A text that is null or has no letter is ``und`` with score 0; so is every text where no
row was labelled. Repeated rows are judged each, and nothing but the text is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrank.llm.common import arrays, code_points, drawn, letters, share_of, texts, works_for

UNKNOWN = "und"
#: Code points of folded text counted at a time; longer texts are counted in blocks.
BLOCK = 1 << 19
_BORDER = 0x20


def folded(text: str) -> np.ndarray:
    """Lower-cased code points with one border before, between and after the words."""
    points = code_points(text.lower())
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, dtype=np.uint64)
    points = np.where(is_letter, points, _BORDER)
    points = np.concatenate(([_BORDER], points, [_BORDER])).astype(np.uint64)
    border = points == _BORDER
    return points[~(border & np.concatenate(([False], border[:-1])))]


def _counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams that start in all but the last two positions."""
    one, two, three = points[:-2], points[1:-1], points[2:]
    first, middle = one != _BORDER, two != _BORDER
    pair = (one << np.uint64(21)) | two
    codes = np.concatenate((
        one[first], pair[first | middle], ((pair << np.uint64(21)) | three)[middle],
    ))
    return np.unique(codes, return_counts=True)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a text, as codes of 21 bits a code point, and their counts."""
    points = folded(text)
    if not len(points):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    points = np.concatenate((points, np.full(2, _BORDER, dtype=np.uint64)))
    parts = [_counted(points[i:i + BLOCK + 2]) for i in range(0, len(points) - 2, BLOCK)]
    if len(parts) == 1:
        return parts[0]
    codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams; codes come sorted, so ties keep their order."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Languages in order of name, and for every n-gram of any profile its place in each."""

    languages: tuple[str, ...]
    codes: np.ndarray
    places: np.ndarray
    size: int

    @staticmethod
    def of(ranking: dict[str, list[int]], size: int) -> Profiles:
        names = tuple(sorted(ranking))
        codes = np.unique(np.array([c for n in names for c in ranking[n]], dtype=np.uint64))
        places = np.full((len(codes), len(names)), -1, dtype=np.int32)
        for j, name in enumerate(names):
            own = np.array(ranking[name], dtype=np.uint64)
            places[np.searchsorted(codes, own), j] = np.arange(len(own))
        return Profiles(names, codes, places, size)

    def distances(self, text: str) -> tuple[np.ndarray, int] | None:
        """Distance to each language and the longest possible one; None without a letter."""
        own = ranked(*gram_counts(text), self.size)
        if not len(own) or not self.languages:
            return None
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        places = np.where((self.codes[at] == own)[:, None], self.places[at], -1)
        away = np.where(places < 0, self.size, np.abs(places - np.arange(len(own))[:, None]))
        return away.sum(axis=0), self.size * len(own)

    def judge(self, text: str | None) -> tuple[str, float]:
        found = None if text is None else self.distances(text)
        if found is None:
            return UNKNOWN, 0.0
        away, most = found
        best = int(np.argmin(away))
        return self.languages[best], 1.0 - float(away[best]) / most

    def predict(self, text: Column) -> Column:
        """Struct of ``lang`` and ``score``."""
        profiles = self

        @F.arrow_udf("struct<lang:string,score:double>")
        def judged(column: pa.Array) -> pa.Array:
            works_for("langid")
            found = [profiles.judge(t) for _, part in texts(column) for t in part]
            return pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["lang", "score"],
            )

        return judged(text)


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *,
    size: int = 400, sample: int = 4_000,
) -> Profiles:
    """Profiles of ``size`` n-grams from rows with a language.

    About ``sample`` rows of each language are drawn by a hash of ``key`` and text; that bounds
    the work, not the languages, of which there must be few enough for a driver to hold
    (``size`` numbers each). Counts are summed inside each task before they are shuffled.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).where("l is not null")
    totals = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not totals:
        return Profiles.of({}, size)
    total = F.lit(1)
    for name, n in totals.items():
        total = F.when(F.col("l") == name, F.lit(n)).otherwise(total)
    chosen = rows.where("t is not null").where(drawn(share_of(total, sample), "k", "t")).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts):
            codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for names, column in arrays(batches, "l", "t"):
            for start, part in texts(column):
                for name, t in zip(names.slice(start, len(part)).to_pylist(), part):
                    held.setdefault(name, []).append(gram_counts(t))
                for name, parts in held.items():
                    held[name] = [merged(parts)]
        for name, ((codes, counts),) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)],
                ["l", "gram", "n"],
            )

    counts = chosen.mapInArrow(count, "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "gram"))
    ranking: dict[str, list[int]] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= size).orderBy("l", "place").collect():
        ranking.setdefault(r["l"], []).append(r["gram"])
    return Profiles.of(ranking, size)


def accepted(
    df: DataFrame, profiles: Profiles, text: str = "text", *, least: float = 0.0, languages=None,
) -> DataFrame:
    """Rows whose language is known, is one of ``languages`` (any, if None) and scores ``least``."""
    from tallyrank.llm.common import fresh

    found = fresh("lang")
    lang, score = F.col(found)["lang"], F.col(found)["score"]
    keep = (lang != UNKNOWN) & (score >= least)
    if languages is not None:
        keep &= lang.isin(*languages)
    return df.withColumn(found, profiles.predict(F.col(text))).where(keep).select(*df.columns)

"""Document fingerprints by I-Match: hashes of a document's terms of middling frequency.

Terms are the lower-cased runs of letters and digits. Their document frequency is counted
over all documents; those within a band of inverse document frequency form the lexicon. A
document's distinct lexicon terms are sorted and hashed, once for each of several randomised
subsets of the lexicon. Subset ``k`` holds a term if a hash of both falls into a share of
from 1/4 down to 1/256, ``REPEATS`` subsets to a rate: the small ones still agree when much of
a document has changed, the large ones when little has.

Fingerprint: 8 hexadecimal digits for each subset, or 8 dashes if it holds no term of the
document. A document none of whose terms is in a subset is hashed over all of its terms, in
every subset, so that dashes throughout mean a text without terms. Likeness of two fingerprints: the share of subsets with equal hashes among those that
hold a term of either; fingerprints without any term are alike (1) only to each other.

Scale. All DataFrame functions. Terms are counted by hash with partial sums. At most
(mean distinct terms of a document) / ``rare`` terms can lie in the band, so the lexicon is
bounded however many documents there are; it is one scalar subquery, looked up within each
row. :func:`against_next` moves every text once, into ranges of the key, and finds the next
document in the range, or for its last document in a table with one row per range.

Defined cases. Null text is empty. Documents are ordered by key, equal keys by a hash of the
text, null keys last. Repeated rows are documents of their own. Building a plan counts the
documents and looks up range borders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrank.llm.common import bound, fresh
from tallyrank.operators.ordering import RANGE, range_bounds, with_ranges
from tallyrank.session import write_through

#: Band of document frequency, as shares of all documents: idf from 3.0 to 5.3.
RARE, COMMON = 0.005, 0.05
RATES = (2, 4, 5, 6, 7, 7, 8, 8)
REPEATS = 4
SUBSETS = len(RATES) * REPEATS
BUCKETS = 1 << 14
NONE = "-" * 8


def terms(text: Column) -> Column:
    """Distinct terms of a text as sorted hashes."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


@dataclass(frozen=True)
class Lexicon:
    """Terms of the band with the subsets that hold them, in buckets of a one-row table."""

    table: DataFrame

    def fingerprints(self, df: DataFrame, texts: Column, out: str) -> DataFrame:
        """Adds the fingerprint, an array of hashes, of each text of an array of texts.

        The lexicon's column is used once, so that the optimizer puts its subquery in that
        place and no row ever holds a copy.
        """
        parts = fresh("lexicon")

        def known(term: Column) -> Column:
            held = F.col(parts)[F.pmod(term, F.lit(BUCKETS)).cast("int")][term]
            return F.struct(term.alias("term"), held.alias("subsets"))

        def hashed(own: Column) -> Column:
            found = F.filter(F.transform(own, known), lambda t: t["subsets"].isNotNull())

            def subset(k: int, kept: Column) -> Column:
                held = F.filter(kept, lambda t: F.getbit(t["subsets"], F.lit(k)) == 1)
                digits = F.lower(F.lpad(F.hex(F.xxhash64(F.lit(k), held).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
                return F.when(F.size(held) > 0, digits).otherwise(F.lit(NONE))

            return bound(found, lambda kept: F.when(
                F.exists(kept, lambda t: t["subsets"] != 0), F.array(*[subset(k, kept) for k in range(SUBSETS)])
            ).when(
                F.size(own) > 0, F.array(*[
                    F.lower(F.lpad(F.hex(F.xxhash64(F.lit(k), own).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
                    for k in range(SUBSETS)
                ])
            ).otherwise(F.array_repeat(F.lit(NONE), SUBSETS)))

        kept = [c for c in df.columns if c != out]
        marked = F.transform(texts, lambda t: bound(terms(t), hashed))
        return df.withColumn(parts, self.table.scalar()).select(*kept, marked.alias(out))


def fit(df: DataFrame, text: str = "text", *, rare: float = RARE, common: float = COMMON) -> Lexicon:
    """The lexicon of all documents of ``df``; terms in a single document are never part of it."""
    rows = df.select(terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    n = df.count()
    counts = rows.select(F.explode("terms").alias("term")).groupBy("term").count()
    band = counts.where((F.col("count") >= max(2.0, rare * n)) & (F.col("count") <= max(2.0, common * n)))
    subsets = F.lit(0).cast("long")
    for k in range(SUBSETS):
        inside = F.pmod(F.xxhash64(F.lit(k), "term"), F.lit(1 << RATES[k // REPEATS])) == 0
        subsets = subsets + F.when(inside, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    held = write_through(band.select("term", subsets.alias("subsets")), "lexicon")
    spread = held.groupBy(F.pmod("term", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(
        F.collect_list(F.struct("term", "subsets")).alias("part")
    )
    every = df.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    empty = F.array().cast("array<struct<term:bigint,subsets:bigint>>")
    table = (
        every.join(spread, "bucket", "left")
        .agg(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("part", empty).alias("part")))).alias("parts"))
        .select(F.transform("parts", lambda x: F.map_from_entries(x["part"])).alias("parts"))
    )
    return Lexicon(write_through(table, "lexicon-buckets"))


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets whose hashes agree, among those that hold a term of either."""
    pairs = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: (p["x"] != NONE) | (p["y"] != NONE))

    def share(some: Column) -> Column:
        agree = F.size(F.filter(some, lambda p: p["x"] == p["y"]))
        return F.when(F.size(some) == 0, F.lit(1.0)).otherwise(agree / F.size(some))

    return bound(pairs, share)


def written(fingerprint: Column) -> Column:
    return F.array_join(fingerprint, "")


def against_next(
    df: DataFrame, lexicon: Lexicon, change: Callable[[Column, Column], Column], key: str = "doc_id",
    text: str = "text", *, ranges: int | None = None,
) -> DataFrame:
    """(key, text, edited, own, changed, following): each document's text and fingerprint, an
    edited text made by ``change`` of it and the next document's, its fingerprint, and that of
    the next document. Next is the one with the next lower key; the last one's next is the first.
    """
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = ranges or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_ranges(rows, "id", range_bounds(rows, ["id"], ranges)[0])
    # ranges as they are visited: keys fall, null keys come last
    rows = rows.withColumn(RANGE, F.when(F.col("id").isNull(), F.lit(1)).otherwise(-F.col(RANGE)))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    visited = Window.partitionBy(F.lit(0)).orderBy(RANGE)
    heads = rows.groupBy(RANGE).agg(F.max_by("text", F.struct("id", "tie")).alias("head"))
    heads = lexicon.fingerprints(heads, F.array("head"), "mark").withColumn(
        "head", F.struct(F.col("head").alias("text"), F.col("mark")[0].alias("own"))
    )
    first = F.first("head").over(visited.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(RANGE, F.coalesce(F.lead("head").over(visited), first).alias("head"))
    inside = Window.partitionBy(RANGE).orderBy(F.desc_nulls_last("id"), F.desc("tie"))
    marked = lexicon.fingerprints(rows, F.array("text"), "own").withColumn("own", F.col("own")[0])
    follows = F.lead(F.struct("text", "own")).over(inside)
    paired = marked.withColumn("follows", follows).join(heads, RANGE, "left").select(
        "id", "text", "own", F.coalesce("follows", "head").alias("follows")
    )
    edited = paired.select(
        "id", "text", "own", F.col("follows")["own"].alias("following"),
        change(F.col("text"), F.col("follows")["text"]).alias("edited"),
    )
    both = lexicon.fingerprints(edited, F.array("edited"), "changed")
    return both.select(F.col("id").alias(key), "text", "edited", "own", F.col("changed")[0].alias("changed"), "following")

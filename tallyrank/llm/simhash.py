"""Near copies by SimHash, linked with the help of BK-trees.

Fingerprint. A-Z are lower-cased, words are runs without ASCII white space, and every
``words`` neighbouring words, repeats included, make a shingle; a text of fewer words is one
shingle, a text without any has fingerprint 0. A bit is set if it is set in more than half
of the shingles' XXH64 hashes (seed 42).

Links. Fingerprints that differ in at most ``radius`` bits are linked. Cut into
``radius + 2`` blocks of bits, two linked ones agree in two whole blocks at least, so every
pair of blocks deals the distinct fingerprints into shards by their bits there. Each shard
becomes a BK-tree: children hang below their parent by their Hamming distance to it, and a
search for all within the radius follows only children whose distance is within the radius
of the parent's own. A shard of more than ``LIMIT`` fingerprints is dealt once more by two
blocks of the bits that are left, and again, until it is small or too few bits are left to cut: with
radius 2 a shard then has 256 at most. So trees are bounded, no link is lost, and no pairs are written: a shard gives
one link from each fingerprint to the smallest of those it reaches there.

Components. The links are joined by alternating large-star and small-star steps, each a
grouped minimum and a join, until nothing changes; every step is written to the shared
folder.

Scale. Equal fingerprints are one row from the start, counted with partial sums, so that a
group of copies costs one row per task; only the last join brings the documents back, on a
key that adaptive execution can split. Nothing is broadcast but the fixed tables of masks.

Defined cases. Null text has no words. Null ids are never a component's id unless all of
its ids are null. Repeated rows are returned each. Building the plan runs the jobs above.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import arrays, fresh, small_batches, texts, works_for
from tallyrank.session import write_through

SEED = 42
#: Bytes of text whose words are held at a time.
BLOCK = 1 << 20
#: Fingerprints of one tree.
LIMIT = 8192
#: Up to so many are searched one by one, more in blocks.
FEW = 48
#: Cells in which the shingles of a text are counted, and the count that stands for itself and more.
CELLS, FULL = 256, 255
#: One text in so many shows which shingles are common: those of ``COMMON`` of them, ``MOST_COMMON`` at most.
SAMPLE, COMMON, MOST_COMMON = 16, 8, 1 << 16
#: Room for rounding in what a likeness demands of sizes.
ROUNDING = 1e-6
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """Words in order, in lists from about ``BLOCK`` bytes each."""
    start = 0
    while start < len(data):
        gap = _SPACE.search(data, start + BLOCK)
        end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end


def _shingle_blocks(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text, repeats included."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    digest, carry, any_ = xxhash.xxh64_intdigest, [], False
    for block in _word_blocks(data):
        carry += block
        if len(carry) >= words:
            any_ = True
            shingles = zip(*(carry[i:] for i in range(words)))
            yield np.array([digest(b" ".join(s), SEED) for s in shingles], dtype="<u8")
            carry = carry[len(carry) - words + 1:]
    if carry and not any_:
        yield np.array([digest(b" ".join(carry), SEED)], dtype="<u8")


def hashes_of(text: str | None, words: int) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype="<u8"), *_shingle_blocks(text, words)])


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    total, n = np.zeros(64, dtype=np.int64), 0
    for hashes in _shingle_blocks(text, words):
        planes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += planes.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed 64-bit number."""

    @F.arrow_udf("long")
    def marked(column: pa.Array) -> pa.Array:
        works_for("simhash")
        found = [fingerprint_of(t, words) for _, part in texts(column) for t in part]
        return pa.array(np.array(found, dtype=np.uint64).view(np.int64))

    return marked(text)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- shards ------------------------------------------------------------------


def _finer(mask: int, radius: int) -> list[int]:
    """Masks that add two blocks of the bits ``mask`` lacks."""
    left = [b for b in range(64) if not mask >> b & 1]
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(left, radius + 2) if len(part)]
    if len(blocks) < radius + 2:
        return []
    return [mask | a | b for a, b in combinations(blocks, 2)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _dealt(fps: DataFrame, radius: int) -> Iterator[DataFrame]:
    """(mask, bits, fp) of all shards that are small enough, level by level."""
    spark = fps.sparkSession
    masks = _finer(0, radius)
    dealt = fps.select(F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask"), "fp")
    while True:
        dealt = dealt.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("bits"), "fp")
        deeper = [(_signed(m), _signed(d)) for m in masks for d in _finer(m, radius)]
        if not deeper:
            yield dealt
            return
        crowded = write_through(
            dealt.groupBy("mask", "bits").count().where(F.col("count") > LIMIT).select("mask", "bits"), "crowded"
        )
        if crowded.isEmpty():
            yield dealt
            return
        yield dealt.join(crowded, ["mask", "bits"], "left_anti")
        children = spark.createDataFrame(deeper, "mask long, finer long")
        dealt = (
            dealt.join(crowded, ["mask", "bits"], "left_semi").join(F.broadcast(children), "mask")
            .select(F.col("finer").alias("mask"), "fp").distinct()
        )
        masks = sorted({d for m in masks for d in _finer(m, radius)})


# --- trees -------------------------------------------------------------------


class Tree:
    """A BK-tree over distinct fingerprints, its children in one flat list."""

    def __init__(self, fps: np.ndarray):
        values = [int(v) for v in fps]
        below: list[dict[int, int]] = [{} for _ in values]
        for i in range(1, len(values)):
            at = 0
            while True:
                away = (values[i] ^ values[at]).bit_count()
                child = below[at].setdefault(away, i)
                if child == i:
                    break
                at = child
        self.fps = fps
        self.first = np.concatenate(([0], np.cumsum([len(b) for b in below])))
        self.away = np.array([d for b in below for d in b], dtype=np.int64)
        self.child = np.array([c for b in below for c in b.values()], dtype=np.int64)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place of a query, place in the tree) at most ``radius`` apart."""
        asked, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        found = []
        while len(node):
            away = np.bitwise_count(queries[asked] ^ self.fps[node]).astype(np.int64)
            hit = away <= radius
            found.append((asked[hit], node[hit]))
            many = self.first[node + 1] - self.first[node]
            asked, away = np.repeat(asked, many), np.repeat(away, many)
            start = np.repeat(self.first[node] - np.concatenate(([0], np.cumsum(many)[:-1])), many)
            edge = start + np.arange(len(start))
            follow = np.abs(self.away[edge] - away) <= radius
            asked, node = asked[follow], self.child[edge[follow]]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _few_roots(values: list[int], radius: int) -> list[int]:
    """Roots in a shard of few fingerprints: each searches the tree, then joins it."""
    below: list[dict[int, int]] = [{} for _ in values]
    parent = list(range(len(values)))
    for i in range(1, len(values)):
        own, todo = values[i], [0]
        while todo:
            at = todo.pop()
            away = (own ^ values[at]).bit_count()
            if away <= radius:
                a, b = _root(parent, i), _root(parent, at)
                parent[max(a, b)] = min(a, b)
            todo += [c for d, c in below[at].items() if away - radius <= d <= away + radius]
        at = 0
        while True:
            child = below[at].setdefault((own ^ values[at]).bit_count(), i)
            if child == i:
                break
            at = child
    return [_root(parent, i) for i in range(len(values))]


def shard_links(fps: np.ndarray, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected inside one shard; ``fps`` ascend and are distinct."""
    if len(fps) <= FEW:
        roots = np.array(_few_roots(fps.tolist(), radius))
        moved = np.flatnonzero(roots != np.arange(len(fps)))
        return fps[moved], fps[roots[moved]]
    tree, parent = Tree(fps), list(range(len(fps)))
    for start in range(0, len(fps), block):
        asked, node = tree.within(fps[start:start + block], radius)
        roots = np.array([_root(parent, i) for i in range(len(fps))])
        a, b = roots[asked + start], roots[node]
        other = a != b
        for x, y in np.unique(np.stack((a[other], b[other])), axis=1).T.tolist():
            x, y = _root(parent, x), _root(parent, y)
            parent[max(x, y)] = min(x, y)
    roots = np.array([_root(parent, i) for i in range(len(fps))])
    moved = roots != np.arange(len(fps))
    return fps[moved], fps[roots[moved]]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the shards in rows sorted by shard and fingerprint."""
    held = [np.empty(0, dtype=np.int64)] * 3

    def solve(mask: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])))
        start = np.flatnonzero(new)
        end = np.concatenate((start[1:], [len(mask)]))
        shared = end - start > 1
        a, b = [], []
        for s, e in zip(start[shared].tolist(), end[shared].tolist()):
            x, y = shard_links(np.unique(fp[s:e].view(np.uint64)), radius)
            a.append(x)
            b.append(y)
        columns = [np.concatenate(v).view(np.int64) if v else np.empty(0, dtype=np.int64) for v in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b"])

    for columns in arrays(batches, "mask", "bits", "fp"):
        held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, columns)]
        same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
        cut = int(np.argmax(same))
        if cut:
            yield solve(*[h[:cut] for h in held])
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield solve(*held)


# --- components --------------------------------------------------------------


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes that links (a, b) join, the smallest node being the root."""

    def lower(pairs: DataFrame) -> DataFrame:
        return pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = write_through(lower(links), "links")
    before = state(pairs)
    while before[0]:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = lower(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = write_through(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        pairs = write_through(lower(small), "small-star")
        after = state(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def components(marked: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component_id, root, several) for every distinct fingerprint of (doc_id, fp).

    ``root`` is the smallest fingerprint of the component, ``several`` whether it has others.
    """
    nodes = write_through(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    links = None
    for dealt in _dealt(nodes.select("fp"), radius):
        found = dealt.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp").mapInArrow(
            lambda batches: _links(batches, radius), "a long, b long"
        )
        links = found if links is None else links.union(found)
    joined = connected(links).withColumnRenamed("node", "fp").join(nodes, "fp")
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = joined.join(smallest, "root").select("fp", "component_id", "root")
    several = F.col("root").isNotNull()
    return nodes.join(joined, "fp", "left").select(
        "fp", F.when(several, F.col("component_id")).otherwise(F.col("least")).alias("component_id"),
        F.coalesce("root", "fp").alias("root"), several.alias("several"),
    )


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 3, radius: int = 2) -> DataFrame:
    """(key, fp, component_id), one row for each row of ``df``."""
    marked = df.select(F.col(key).alias("doc_id"), fingerprint(F.col(text), words).alias("fp"))
    marked = write_through(marked, "simhash")
    found = components(marked, radius).select("fp", "component_id")
    return marked.join(found, "fp").select(F.col("doc_id").alias(key), "fp", "component_id")


def shingle_set(text: Column, words: int) -> Column:
    """Distinct hashes of a text's shingles."""

    @F.arrow_udf("array<long>")
    def shingled(column: pa.Array) -> pa.Array:
        works_for("simhash")
        found = [np.unique(hashes_of(t, words)).view(np.int64) for _, part in texts(column) for t in part]
        return pa.array(found, pa.list_(pa.int64()))

    return shingled(text)


def _sets(df: DataFrame, wanted: DataFrame, text: str, words: int) -> DataFrame:
    """(h, own): the shingle sets of the texts whose hash is in ``wanted``."""
    rows = df.select(F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h")).join(wanted, "h", "left_semi")
    return rows.groupBy("h").agg(F.min("t").alias("t")).select("h", shingle_set(F.col("t"), words).alias("own"))


def _common(df: DataFrame, text: str, words: int) -> np.ndarray:
    """Shingles of many texts, from one text in ``SAMPLE``; which ones are found changes the work only."""
    drawn_ = df.where(F.pmod(F.xxhash64(F.col(text)), F.lit(SAMPLE)) == 0)
    counts = drawn_.select(F.explode(shingle_set(F.col(text), words)).alias("s")).groupBy("s").count()
    most = counts.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST_COMMON)
    return np.sort(np.array([r["s"] for r in most.select("s").collect()], dtype=np.int64))


def profile_of(text: str | None, words: int, similarity: float, common: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    """Size of a text's shingle set, the leading shingles of it and its counts in ``CELLS`` cells.

    Sets are ordered by hash, ``common`` shingles (in order) last. Two sets that are ``similarity`` alike
    share one of the shingles that lead both, as too few would be left to share otherwise.
    """
    own = np.unique(hashes_of(text, words)).view(np.int64)
    n = len(own)
    cells = np.minimum(np.bincount(own & (CELLS - 1), minlength=CELLS), FULL).astype(np.uint8).tobytes()
    if not n:
        return 0, np.zeros(1, dtype=np.int64), cells
    late = np.zeros(n, dtype=bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
    own = own[np.argsort(late, kind="stable")]
    return n, own[:n - math.ceil(similarity * n - ROUNDING) + 1].copy(), cells


def _profiles(df: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """(h, n, first, cells) of each distinct text, as :func:`profile_of` gives them."""
    common = _common(df, text, words)

    @F.arrow_udf("struct<n:int,first:array<long>,cells:binary>")
    def profiled(column: pa.Array) -> pa.Array:
        works_for("simhash")
        found = [profile_of(t, words, similarity, common) for _, part in texts(column) for t in part]
        n, first, cells = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(cells, pa.binary())],
            ["n", "first", "cells"],
        )

    rows = df.select(F.xxhash64(F.col(text)).alias("h"), profiled(F.col(text)).alias("p")).select("h", "p.*")
    return write_through(rows.dropDuplicates(["h"]), "profiles")


def _least_shared(similarity: float, n: Column, m: Column) -> Column:
    """What sets of ``n`` and ``m`` shingles must share at least to be alike."""
    return F.lit(similarity / (1 + similarity)) * (n + m) - ROUNDING


def _most_shared(x: Column, y: Column) -> Column:
    """What two sets can share at most by their counts in cells."""

    @F.arrow_udf("int")
    def most(a: pa.Array, b: pa.Array) -> pa.Array:
        p, q = (np.frombuffer(b"".join(v.to_pylist()), dtype=np.uint8).reshape(-1, CELLS) for v in (a, b))
        shared = np.minimum(p, q).sum(axis=1, dtype=np.int64)
        full = (p == FULL).any(axis=1) | (q == FULL).any(axis=1)
        return pa.array(np.where(full, np.iinfo(np.int32).max, shared).astype(np.int32))

    return most(x, y)


def _verified(
    df: DataFrame, pairs: DataFrame, profiles: DataFrame, text: str, words: int, similarity: float
) -> DataFrame:
    """Those of the pairs (a, b) of text hashes whose shingle sets are alike."""
    sizes = profiles.select("h", "n", "cells")
    both = pairs.join(sizes.toDF("a", "n", "x"), "a").join(sizes.toDF("b", "m", "y"), "b")
    both = both.where((F.col("n") >= similarity * F.col("m") - ROUNDING) & (F.col("m") >= similarity * F.col("n") - ROUNDING))
    able = both.select("a", "b", _least_shared(similarity, F.col("n"), F.col("m")).alias("least"), _most_shared("x", "y").alias("most"))
    able = write_through(able.where("most >= least").select("a", "b"), "alike-pairs")
    # written on their own, so that Spark knows how few they are before it looks for their texts
    wanted = write_through(able.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "near-hashes")
    sets = write_through(_sets(df, wanted, text, words), "shingle-sets")
    whole = able.join(sets.toDF("a", "own"), "a").join(sets.toDF("b", "its"), "b")
    shared = F.size(F.array_intersect("own", "its"))
    alike = whole.where(shared >= similarity * (F.size("own") + F.size("its") - shared))
    return write_through(alike.select("a", "b"), "alike")


def alike_components(
    df: DataFrame, near: DataFrame, text: str, words: int, similarity: float
) -> DataFrame:
    """(node, root) of all texts, by hash, that a chain of alike pairs joins; no pair is missed.

    First every text is compared with the lead of its fingerprint group (c, h, k) and with the
    least of the texts that share one of its leading shingles, which is linear in the texts and
    joins what large groups of copies have in common. Then any two texts that share a leading
    shingle and are not yet joined are compared, whatever their fingerprints.
    """
    profiles = _profiles(df, text, words, similarity)
    placed = profiles.select("h", "n", F.posexplode("first").alias("i", "s"))
    shared = placed.groupBy("s").agg(F.min("h").alias("lead"), F.max("h").alias("last")).where("lead != last")
    shared = write_through(shared.select("s", "lead"), "shared-shingles")
    placed = write_through(placed.join(shared, "s"), "leading-shingles")
    order = F.struct(F.col("k").isNull().alias("late"), "k", "h")
    leads = near.groupBy("c").agg(F.min(order)["h"].alias("b"))
    pairs = near.join(leads, "c").select(F.col("h").alias("a"), "b")
    pairs = pairs.union(placed.select("h", "lead")).where("a != b").distinct()
    links = _verified(df, pairs, profiles, text, words, similarity)
    joined = write_through(connected(links), "joined")
    rooted = placed.join(joined, F.col("h") == F.col("node"), "left").select(
        "s", "h", "n", "i", F.coalesce("root", "h").alias("root")
    )
    # a shingle all of whose texts are joined has nothing left to compare
    open_ = rooted.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("s")
    rooted = write_through(rooted.join(open_, "s", "left_semi"), "open-shingles")
    x, y = (rooted.toDF("s", v, f"{v}_n", f"{v}_i", f"{v}_root") for v in "ab")
    left = F.least(F.col("a_n") - F.col("a_i"), F.col("b_n") - F.col("b_i"))
    others = x.join(y, "s").where("a < b and a_root != b_root").where(
        left >= _least_shared(similarity, F.col("a_n"), F.col("b_n"))
    )
    more = _verified(df, others.select("a", "b").distinct(), profiles, text, words, similarity)
    return joined if more.isEmpty() else connected(links.union(more))


@small_batches
def one_of_each(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 5, similarity: float = 0.8,
    marks: int = 2, radius: int = 6,
) -> DataFrame:
    """One row of each group of near copies: that of the smallest key. Columns stay as they are.

    Texts are linked whose sets of shingles of ``words`` words are ``similarity`` alike, and of
    what is linked one text stays. Fingerprints over shingles of ``marks`` words, which a few
    changed words move least, join most copies at little cost; :func:`alike_components` finds
    all other pairs exactly. Rows without a key give way to rows that have one; of rows that
    repeat key and text any one stays.
    """
    h, again, whose, of = fresh("h"), fresh("again"), fresh("whose"), fresh("of")
    marked = df.select(
        F.col(key).alias("k"), fingerprint(F.col(text), marks).alias("fp"), F.xxhash64(F.col(text)).alias("h")
    ).groupBy("k", "fp", "h").agg(F.count("*").alias("n"))
    marked = write_through(marked, "simhash")
    # a group is known by its smallest fingerprint, as keys may be missing
    groups = components(marked.select(F.col("k").alias("doc_id"), "fp"), radius)
    texts_ = marked.groupBy("fp", "h").agg(F.min("k").alias("k"))
    several = groups.where("several").select("fp", F.col("root").alias("c"))
    near = write_through(texts_.join(several, "fp").select("c", "h", "k"), "near-texts")
    # texts that share a fingerprint without being in a larger group
    twins = texts_.join(groups.where("not several").select("fp"), "fp").withColumn("c", F.col("fp"))
    twins = twins.join(twins.groupBy("c").count().where("count > 1").select("c"), "c", "left_semi").select("c", "h", "k")
    near = write_through(near.unionByName(twins), "near-and-twins")
    linked = alike_components(df, near, text, words, similarity).withColumnRenamed("node", "h")
    # of alike texts the one with the smallest key stands for all, and of a text its smallest key
    named = texts_.join(linked, "h", "left").withColumn("root", F.coalesce("root", "h"))
    order = F.struct(F.col("k").isNull().alias("late"), "k", "h")
    stands = named.groupBy("root").agg(F.min(order).alias("s")).select(
        F.col("s")["h"].alias("l_h"), F.col("s")["k"].alias("l_k")
    )
    chosen = marked.join(stands, F.col("h") == F.col("l_h"), "left")
    keeps = F.col("l_h").isNotNull() & F.col("k").eqNullSafe(F.col("l_k"))
    found = write_through(
        chosen.withColumn("keeps", keeps).where("not keeps or n > 1").select(
            F.col("k").alias(whose), F.col("h").alias(of), F.col("keeps").alias(again)
        ),
        "copies",
    )
    rows = df.withColumn(h, F.xxhash64(F.col(text)))
    same = F.col(key).eqNullSafe(F.col(whose)) & (F.col(h) == F.col(of))
    kept = rows.join(found, same, "left_anti")
    # texts are only moved once more where rows repeat key and text
    if not found.where(again).isEmpty():
        kept = kept.union(rows.join(found.where(again), same, "left_semi").dropDuplicates([key, h]))
    return kept.select(*df.columns)

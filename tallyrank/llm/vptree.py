"""Nearest neighbours by cosine with vantage-point trees, one for each shard of vectors.

Metric. Vectors are brought to length one; their distance then is a metric that falls as the
cosine grows, so the triangle inequality holds. Scores are cosines of the original vectors
in double precision.

Shards. A bounded sample of the vectors (``pivots``, about one for every ``SHARD`` vectors,
``MOST_PIVOTS`` at most) cuts the space: every vector belongs to its nearest pivot, and a
pivot with more than ``SHARD`` vectors is cut into parts by hash, so that no tree outgrows
its task. Each shard keeps the range of distances to its pivot.

Search. Inside a tree each node keeps the ranges of distances from its vantage point to both
halves. A half, or a whole shard, is left out if by the triangle inequality everything in it
is further from the query than ``factor`` times the ``k``-th best distance found so far. A
factor of one makes the search exact; smaller ones leave out more. A query first visits its
own shard, which gives a good ``k``-th distance, then those other shards that are left.
Queries go to shards in blocks, and a block walks a tree together. Where the vectors show no
structure nothing can be left out, and an exact search looks at every pair of query and vector.

Defined cases. Vectors that are null or zero or hold null or non-finite components take no
part; vectors of different lengths are never compared. Rows that repeat an id count once,
with the vector that is least as an array. Equal scores go to the smaller id. Only id and
vector are read. Pivots and one line of figures for each come to the driver; the cut vectors
and the first answers are written to the shared folder while the plan is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrank.llm.common import arrays
from tallyrank.session import write_through

SHARD = 8192
MOST_PIVOTS = 1024
LEAF = 64
#: Queries that walk a tree together.
TOGETHER = 512
#: Room for rounding in what is compared with a bound: chords near zero are roots of rounding
#: errors, some 1e-8 for equal vectors.
SLACK = 1e-6


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors, rows against rows."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines row by row, summed alike wherever a row stands."""
    a, b = query / np.abs(query).max(), vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


class Tree:
    """A vantage-point tree. Nodes are (vantage, inner, inner range, outer, outer range) or arrays of places."""

    def __init__(self, units: np.ndarray):
        self.units = units
        self.root = self._node(np.arange(len(units)))

    def _node(self, places: np.ndarray):
        if len(places) <= LEAF:
            return places
        # the vector furthest from the first one tells the rest apart better than any
        first = _chord(self.units[places[:1]], self.units[places])[0]
        vantage = places[int(np.argmax(first))]
        away = _chord(self.units[vantage][None], self.units[places])[0]
        order = np.argsort(away, kind="stable")
        half = len(places) // 2
        parts = []
        for own in (order[:half], order[half:]):
            parts += [self._node(places[own]), (away[own[0]], away[own[-1]])]
        return (vantage, *parts)


class Nearest:
    """The best distances so far of a block of queries, and the places within them."""

    def __init__(self, tree: Tree, units: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, factor: float):
        self.tree, self.units, self.own, self.k, self.factor = tree, units, own, k, factor
        self.best = np.full((len(units), k), np.inf)
        self.bound = bound.copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _look(self, places: np.ndarray, asked: np.ndarray) -> None:
        away = _chord(self.units[asked], self.tree.units[places])
        away[self.own[asked][:, None] == places[None]] = np.inf
        near = np.sort(np.concatenate((self.best[asked], away), axis=1), axis=1)[:, :self.k]
        self.best[asked] = near
        self.bound[asked] = np.minimum(self.bound[asked], near[:, -1])
        row, column = np.nonzero((away <= self.bound[asked][:, None] + SLACK) & np.isfinite(away))
        self.found.append((asked[row], places[column], away[row, column]))

    def walk(self, node, asked: np.ndarray) -> None:
        if not len(asked):
            return
        if isinstance(node, np.ndarray):
            self._look(node, asked)
            return
        vantage, inner, (near, middle), outer, (beyond, far) = node
        away = _chord(self.units[asked], self.tree.units[vantage][None])[:, 0]
        least = {0: np.maximum(away - middle, near - away), 1: np.maximum(away - far, beyond - away)}
        inside = away <= (middle + beyond) / 2
        for first, group in ((0, inside), (1, ~inside)):
            for half in (first, 1 - first):
                needed = group & (least[half] <= self.factor * self.bound[asked] + SLACK)
                self.walk((inner, outer)[half], asked[needed])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and of vectors that may be among the ``k`` nearest."""
        asked, place, away = (np.concatenate(c) for c in zip(*self.found))
        kept = away <= self.bound[asked] + SLACK
        return asked[kept], place[kept]


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


@dataclass(frozen=True)
class Index:
    """Vectors with their shards, and what is known of each shard."""

    table: DataFrame
    pivots: dict[int, np.ndarray]
    #: By vector length: pivot, parts, least and greatest distance to the pivot, in order.
    shards: dict[int, list[tuple[int, int, float, float]]]


def _home(units: np.ndarray, pivots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if pivots is None:
        return np.full(len(units), -1), np.zeros(len(units))
    away = _chord(units, pivots)
    home = np.argmin(away, axis=1)
    return home, away[np.arange(len(units)), home]


def build(df: DataFrame, key: str = "vec_id", vector: str = "embedding", *, shard: int = SHARD) -> Index:
    """Cuts the vectors into shards and writes them to the shared folder."""
    rows = (
        df.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        .groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector"))
    )
    rows = write_through(rows, "vectors")
    wanted = min(MOST_PIVOTS, -(-rows.count() // shard))
    pivots: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect():
        pivots.setdefault(r["size"], []).append(r["vector"])
    units = {n: _unit(np.array(v)) for n, v in pivots.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors, sizes in arrays(batches, "vec_id", "vector", "size"):
            size = sizes.to_numpy()
            for n in np.unique(size).tolist():
                own = pa.array(np.flatnonzero(size == n))
                part = vectors.take(own)
                home, away = _home(_unit(_matrix(part, n)), units.get(n))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(own), part, sizes.take(own), pa.array(home.astype(np.int32)), pa.array(away)],
                    ["vec_id", "vector", "size", "pivot", "away"],
                )

    cut = rows.mapInArrow(assign, "vec_id long, vector array<double>, size int, pivot int, away double")
    cut = write_through(cut, "vector-shards")
    shards: dict[int, list] = {}
    figures = cut.groupBy("size", "pivot").agg(
        F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most")
    )
    for r in figures.orderBy("size", "pivot").collect():
        shards.setdefault(r["size"], []).append((r["pivot"], -(-r["n"] // shard), r["least"], r["most"]))
    return Index(cut, units, shards)


def _routed(queries: DataFrame, index: Index, factor: float, home_only: bool) -> DataFrame:
    """Queries once for each shard and part they have to visit."""
    pivots, shards = index.pivots, index.shards

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors, sizes, homes, bounds in arrays(batches, "vec_id", "vector", "size", "pivot", "bound"):
            size, home, bound = sizes.to_numpy(), homes.to_numpy(), bounds.to_numpy()
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                units = _unit(_matrix(vectors.take(pa.array(rows)), n))
                for pivot, parts, least, most in shards[n]:
                    if home_only:
                        visit = home[rows] == pivot
                    else:
                        away = _chord(units, pivots[n][pivot][None])[:, 0] if pivot >= 0 else np.zeros(len(rows))
                        far = np.maximum(away - most, least - away)
                        visit = (home[rows] != pivot) & (far <= factor * bound[rows] + SLACK)
                    own = pa.array(np.repeat(rows[visit], parts))
                    if len(own):
                        yield pa.RecordBatch.from_arrays([
                            ids.take(own), vectors.take(own), sizes.take(own),
                            pa.array(np.full(len(own), pivot, dtype=np.int32)),
                            pa.array(np.tile(np.arange(parts, dtype=np.int32), int(visit.sum()))), bounds.take(own),
                        ], ["vec_id", "vector", "size", "pivot", "part", "bound"])

    return queries.mapInArrow(
        route, "vec_id long, vector array<double>, size int, pivot int, part int, bound double"
    )


def _searched(index: Index, routed: DataFrame, k: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score) of what may be nearest, by shard and part."""
    parts = F.lit(1)
    for size, known in index.shards.items():
        for pivot, n, _, _ in known:
            if n > 1:
                parts = F.when((F.col("size") == size) & (F.col("pivot") == pivot), F.lit(n)).otherwise(parts)
    part = F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part")
    vectors = index.table.select(
        "vec_id", "vector", "size", "pivot", part, F.lit(None).cast("double").alias("bound"), F.lit(0).alias("role")
    )

    def answer(ids, vectors, tree, asked_ids, asked, bounds) -> Iterator[pa.RecordBatch]:
        place = {v: i for i, v in enumerate(ids.tolist())}
        for s in range(0, len(asked_ids), TOGETHER):
            own = asked_ids[s:s + TOGETHER]
            block = asked[s:s + TOGETHER]
            itself = np.array([place.get(v, -1) for v in own.tolist()])
            search = Nearest(tree, _unit(block), itself, bounds[s:s + TOGETHER], k, factor)
            search.walk(tree.root, np.arange(len(own)))
            if not search.found:
                continue
            row, near = search.pairs()
            order = np.argsort(row, kind="stable")
            row, near = row[order], near[order]
            border = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True]))) if len(row) else [0]
            out = []
            for a, b in zip(border[:-1], border[1:]):
                score = cosine(block[row[a]], vectors[near[a:b]])
                best = np.lexsort((ids[near[a:b]], -score))[:k]
                out.append((np.full(len(best), own[row[a]]), ids[near[a:b]][best], score[best]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"]
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("size", "pivot", "part", "role")], axis=1)
            border = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
            for s, e in zip(border[:-1].tolist(), border[1:].tolist()):
                shard, role = tuple(keys[s, :3].tolist()), keys[s, 3]
                rows = batch.slice(s, e - s)
                ids = rows.column("vec_id").to_numpy()
                own = _matrix(rows.column("vector"), shard[0])
                if shard != at:
                    at, held, tree = shard, [], None
                if role == 0:
                    held.append((ids, own))
                elif held:
                    if tree is None:
                        held = [tuple(np.concatenate(c) for c in zip(*held))]
                        tree = Tree(_unit(held[0][1]))
                    yield from answer(*held[0], tree, ids, own, rows.column("bound").to_numpy())

    both = vectors.unionByName(routed.withColumn("role", F.lit(1)))
    return (
        both.repartition("size", "pivot", "part").sortWithinPartitions("size", "pivot", "part", "role")
        .mapInArrow(search, "query_id long, vec_id long, score double")
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: Column, *, k: int = 5, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest for the rows where ``queries`` holds.

    ``queries`` is a condition on ``vec_id``. A vector is never its own neighbour.
    """
    asked = index.table.where(queries).select("vec_id", "vector", "size", "pivot")
    unbounded = asked.withColumn("bound", F.lit(float("inf")))
    first = write_through(_best(_searched(index, _routed(unbounded, index, factor, True), k, factor), k), "first-found")
    worst = first.where(F.col("rank") == k).select(
        F.col("query_id").alias("vec_id"), F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("worst")
    )
    bounded = asked.join(worst, "vec_id", "left").withColumn("bound", F.coalesce("worst", F.lit(float("inf"))))
    other = _searched(index, _routed(bounded.drop("worst"), index, factor, False), k, factor)
    return _best(first.drop("rank").unionByName(other), k).select("query_id", "rank", "vec_id", "score")

"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Numbers. An entry c becomes the whole number x = floor(1024 c) + 100000. Counts and sums of the
fit rows are exact, and a row is centred exactly, as n x - S, before anything is multiplied.

Method. With A the centred rows, A V = U B and A'U = V B' (+ a rest) are built block by block: a
product of A with the newest right vectors, made orthogonal to all earlier left vectors and to
each other, gives new left vectors; a product of A' with these, made orthogonal to all earlier
right vectors, gives the next right vectors. B is upper bidiagonal in blocks of ``block`` (upper
bidiagonal for ``block=1``). With singular values s and right vectors w of the small B, the
components are V w and the eigenvalues of the covariance s^2 / n. Where a block loses rank, fresh
directions orthogonal to all others fill it up, so repeated eigenvalues are found as well.

Scale. A left vector has an entry per row, yet is never stored: it is A y for a short vector y,
so each pass over the rows works it out anew and needs nothing that an executor might lose. One
pass gives both products, A Q and A'(A Q), their inner products and those with all earlier left
vectors: a full run takes d / ``block`` passes, fewer if the leading components converge. Blocks that
are ill-conditioned take a second pass. A pass is a scan of the vectors alone; its tasks send
sums of d x ``block`` numbers, added up by Spark; the driver sees only these. A pass reads ``df`` again, so give a
table that is cheap to read.

Stopping before all d directions are used needs residuals at rounding level and a remaining
variance below the last wanted eigenvalue, so that no component can have been missed.

Defined cases. Vectors that are null or hold null or non-finite entries take no part. Should
lengths differ, those of the most frequent length (the longest of equal ones) are the vectors. Entries
beyond 2^36 / 1024 count as that. A component without variance (of rank-deficient rows) is
left out: its rows cannot be scaled. Repeated rows count each. A deviation beyond a long is
null. An empty table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import arrays

SCALE, SHIFT, MOST = 1024.0, 100_000, float(1 << 36)
#: Share of the whole variance below which a direction has none, residuals that count as none,
#: and the condition of a block's inner products from which it is made orthogonal twice.
NO_VARIANCE, CONVERGED, ILL = 1e-13, 1e-13, 1e3


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    entry = F.lit(float("inf"))
    return F.coalesce(
        F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < entry), F.lit(False))),
        F.lit(False),
    )


def whole(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a column take part, and these as whole numbers."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fit = sizes == width
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values[np.repeat(fit, np.maximum(sizes, 0))].reshape(-1, width)
    finite = np.isfinite(rows).all(axis=1)
    kept = np.zeros(len(sizes), dtype=bool)
    kept[np.flatnonzero(fit)[finite]] = True
    with np.errstate(over="ignore"):
        return kept, np.clip(np.floor(rows[finite] * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def scaled_offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 61:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def squared_lengths(offsets: np.ndarray) -> pa.Array:
    """Exact sums of squares as longs, null where a long cannot hold them."""
    rough = np.square(offsets.astype(np.float64)).sum(axis=1)
    safe = rough < 9e18
    whole_ones = offsets[safe].astype(np.int64)
    out = np.zeros(len(offsets), dtype=object)
    out[safe] = np.square(whole_ones).sum(axis=1)
    for i in np.flatnonzero(~safe):
        total = sum(int(v) ** 2 for v in offsets[i])
        out[i] = total if total < 1 << 63 else None
    return pa.array(out.tolist(), pa.int64())


@dataclass(frozen=True)
class Vectors:
    """A table's vectors with their exact count and sums."""

    df: DataFrame
    column: str
    width: int
    n: int
    sums: list[int]

    @staticmethod
    def of(df: DataFrame, column: str) -> Vectors:
        vectors = df.select(F.col(column).alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
        found = vectors.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        if found is None:
            return Vectors(df, column, 0, 0, [])
        width, n = found["width"], found["count"]

        def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width, dtype=np.int64)
            for (rows,) in arrays(batches, "v"):
                total += whole(rows, width)[1].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["i", "s"])

        parts = df.select(F.col(column).alias("v")).mapInArrow(added, "i int, s long")
        sums = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect()}
        return Vectors(df, column, width, n, [sums[i] for i in range(width)])

    def totals(self, measure: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all batches of centred rows of a function of each: one pass."""
        width, n, sums = self.width, self.n, self.sums

        def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for (rows,) in arrays(batches, "v"):
                part = measure((scaled_offsets(whole(rows, width)[1], n, sums) / n).astype(np.float64))
                total = part if total is None else total + part
            if total is not None:
                index = np.arange(len(total), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(total)], ["i", "s"])

        parts = self.df.select(F.col(self.column).alias("v")).mapInArrow(measured, "i int, s double")
        found = {r["i"]: r["s"] for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect()}
        return np.array([found[i] for i in range(len(found))])


def _outside(z: np.ndarray, v: np.ndarray) -> np.ndarray:
    """What of z's columns lies outside the span of v's orthonormal ones."""
    for _ in range(2):
        z = z - v @ (v.T @ z)
    return z


def _basis(z: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal columns that span z's columns, without directions of norm ``least`` or less."""
    if not z.size:
        return z[:, :0]
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    return u[:, s > least]


def _root(gram: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """For inner products P'P of columns P: R and an inverse K so that P K is orthonormal and P = (P K) R
    but for directions whose square is ``least`` or less; and the condition of what is kept."""
    values, axes = np.linalg.eigh((gram + gram.T) / 2)
    kept = values > max(least, 0.0)
    values, axes = values[kept], axes[:, kept]
    root = np.sqrt(values)
    return root[:, None] * axes.T, axes / root, float(values.max() / values.min()) if len(values) else 1.0


@dataclass(frozen=True)
class Spectrum:
    """Leading components as columns, their eigenvalues, and the whole variance."""

    components: np.ndarray
    eigenvalues: np.ndarray
    variance: float


def bidiagonalise(vectors: Vectors, k: int, block: int = 8, seed: int = 11) -> Spectrum:
    """The ``k`` leading components of the covariance of the vectors."""
    d, n = vectors.width, vectors.n
    random = np.random.default_rng(seed)
    v, y, w = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    b, energy = np.zeros((0, 0)), None
    newest = np.linalg.qr(random.standard_normal((d, min(block, d))))[0]

    def both_products(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """P'P, U'P and A'P of P = A q, and the sum of A's squares."""
        m, c, left = y.shape[1], q.shape[1], y

        def measure(a: np.ndarray) -> np.ndarray:
            p = a @ q
            return np.concatenate([(p.T @ p).ravel(), ((a @ left).T @ p).ravel(), (a.T @ p).ravel(), [np.square(a).sum()]])

        found = vectors.totals(measure)
        at = np.cumsum([c * c, m * c, d * c])
        gram, inner, back = np.split(found[:at[-1]], at[:-1])
        return gram.reshape(c, c), inner.reshape(m, c), back.reshape(d, c), float(found[-1])

    while True:
        # A newest = U old + P: what the earlier left vectors share is known from their products with A'
        old = w.T @ newest
        q = newest - y @ old
        upper = np.eye(newest.shape[1])
        for again in range(2):
            gram, inner, back, total = both_products(q)
            energy = total if energy is None else energy
            q, back, gram = q - y @ inner, back - w @ inner, gram - inner.T @ inner
            old = old + inner @ upper
            root, inverse, condition = _root(gram, 1e-14 if again else NO_VARIANCE * energy)
            q, back, upper = q @ inverse, back @ inverse, root @ upper
            if condition < ILL or not q.size:
                break
        b = np.block([[b, old], [np.zeros((q.shape[1], b.shape[1])), upper]])
        v, y, w = np.hstack([v, newest]), np.hstack([y, q]), np.hstack([w, back])
        if v.shape[1] == d or energy <= 0:
            break
        rest = _outside(back, v)
        following = _basis(rest, NO_VARIANCE * np.sqrt(energy))
        if _settled(b, rest, energy, k):
            break
        wanted = min(block, d - v.shape[1]) - following.shape[1]
        if wanted > 0:
            taken = np.hstack([v, following])
            following = np.hstack([following, _basis(_outside(random.standard_normal((d, wanted)), taken), 1e-6)])
        newest = following[:, :d - v.shape[1]]

    _, s, axes = np.linalg.svd(b)
    values = np.square(s)[:k]
    found = (v @ axes.T)[:, :len(values)]
    kept = values > NO_VARIANCE * energy
    found, values = found[:, kept], values[kept]
    largest = found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])]
    return Spectrum(found * np.where(largest < 0, -1.0, 1.0), values / n, energy / n)


def _settled(b: np.ndarray, rest: np.ndarray, energy: float, k: int) -> bool:
    """Whether the ``k`` leading triplets have converged and what lies outside cannot hold a larger one."""
    left, s, _ = np.linalg.svd(b)
    if len(s) < k:
        return False
    residual = np.linalg.norm(rest @ left[-rest.shape[1]:, :k], axis=0) if rest.shape[1] else np.zeros(k)
    remaining = energy - float(np.square(s).sum())
    return bool((residual <= CONVERGED * s[0]).all() and remaining < s[k - 1] ** 2)


def whitened(df: DataFrame, key: str, column: str, k: int = 8, block: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every vector and component."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    vectors = Vectors.of(df, column)
    width, n, sums = vectors.width, vectors.n, vectors.sums
    spectrum = bidiagonalise(vectors, k, block) if n else Spectrum(np.zeros((0, 0)), np.zeros(0), 0.0)
    count = len(spectrum.eigenvalues)
    scaled = spectrum.components / np.sqrt(spectrum.eigenvalues)
    error = 0.0
    if count:
        def moments(a: np.ndarray) -> np.ndarray:
            p = a @ scaled
            return np.concatenate([p.sum(axis=0), (p.T @ p).ravel()])

        found = vectors.totals(moments) / n
        mean = found[:count]
        error = float(np.abs(found[count:].reshape(count, count) - np.outer(mean, mean) - np.eye(count)).max())

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, rows in arrays(batches, key, "v"):
            kept, x = whole(rows, width)
            offsets = scaled_offsets(x, n, sums)
            values = (offsets / n).astype(np.float64) @ scaled
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(values) * count + 1, count, dtype=np.int32)), pa.array(values.ravel())
            )
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(kept)), squared_lengths(offsets), lists], [key, "deviation", "w"])

    explained = F.array(*[F.lit(float(e / spectrum.variance)) for e in spectrum.eigenvalues])
    source = df.select(key, F.col(column).alias("v"))
    # a table without usable vectors, or whose vectors are all equal, has no component
    rows = (source if count else source.limit(0)).mapInArrow(project, f"`{key}` {fields[key]}, deviation long, w array<double>")
    out = rows.select(key, "deviation", F.posexplode("w").alias("component", "whitened"))
    return out.select(
        key, (F.col("component") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained.cast("array<double>"), F.col("component")).alias("explained"), F.lit(error).alias("identity_error"),
    )

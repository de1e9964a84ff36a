"""Whitening against an eigendecomposition of the whole covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.llm import whitening

NAN, INF = float("nan"), float("inf")


def plain(rows, k=8):
    """{id: (deviation, whitened up to sign)}, eigenvalues and total, from all rows at once."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows], dtype=np.int64)
    n = len(x)
    sums = x.sum(axis=0)
    deviations = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    a = (x * n - sums) / n
    values, axes = np.linalg.eigh(a.T @ a / n)
    order = np.argsort(-values)[:k]
    order = [i for i in order if values[i] > 1e-13 * values.sum()]
    return deviations, a @ axes[:, order] / np.sqrt(values[order]), values[order], values.sum()


def check(spark, rows, got, k=8, tolerance=1e-8):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    deviations, w, values, total = plain(good, k)
    table = {}
    for r in got:
        table.setdefault(r["vec_id"], []).append(r)
    assert len(got) == len(good) * len(values) and set(table) == {i for i, _ in good}
    signs = {}
    for at, (i, _) in enumerate(good):
        # rows with the same id have the same vector here
        found = [r for _, r in sorted({r["component"]: r for r in table[i]}.items())]
        assert [r["component"] for r in found] == list(range(1, len(values) + 1))
        for j, r in enumerate(found):
            sign = signs.setdefault(j, 1.0 if r["whitened"] * w[at, j] >= 0 else -1.0) if abs(w[at, j]) > 1e-3 else signs.get(j, 1.0)
            if abs(w[at, j]) > 1e-3:
                assert r["whitened"] * sign == pytest.approx(w[at, j], rel=tolerance, abs=tolerance)
            assert r["n"] == len(good) and r["deviation"] == deviations[at]
            assert r["explained"] == pytest.approx(values[j] / total, rel=1e-9)
            assert r["identity_error"] < 1e-6


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, v array<double>, n string, whitened double")


@pytest.mark.parametrize("width,block", [(20, 8), (20, 1), (5, 8), (12, 5)])
def test_equals_an_eigendecomposition(spark, width, block):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, width)) * np.linspace(1, 0.1, width) + rng.standard_normal((300, 1))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(900, None), (901, [NAN] * width), (902, [INF] + [0.0] * (width - 1)), (903, [None] + [0.5] * (width - 1)), (904, [])]
    rows[5:5] = [(700, rows[0][1])] * 3
    rows = rows[:4] + [(1000 + i, v) for i, v in rows[5:8]] + rows[8:]
    got = whitening.whitened(vectors(spark, rows).repartition(7), "vec_id", "v", block=block).collect()
    check(spark, [r for r in rows if r[1] != []], got)


def test_bidiagonal_form(spark):
    """With single vectors B is upper bidiagonal, A V = U B, and V is orthonormal."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((60, 6)))]
    found = whitening.Vectors.of(vectors(spark, rows), "v")
    seen = []
    real = np.linalg.svd
    spectrum = None
    try:
        np.linalg.svd = lambda m, *a, **o: (seen.append(m.copy()), real(m, *a, **o))[1]
        spectrum = whitening.bidiagonalise(found, 6, block=1)
    finally:
        np.linalg.svd = real
    b = seen[-1]
    assert b.shape == (6, 6)
    off = b - np.diag(np.diag(b)) - np.diag(np.diag(b, 1), 1)
    assert np.abs(off).max() < 1e-9 * np.abs(b).max()
    assert np.abs(spectrum.components.T @ spectrum.components - np.eye(6)).max() < 1e-12


def test_repeated_eigenvalues_and_lost_rank(spark):
    """Four equal leading eigenvalues, then none: the space they span is found, and nothing beyond."""
    rows = []
    for axis in range(4):
        for sign in (1.0, -1.0):
            v = [0.0] * 9
            v[axis] = sign
            rows.append((len(rows), v))
    for block in (1, 2, 8):
        got = whitening.whitened(vectors(spark, rows), "vec_id", "v", block=block).collect()
        assert len(got) == 8 * 4 and all(r["explained"] == pytest.approx(0.25, rel=1e-6) for r in got)
        assert all(r["identity_error"] < 1e-9 for r in got)


def test_full_run_stops_early_only_when_nothing_can_be_missed(spark):
    """Three strong directions among forty: few passes are enough for them."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 3)) @ rng.standard_normal((3, 40)) * 10 + rng.standard_normal((400, 40)) * 0.01
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    found = whitening.Vectors.of(vectors(spark, rows), "v")
    passes = []
    counted = whitening.Vectors.totals
    try:
        whitening.Vectors.totals = lambda self, m: (passes.append(1), counted(self, m))[1]
        spectrum = whitening.bidiagonalise(found, 3, block=3)
    finally:
        whitening.Vectors.totals = counted
    _, _, values, _ = plain(rows, 3)
    assert spectrum.eigenvalues == pytest.approx(values, rel=1e-9) and len(passes) < 12


def test_large_numbers_stay_exact():
    n, sums = 3_000_000_000, [3_000_000_000 * 100_100, 3_000_000_000 * 99_900]
    x = np.array([[100_612, 99_388], [100_100, 99_901]], dtype=np.int64)
    offsets = whitening.scaled_offsets(x, n, sums)
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x]
    assert whitening.squared_lengths(offsets).to_pylist() == [e if e < 1 << 63 else None for e in exact]
    assert whitening.squared_lengths(np.array([[3, 4], [1 << 40, 0]])).to_pylist() == [25, None]


def test_without_variance_or_rows(spark):
    assert whitening.whitened(vectors(spark, []), "vec_id", "v").collect() == []
    assert whitening.whitened(vectors(spark, [(1, [0.5, 2.0])] * 3), "vec_id", "v").collect() == []
    assert whitening.whitened(vectors(spark, [(1, None), (2, [])]), "vec_id", "v").collect() == []
    got = whitening.whitened(vectors(spark, [(1, [0.5, 1e300]), (2, [0.25, -1e300])]), "vec_id", "v").collect()
    assert {r["component"] for r in got} == {1}


def test_query(spark, sf_dir):
    from tallyrank.llm.queries import REGISTRY

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = [(r["vec_id"], list(r["v"])) for r in table.collect()]
    check(spark, rows, REGISTRY["op11_whitening"](spark, sf_dir).collect())

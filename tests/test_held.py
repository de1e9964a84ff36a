"""Blocks that stay on executors: one pass after another against all rows at once."""

import os
import shutil
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyrank.ml import compare, gradient, held, stack

# workers cannot import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def summed(blocks):
    return sum(np.array([n.sum(), state.sum()]) for n, _, state in blocks)


def added(block, step):
    return block[0], block[1], block[2] + step * block[1]


def blocks(spark, sizes):
    def made(i):
        r = np.random.default_rng(i)
        return r.integers(0, 9, (3, sizes[i])).astype(np.uint8), r.random(sizes[i]), np.zeros(sizes[i])

    return spark.sparkContext.parallelize(range(len(sizes)), len(sizes)).filter(lambda i: sizes[i]).map(made)


def wanted(rows, steps):
    return [sum(b[0].sum() for b in rows), sum(steps) * sum(b[1].sum() for b in rows)]


@pytest.mark.parametrize("many", [held.MANY, 0])
def test_passes_after_steps(spark, many, monkeypatch):
    monkeypatch.setattr(held, "MANY", many)
    source = blocks(spark, (70_000, 5, 0, 40_000))
    rows, spread, steps = source.collect(), held.Spread(source, added, 10), []
    for step in (0.5, 2.0, -1.0):
        assert spread.gathered(summed, size=2) == pytest.approx(wanted(rows, steps))
        assert spread.gathered(summed, size=2) == pytest.approx(wanted(rows, steps))
        steps.append(step)
        spread.step(step)
    folders = [t.folder for t in spread.tokens.collect() if t.folder]
    assert len(folders) == 3 and all(map(os.path.isdir, folders)) and spread.sent is None
    spread.close()
    assert not any(map(os.path.isdir, folders))


@pytest.mark.parametrize("lost", ["states", "folder"])
def test_lost_files(spark, lost):
    """States that are gone are worked out from the first one; rows that are gone come from Spark."""
    source = blocks(spark, (30_000, 50_000))
    rows, spread, steps = source.collect(), held.Spread(source, added, 2), []
    for step in (0.5, 2.0, -1.0, 3.0, 7.0, 1.5):
        spread.gathered(summed)
        if len(steps) == 3:
            folder = spread.tokens.collect()[1].folder
            if lost == "folder":
                shutil.rmtree(folder)
            else:
                os.remove(f"{folder}/{held.STATE}-3")
        steps.append(step)
        spread.step(step)
    assert spread.gathered(summed) == pytest.approx(wanted(rows, steps))
    assert (spread.sent is not None) == (lost == "folder")
    spread.close()


def test_no_rows(spark):
    spread = held.Spread(blocks(spark, (0, 0)), added, 2)
    assert spread.gathered(summed) is None
    spread.close()


def test_signs_are_counted_as_cells():
    rng = np.random.default_rng(1)
    widths = [32, 2, 7, 32, 12, 1]
    tree = gradient.Tree(
        np.array([0, 3, 2, -1, -1, -1, -1]), np.array([9, 20, 3, 0, 0, 0, 0]), np.zeros(7), np.array([1, 3, 5, -1, -1, -1, -1]),
        np.zeros(7), np.zeros(7),
    )
    parts = [(np.stack([rng.integers(0, w, n) for w in widths]).astype(np.uint8), rng.random(n), rng.random(n)) for n in (400, 1, 90)]
    for frontier in ([0], [1, 2], [3, 5, 6]):
        below = gradient.Tree(*[getattr(tree, c).copy() for c in gradient._COLUMNS])
        if frontier[0] < 3:
            below.feature[frontier] = -1
        got = gradient._histograms(iter(parts), below, np.array(frontier), "absolute", widths)
        want = sum(
            gradient.cells(b, np.where(y - t < 0, -1.0, 1.0), None, below, np.array(frontier), 32) for b, y, t in parts
        )
        assert got.tolist() == want.tolist()


@pytest.mark.parametrize("loss", gradient.LOSSES)
def test_gradient_boosting_in_one_task_and_in_many(spark, loss, monkeypatch):
    """Many tasks read the rows' files at each pass; the rows themselves are sent to no pass."""
    i = F.col("id")
    table = spark.range(3000).repartition(3).select(
        (i % 23).alias("a"), (i % 7).alias("b"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100 + i % 23).alias("rating")
    )
    vectors = stack.assembler(["a", "b"]).transform(table)
    learner = compare.gradient_boosting(rounds=12, lossType=loss, stepSize=0.4)
    near = learner.fit(vectors)
    made = []
    spread = gradient.Spread
    monkeypatch.setattr(gradient, "Spread", lambda *args: made.append(spread(*args)) or made[-1])
    monkeypatch.setattr(gradient, "ROWS", 10)
    many = learner.fit(vectors)
    assert len(made) == 1 and made[0].sent is None and len(near.trees) == len(many.trees) == 12
    pairs = many.transform(near.transform(vectors).withColumnRenamed("predicted", "p")).select("p", "predicted").collect()
    assert [r["predicted"] for r in pairs] == pytest.approx([r["p"] for r in pairs])

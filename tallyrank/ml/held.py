"""Blocks of rows for models that pass over the same rows hundreds of times.

A block is (bins, labels, state, …): arrays over some rows, whose state a finished step of the model
renews. Where one task holds all rows, :class:`Near` runs every pass there. Otherwise an executor
keeps the blocks of its partitions in files of its own, which any of its Python workers maps into
memory (:class:`Spread`): a pass sends no rows, and a step is applied to the state once, by the first
pass after it. What is cached for a partition is only the name of its files, so that tasks go where they
lie; a lost executor loses both, and its partitions are built anew with all steps so far. If a
task does not find the files of its partition, the fit goes on without them: blocks are then cached by
Spark and sent to the workers at every pass.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce
from typing import Any, NamedTuple

import numpy as np
from pyspark import RDD, SparkFiles, StorageLevel

Block = tuple[np.ndarray, ...]
Work = Callable[[Iterator[Block]], Any]
Renew = Callable[[Block, Any], Block]
#: Rows worked on at a time, so that what is worked out of them stays close to the processor.
NEAR = 1 << 15
#: Numbers that the results of all partitions may hold for the driver to add them up by itself.
MANY = 1 << 23
#: Bytes that a worker does not hold back.
EARLY = (1 << 16) + 1
#: Place of the state in a block.
STATE = 2


def cut(blocks: Iterator[Block]) -> Iterator[Block]:
    """The same rows in blocks of at most ``NEAR``."""
    for block in blocks:
        for start in range(0, block[0].shape[-1], NEAR):
            yield tuple(np.ascontiguousarray(a[..., start:start + NEAR]) for a in block)


class Near:
    """Blocks that lie in one task."""

    def __init__(self, blocks: Iterator[Block], renew: Renew):
        self.blocks, self.renew = list(cut(blocks)), renew

    def gathered(self, work: Work, combine: Callable = np.add, size: int = 0) -> Any:
        return work(iter(self.blocks))

    def step(self, done: Any) -> None:
        self.blocks = [self.renew(block, done) for block in self.blocks]


class Kept(NamedTuple):
    """Files of a partition: their folder, rows of each block, and width and kind of each array."""

    folder: str | None
    lengths: list[int]
    arrays: list[tuple[int, str]]


def _stored(blocks: Iterator[Block]) -> Iterator[Kept]:
    folder, lengths, arrays, files = None, [], [], []
    try:
        for block in cut(blocks):
            if folder is None:
                # this folder goes with the executor
                folder = tempfile.mkdtemp(prefix="held-", dir=SparkFiles.getRootDirectory())
                arrays = [(1 if a.ndim == 1 else a.shape[0], a.dtype.str) for a in block]
                files = [open(_path(folder, i, 0), "wb") for i in range(len(block))]
            for file, a in zip(files, block):
                a.tofile(file)
            lengths.append(block[0].shape[-1])
    except OSError:
        # no room: the blocks stay with Spark
        if folder:
            shutil.rmtree(folder, ignore_errors=True)
        folder = None
        lengths.append(0)
        for _ in blocks:
            pass
    finally:
        for file in files:
            file.close()
    yield Kept(folder, lengths, arrays)


def _path(folder: str, array: int, step: int) -> str:
    return f"{folder}/{array}-{step}"


def _blocks(kept: Kept, step: int) -> Iterator[Block]:
    """Blocks with the state after a step."""
    held = [
        np.memmap(_path(kept.folder, i, step if i == STATE else 0), dtype=kind, mode="r").view(np.ndarray)
        for i, (_, kind) in enumerate(kept.arrays)
    ]
    at = 0
    for n in kept.lengths:
        yield tuple(
            a[w * at:w * (at + n)].reshape(w, n) if i == 0 else a[at:at + n]
            for i, (a, (w, _)) in enumerate(zip(held, kept.arrays))
        )
        at += n


def _renewed(kept: Kept, steps: Sequence[Any], upto: int, renew: Renew) -> bool:
    """Whether there is a file of the state after ``upto`` steps, now; ``steps`` are the last ones of these."""
    path, first = _path(kept.folder, STATE, upto), upto - len(steps)
    if os.path.exists(path):
        return True
    there = [int(name.split("-")[1]) for name in os.listdir(kept.folder) if name.startswith(f"{STATE}-") and name.count("-") == 1]
    known = max((v for v in there if first <= v < upto), default=None)
    if known is None:
        return False
    handle, made = tempfile.mkstemp(prefix="new-", dir=kept.folder)
    with os.fdopen(handle, "wb") as file:
        for block in _blocks(kept, known):
            reduce(renew, steps[known - first:], block)[STATE].tofile(file)
    os.replace(made, path)
    for v in there:
        # the first state stays, for a partition that has lost the others
        if 0 < v < upto:
            os.remove(_path(kept.folder, STATE, v))
    return True


def _passed(tokens: Iterator[Kept], steps: Sequence[Any], upto: int, renew: Renew, work: Work) -> Iterator[tuple[bool, Any]]:
    """(found, result) of a partition with rows."""
    for kept in tokens:
        if not kept.lengths:
            continue
        try:
            if kept.folder and os.path.isdir(kept.folder) and _renewed(kept, steps, upto, renew):
                yield True, work(_blocks(kept, upto))
                continue
        except OSError:
            pass
        yield False, None


def _removed(tokens: Iterator[Kept]) -> None:
    for kept in tokens:
        if kept.folder:
            shutil.rmtree(kept.folder, ignore_errors=True)


def _sent(blocks: Iterator[Block], since: Sequence[Any], renew: Renew, work: Work) -> Iterator[tuple[bool, Any]]:
    renewed = (reduce(renew, since, block) for block in cut(blocks))
    for first in renewed:
        yield True, work(block for part in ([first], renewed) for block in part)


def _early(rows: Iterator, inner: Callable[[Iterator], Iterator]) -> Iterator:
    """With an output before the first input: JVM and worker then do not wait 40 ms for each other's acknowledgements."""
    yield bytes(EARLY)
    yield from inner(rows)


def _both(a: tuple[bool, Any], b: tuple[bool, Any], combine: Callable) -> tuple[bool, Any]:
    return (True, combine(a[1], b[1])) if a[0] and b[0] else (False, None)


class Spread:
    """Blocks of many partitions; every pass is a job.

    ``every`` is after how many steps blocks that are sent to the workers are renewed.
    """

    def __init__(self, source: RDD, renew: Renew, every: int):
        self.source, self.renew, self.every, self.steps = source, renew, every, []
        self.tokens = source.mapPartitions(_stored).persist(StorageLevel.MEMORY_AND_DISK)
        self.sent, self.since, self.cached = None, [], []

    def gathered(self, work: Work, combine: Callable = np.add, size: int = 0) -> Any:
        """Results of all partitions, two at a time made one; None without rows. ``size`` is how many numbers a result holds."""
        if self.sent is None:
            # a partition has the state before the last step, or only the first state
            for steps in (self.steps[-1:], self.steps):
                passed = partial(_passed, steps=steps, upto=len(self.steps), renew=self.renew, work=work)
                found = self._pass(self.tokens, passed, combine, size)
                if found is None or found[0]:
                    return found and found[1]
            self.sent, self.since = self.source.persist(StorageLevel.MEMORY_AND_DISK), list(self.steps)
            self.cached = [self.sent]
        found = self._pass(self.sent, partial(_sent, since=self.since, renew=self.renew, work=work), combine, size)
        while len(self.cached) > 1:
            self.cached.pop(0).unpersist()
        return found and found[1]

    def _pass(self, rows: RDD, inner: Callable[[Iterator], Iterator], combine: Callable, size: int) -> tuple[bool, Any] | None:
        both = partial(_both, combine=combine)
        if size * rows.getNumPartitions() > MANY:
            results = rows.mapPartitions(inner)
            return None if results.isEmpty() else results.treeReduce(both)
        found = [r for r in rows.mapPartitions(partial(_early, inner=inner)).collect() if isinstance(r, tuple)]
        return reduce(both, found) if found else None

    def step(self, done: Any) -> None:
        self.steps.append(done)
        if self.sent is not None:
            self.since = [*self.since, done]
            if len(self.since) >= self.every:
                work, since = self.renew, self.since
                self.sent = self.sent.map(lambda block: reduce(work, since, block)).persist(StorageLevel.MEMORY_AND_DISK)
                self.cached.append(self.sent)
                self.since = []

    def close(self) -> None:
        self.tokens.foreachPartition(_removed)
        for each in (self.tokens, *self.cached):
            each.unpersist()

"""Merkle manifest of a table: a leaf per row, a tree per group, a tree over the groups, and proofs.

Tree. A leaf is a digest of a row's fields. In each group the leaves stand in a given order;
level by level every two consecutive nodes become their digest, an odd last one becomes the
digest of itself, until one node remains, the group's subroot. The subroots, in the order of
their groups, make one more tree, whose last node is the root. A digest is the hexadecimal
SHA-256 of concatenated texts.

Octopus multiproof. The leaves are dealt into leaf partitions of ``2**HEIGHT`` consecutive
leaves. A partition derives all interior nodes that its leaves determine, works out which node
coordinates (level, index) all of its proofs together still need (``missing``: the siblings of
what it can derive, each once), and fetches these by one join with the upper nodes. From both it
expands every leaf's own proof. Leaves that have not changed are folded to the root together,
as they share all interior nodes; a changed leaf is folded alone along its own proof.

Scale. Texts are read once and never move: the digest of a row is one SQL expression. What is
shuffled is a digest and a key per row: once to sort, by ranges over (group, key, leaf, source
row), so that neither a large group nor a repeated key makes a large task; once to meet in leaf
partitions, all of equal size; once to join what a partition fetches. Upper levels are built in
rounds of ``HEIGHT`` levels, each on a table ``2**HEIGHT`` times smaller; nothing is collected
but the root and the largest group's size. Sorted leaves and partitions are written to the
scratch folder, so a lost executor repeats tasks from there.

Defined cases. A null field is ``-``. Null groups come first, and null keys first in their
group; equal keys are ordered by leaf, and rows alike in all fields are each a leaf. A table of
one row has that leaf as subroot and root, and a proof without siblings. An empty table has no
rows and a null root. Columns beyond those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrank.llm.common import fresh
from tallyrank.session import write_through

#: Levels of a leaf partition; it has two to this power leaves.
HEIGHT = 13


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Digest of fields, each written as its length in bytes, ``:`` and its text, or ``-``."""

    def written(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(written, fields)), 256)


# --- one leaf partition ------------------------------------------------------


def missing(known: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Coordinates that the proofs of the known leaves need and these leaves do not determine.

    ``width`` is the number of leaves of the whole tree. Level by level the known nodes' siblings
    that exist and are not known themselves are needed; the parents are known then.
    """
    known, level, needed = np.unique(np.asarray(known, dtype=np.int64)), 0, []
    while width > 1 and len(known):
        siblings = known ^ 1
        wanted = siblings[(siblings < width) & ~np.isin(siblings, known, assume_unique=True)]
        needed += [(level, int(i)) for i in wanted]
        known, width, level = np.unique(known >> 1), (width + 1) // 2, level + 1
    return needed


def interiors(nodes: Sequence[str], alone: bool, height: int = HEIGHT) -> list[list[str]]:
    """A partition's nodes by level, up to its top; ``alone`` if there is no other partition."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1 or (not alone and len(levels) <= height):
        below = levels[-1]
        levels.append([digest(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return levels


def path(index: int, width: int, level: int, fetched: dict[tuple[int, int], str]) -> list[tuple[bool, str | None]]:
    """(whether the sibling is on the left, the sibling) at each level from ``level`` to the top."""
    steps = []
    while width > 1:
        sibling = index ^ 1
        steps.append((sibling < index, fetched[level, sibling] if sibling < width else None))
        index, width, level = index >> 1, (width + 1) // 2, level + 1
    return steps


def folded(node: str, steps: list[tuple[bool, str | None]]) -> str:
    """The root that a node and its siblings lead to."""
    for left, sibling in steps:
        node = digest(node) if sibling is None else digest(sibling, node) if left else digest(node, sibling)
    return node


def expanded(
    leaves: Sequence[str], changed: Sequence[str | None], levels: list[list[str]], above: list[tuple[bool, str | None]],
) -> list[tuple[str, str]]:
    """For each leaf the digest of its siblings and the root its changed or own leaf leads to."""
    together, out = folded(levels[-1][0], above), []
    upper = "".join(s for _, s in above if s is not None)
    for i, other in enumerate(changed):
        steps = []
        for level, nodes in enumerate(levels[:-1]):
            sibling = (i >> level) ^ 1
            steps.append((sibling < i >> level, nodes[sibling] if sibling < len(nodes) else None))
        proof = digest("".join(s for _, s in steps if s is not None), upper)
        out.append((proof, together if other is None else folded(folded(other, steps), above)))
    return out


# --- numbered nodes and their trees ------------------------------------------


def numbered(df: DataFrame, group: str, order: Sequence[str], out: str = "index") -> tuple[DataFrame, DataFrame]:
    """Adds each row's place (from 0) in the order of its group; and (group, width).

    Rows are sorted by ranges over the group, the order and the row they come from, so ranges are
    about equal whatever repeats. A row's number within its range and the counts of the ranges
    before it give its place.
    """
    source, at, part = fresh("source"), fresh("at"), fresh("part")
    keys = [group, *order, source]
    placed = df.withColumn(source, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the upper bits of this id are the number of the range, the lower ones the row's within it
    placed = placed.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)).drop(source)
    placed = write_through(placed, "merkle-sorted")
    sizes = placed.groupBy(group, part).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    widths = sizes.groupBy(group).agg(F.sum("_n").alias("width"))
    starts = sizes.select(group, part, (F.col("_before") - F.col("_first")).alias("_shift"))
    return placed.join(starts, [group, part]).withColumn(out, F.col("_shift") + F.col(at)).drop("_shift", at, part), widths


def _climbed(nodes: Column, alone: Column, height: int) -> Column:
    """All nodes of a partition above its own, with their level and index within it."""

    def climb(rows: pa.Array, single: pa.Array) -> pa.Array:
        found = []
        for row, one in zip(rows.to_pylist(), single.to_pylist()):
            levels = interiors(row, one, height)
            found.append([
                {"level": j, "index": i, "node": n} for j, level in enumerate(levels) for i, n in enumerate(level) if j
            ])
        return pa.array(found, pa.list_(pa.struct([("level", pa.int32()), ("index", pa.int64()), ("node", pa.string())])))

    return F.arrow_udf(climb, "array<struct<level:int,index:bigint,node:string>>")(nodes, alone)


def _top(nodes: Column, alone: Column, height: int) -> Column:
    """A partition's top node and its level."""

    def top(rows: pa.Array, single: pa.Array) -> pa.Array:
        levels = [interiors(row, one, height) for row, one in zip(rows.to_pylist(), single.to_pylist())]
        return pa.StructArray.from_arrays(
            [pa.array([len(x) - 1 for x in levels], pa.int32()), pa.array([x[-1][0] for x in levels], pa.string())],
            ["level", "node"],
        )

    return F.arrow_udf(top, "struct<level:int,node:string>")(nodes, alone)


def _missing(first: Column, count: Column, width: Column) -> Column:
    """The coordinates a run of leaves needs."""

    def needed(firsts: pa.Array, counts: pa.Array, widths: pa.Array) -> pa.Array:
        found = [
            [{"level": level, "index": i} for level, i in missing(np.arange(a, a + n), w)]
            for a, n, w in zip(firsts.to_pylist(), counts.to_pylist(), widths.to_pylist())
        ]
        return pa.array(found, pa.list_(pa.struct([("level", pa.int32()), ("index", pa.int64())])))

    return F.arrow_udf(needed, "array<struct<level:int,index:bigint>>")(first, count, width)


def _partitions(df: DataFrame, height: int, *carried: str) -> DataFrame:
    """(group, width, block, rows): the rows of each leaf partition in order."""
    block = F.shiftright("index", height).alias("block")
    return df.groupBy("group", "width", block).agg(
        F.sort_array(F.collect_list(F.struct("index", "node", *carried))).alias("rows")
    )


def _leaves() -> Column:
    return F.transform("rows", lambda r: r["node"])


def _alone(height: int) -> Column:
    return F.col("width") <= (1 << height)


def upper_nodes(tops: DataFrame, level: int, height: int) -> DataFrame:
    """All nodes at and above a level, from those of that level as (group, width, index, node).

    ``width`` is the number of nodes of that level. Each round adds up to ``height`` levels.
    """
    tops = tops.select("group", "width", "index", "node")
    found = [tops.select("group", F.lit(level).alias("level"), "index", "node", (F.col("width") == 1).alias("last"))]
    while True:
        widest = tops.agg(F.max("width")).first()[0]
        if widest is None or widest <= 1:
            break
        rows = _partitions(tops.where("width > 1"), height)
        nodes = rows.select("group", "width", "block", F.inline(_climbed(_leaves(), _alone(height), height)))
        nodes = write_through(nodes.select(
            "group", "width", F.col("level").alias("up"),
            (F.expr(f"shiftleft(block, {height} - level)") + F.col("index")).alias("index"), "node",
        ), "merkle-nodes")
        # the width of a level above: ceil(width / 2^up)
        width = F.expr("shiftright(width + shiftleft(1L, up) - 1, up)")
        found.append(nodes.select("group", (F.col("up") + level).alias("level"), "index", "node", (width == 1).alias("last")))
        tops = nodes.where((F.col("up") == height) & ~_alone(height)).select("group", width.alias("width"), "index", "node")
        level += height
    return reduce(DataFrame.unionByName, found)


@dataclass(frozen=True)
class Manifest:
    """Leaf partitions, the nodes above them (group, level, index, node), the groups with their
    subroot, place and siblings, and the root (None for an empty table)."""

    height: int
    blocks: DataFrame
    nodes: DataFrame
    groups: DataFrame
    root: str | None


def _fetched(wanted: DataFrame, nodes: DataFrame, *keys: str) -> DataFrame:
    """(keys, siblings): the nodes at the wanted (group, level, index) of each key."""
    return wanted.join(nodes, ["group", "level", "index"]).groupBy(*keys).agg(
        F.collect_list(F.struct("level", "index", "node")).alias("siblings")
    )


def build(rows: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest of (group, key, node, changed), ``node`` being a row's leaf and ``changed``
    the leaf to verify in its place, null if it is the same. ``group`` is a text without nulls."""
    placed, widths = numbered(rows, "group", ["key", "node"])
    placed = placed.join(widths, "group")
    blocks = write_through(_partitions(placed, height, "key", "changed"), "merkle-partitions")
    tops = write_through(blocks.select(
        "group", "width", F.col("block").alias("index"), _top(_leaves(), _alone(height), height).alias("top")
    ).select("group", "width", "index", "top.*"), "merkle-tops")
    several = tops.where(~_alone(height)).withColumn("width", F.ceil(F.col("width") / (1 << height)))
    nodes = upper_nodes(several, height, height).unionByName(
        tops.where(_alone(height)).select("group", "level", "index", "node", F.lit(True).alias("last"))
    )

    # the tree over the groups: its leaves are the subroots
    every = F.lit("")
    ordered, total = numbered(
        nodes.where("last").select(every.alias("tree"), "group", F.col("node").alias("subroot")), "tree", ["group"]
    )
    ordered = write_through(ordered.join(total, "tree"), "merkle-subroots")
    over = upper_nodes(ordered.select(F.col("tree").alias("group"), "width", "index", F.col("subroot").alias("node")), 0, height)
    over = write_through(over, "merkle-root")
    root = over.where("last").select("node").first()
    needed = _missing(F.col("index"), F.lit(1), F.col("width"))
    wanted = ordered.select(F.col("group").alias("member"), F.inline(needed), every.alias("group"))
    groups = ordered.select("group", "subroot", "index", F.col("width").alias("n_groups")).join(
        _fetched(wanted, over, "member").select(F.col("member").alias("group"), F.col("siblings").alias("over")), "group", "left"
    )
    return Manifest(height, blocks, nodes.drop("last"), write_through(groups, "merkle-groups"), root["node"] if root else None)


def _proofs(height: int, *columns: str | Column) -> Column:
    """For each leaf of a partition the digest of its proof and the root it leads to."""

    def by_place(nodes: list[dict] | None) -> dict[tuple[int, int], str]:
        return {(x["level"], x["index"]): x["node"] for x in nodes or ()}

    def prove_rows(*arrays: pa.Array) -> pa.Array:
        out = []
        for leaves, changed, block, width, near, place, n_groups, far in zip(*[a.to_pylist() for a in arrays]):
            alone = width <= 1 << height
            above = [] if alone else path(block, -(-width >> height), height, by_place(near))
            above += path(place, n_groups, 0, by_place(far))
            found = expanded(leaves, changed, interiors(leaves, alone, height), above)
            out.append([{"proof_sha256": p, "folded_root": r} for p, r in found])
        return pa.array(out, pa.list_(pa.struct([("proof_sha256", pa.string()), ("folded_root", pa.string())])))

    return F.arrow_udf(prove_rows, "array<struct<proof_sha256:string,folded_root:string>>")(*columns)


def prove(manifest: Manifest) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    blocks, height = manifest.blocks, manifest.height
    needed = _missing(F.shiftleft("block", height), F.size("rows"), F.col("width"))
    wanted = blocks.where(~_alone(height)).select("group", "block", F.inline(needed))
    held = blocks.join(_fetched(wanted, manifest.nodes, "group", "block"), ["group", "block"], "left").join(
        manifest.groups, "group"
    )
    proofs = _proofs(
        height, _leaves(), F.transform("rows", lambda r: r["changed"]), "block", "width", "siblings", "index", "n_groups", "over"
    )
    root = F.lit(manifest.root).cast("string")
    return held.select("subroot", F.inline(F.arrays_zip(F.col("rows").alias("row"), proofs.alias("proof")))).select(
        F.col("row.key").alias("key"), F.col("row.node").alias("leaf"), "subroot", root.alias("root"),
        F.col("proof.proof_sha256").alias("proof_sha256"), F.col("proof.folded_root").alias("folded_root"),
        (F.col("proof.folded_root") == root).alias("verified"),
    )


def rows_of(
    df: DataFrame, key: str, fields: Sequence[str], group: str, changed: Column, altered: dict[str, Column],
) -> DataFrame:
    """(group, key, node, changed) of a table: the leaf of each row's fields, and where ``changed``
    holds the leaf it would have with some fields altered."""
    node = leaf(*[F.col(f) for f in fields])
    other = leaf(*[altered.get(f, F.col(f)) for f in fields])
    # null comes before every text, and texts keep their order
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    return df.select(
        name.alias("group"), F.col(key).alias("key"), node.alias("node"), F.when(changed, other).alias("changed")
    )

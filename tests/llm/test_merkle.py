"""Trees, multiproofs and proofs against a plain construction."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.llm import merkle
from tallyrank.llm.common import remainder

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        yield i & 1, (level[i ^ 1] if i ^ 1 < len(level) else None)
        i >>= 1


def by_hand(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    for at, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            way = [*siblings(trees[g], i), *siblings(top, at)]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf((*row[:3], row[3] + 1, row[4])) if hit and row[3] is not None else leaf(row)
            for left, s in way:
                node = h(node) if s is None else h(s, node) if left else h(node, s)
            yield (
                row[0], leaf(row), trees[g][-1][0], top[-1][0], h(*[s for _, s in way if s is not None]), node,
                node == top[-1][0],
            )


def found(df, **options):
    rows = merkle.rows_of(
        df, "doc_id", FIELDS, "lang", changed=(remainder("doc_id", 7) == 0) & F.col("n_chars").isNotNull(),
        altered={"n_chars": F.col("n_chars") + 1},
    )
    return [tuple(r) for r in merkle.prove(merkle.build(rows, **options)).collect()]


def made(n, langs, seed=0):
    rng = random.Random(seed)
    rows = [
        (rng.choice([i, i, i, None, 3]), rng.choice(["src1", None]), rng.choice(langs),
         rng.choice([None, i, i]), rng.choice([None, "", "é💥\n" * 3, f"text {i}"]))
        for i in range(n)
    ]
    return rows + rows[:3] * 2


@pytest.mark.parametrize("n,langs,height", [
    (97, ["en"], 2), (140, ["en", "en", "en", "de", "é", None, "z"], 3), (60, [f"l{i}" for i in range(23)], 2), (1, ["x"], 13),
])
def test_equals_a_plain_construction(spark, n, langs, height):
    rows = made(n, langs) if n > 1 else [(5, None, "x", 4, "")]
    df = spark.createDataFrame([(*r, "?") for r in rows], "doc_id long, source string, lang string, n_chars int, text string, node string")
    got = found(df.repartition(5), height=height)
    assert sorted(got, key=repr) == sorted(by_hand(rows), key=repr)
    assert any(not r[-1] for r in got) == any(not r[-1] for r in by_hand(rows))


def test_a_repeated_key_is_spread(spark):
    """All rows alike but for a few: the ranges that number them stay about equal."""
    df = spark.range(4000).select(F.lit("g").alias("group"), F.lit(7).alias("key"), F.lit("n").alias("node"))
    placed, widths = merkle.numbered(df, "group", ["key", "node"])
    assert widths.collect()[0]["width"] == 4000
    assert sorted(r["index"] for r in placed.collect()) == list(range(4000))
    spread = df.withColumn("s", F.monotonically_increasing_id()).repartitionByRange(4, "group", "key", "node", "s")
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 2000


def test_missing_is_the_least_that_proofs_need():
    rng = random.Random(3)
    for _ in range(200):
        width = rng.randrange(1, 40)
        known = rng.sample(range(width), rng.randrange(0, width + 1))
        derived = {(0, i) for i in known}
        need, w, level = set(), width, 0
        while w > 1:
            here = {i for l, i in derived | need if l == level}
            ways = {i >> level for i in known}
            need |= {(level, i ^ 1) for i in ways if i ^ 1 < w and i ^ 1 not in here}
            derived |= {(level + 1, i >> 1) for i in ways}
            w, level = (w + 1) // 2, level + 1
        got = merkle.missing(np.array(known), width)
        assert len(got) == len(set(got)) and set(got) == need


def test_empty(spark, none):
    assert found(none.select("doc_id", F.lit("s").alias("source"), "lang", F.lit(1).alias("n_chars"), "text")) == []


def test_awkward_texts(awkward):
    df = awkward.select("doc_id", F.lit("s").alias("source"), "lang", F.lit(1).alias("n_chars"), "text")
    rows = [tuple(r) for r in df.collect()]
    assert sorted(found(df, height=2), key=repr) == sorted(by_hand(rows), key=repr)

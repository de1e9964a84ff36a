"""SimHash, I-Match, vantage-point trees."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyrank.llm import common, imatch, queries, simhash, vptree

# --- SimHash -----------------------------------------------------------------


def brute_fingerprint(text, k=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=2):
    """By id: the smallest id reachable."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(fps):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [least.get(root(i)) for i in range(len(fps))]


def test_fingerprints_equal_brute_force(awkward, monkeypatch):
    for block in (1 << 20, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        for r in awkward.collect():
            assert simhash.fingerprint_of(r["text"]) == brute_fingerprint(r["text"])


def near_family(rng, size):
    """Fingerprints around a few centres, many within reach of each other."""
    out = []
    for _ in range(size):
        centre = rng.choice([0, (1 << 64) - 1, 0x0123456789ABCDEF])
        for _ in range(rng.randint(0, 5)):
            centre ^= 1 << rng.randrange(64)
        out.append(centre)
    return out


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def check_components(spark, fps, radius=2):
    rows = [(i, signed(f)) for i, f in enumerate(fps)]
    marked = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.components(marked, radius).collect()}
    want = brute_components(list(enumerate(fps)), radius)
    assert [got[signed(f)] for f in fps] == want


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    check_components(spark, near_family(rng, 150) + [rng.getrandbits(64) for _ in range(50)])


def test_crowded_shards_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIMIT", 8)
    monkeypatch.setattr(simhash, "FEW", 3)
    check_components(spark, near_family(random.Random(6), 120))


def test_every_near_pair_shares_a_shard():
    rng = random.Random(7)
    for radius in (0, 1, 2, 3, 6):
        masks = simhash._finer(0, radius)
        for _ in range(200):
            flipped = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not flipped & m for m in masks)


def test_tree_search_equals_all_pairs():
    fps = np.unique(np.array(near_family(random.Random(8), 300), dtype=np.uint64))
    asked, node = simhash.Tree(fps).within(fps, 2)
    got = set(zip(asked.tolist(), node.tolist()))
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}
    assert got == want


def test_connected_on_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200)]
    got = {r["node"]: r["root"] for r in simhash.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[300] == got[200] == 200


def test_near_copies_of_awkward_rows(awkward):
    got = simhash.near_copies(awkward).collect()
    rows = awkward.select("doc_id", "text").collect()
    fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
    want = sorted(zip([k for k, _ in fps], [signed(f) for _, f in fps], brute_components(fps)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def test_one_of_each_group_stays(spark, awkward, none):
    base = " ".join(f"word{i}" for i in range(400))
    near = base.replace("word200", "other")
    far = " ".join(f"term{i}" for i in range(400))
    rows = [(10, base), (11, base), (12, near), (13, far), (13, far), (None, base), (14, None), (15, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"], r["text"]) for r in got.collect() if r["text"])
    assert (10, base) in kept and (13, far) in kept and len(kept) == len({t for _, t in kept})
    assert all(k is not None for k, _ in kept)
    assert simhash.one_of_each(none).count() == 0
    assert simhash.one_of_each(awkward).select("text").distinct().count() == simhash.one_of_each(awkward).count()


def test_unlike_texts_with_near_fingerprints_stay(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{c} " * 5 + c) for i, c in enumerate("abc")], "doc_id long, text string")
    # with a radius of all bits every document is in one group
    assert simhash.one_of_each(docs, radius=40).count() == 3


def test_simhash_query(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.REGISTRY["op3_simhash"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs]
    for (key, fp), component in zip(fps, brute_components(fps)):
        assert got[key]["fingerprint"] == f"{fp:016x}" and got[key]["component_id"] == component


# --- I-Match -----------------------------------------------------------------


def test_imatch_query(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.REGISTRY["op6_imatch"](spark, sf_dir).collect()}
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    by_text = {}
    for i, (key, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        row = got[key]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and row["n_chars"] == len(text)
        a, b = row["fingerprint"], got[docs[(i + 1) % len(docs)][0]]["fingerprint"]
        assert np.isclose(row["near_next"], brute_likeness(a, b))
        assert np.isclose(row["near_edited"], brute_likeness(a, row["edited_fingerprint"]))
        by_text.setdefault(text, set()).add(a)
    assert all(len(v) == 1 for v in by_text.values())


def brute_likeness(a, b):
    pairs = [(a[i:i + 8], b[i:i + 8]) for i in range(0, len(a), 8)]
    pairs = [p for p in pairs if p != ("-" * 8, "-" * 8)]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


def test_imatch_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, f"common w{i % 10} u{i}") for i in range(100)], "doc_id int, text string")
    lexicon = imatch.fit(docs, rare=0.05, common=0.5)
    held = {t for part in lexicon.table.first()["parts"] for t in part}
    want = {r[0] for r in spark.range(10).select(F.xxhash64(F.concat(F.lit("w"), F.col("id").cast("string")))).collect()}
    assert held == want


def test_imatch_terms_outside_all_subsets_still_tell_texts_apart(spark):
    docs = spark.createDataFrame([(i, f"w{i // 2} u{i}") for i in range(200)], "doc_id int, text string")
    lexicon = imatch.fit(docs)
    assert any(b == 0 for part in lexicon.table.first()["parts"] for b in part.values())
    own = [r["own"][0] for r in lexicon.fingerprints(docs, F.array("text"), "own").collect()]
    assert not any(set(f) == {imatch.NONE} for f in own)


def test_imatch_awkward_rows(awkward, none):
    lexicon = imatch.fit(awkward)
    got = imatch.against_next(awkward, lexicon, lambda t, n: F.concat(t, n), ranges=3).collect()
    assert len(got) == awkward.count()
    rows = sorted(awkward.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0), reverse=True)
    keys = [r["doc_id"] for r in rows]
    assert sorted(map(str, keys)) == sorted(str(r["doc_id"]) for r in got)
    long = next(r for r in got if r["doc_id"] == 7)
    assert long["edited"].endswith("12 34")  # document 6 follows 7
    assert next(r for r in got if r["doc_id"] == 4)["own"] == [imatch.NONE] * imatch.SUBSETS
    assert imatch.against_next(none, imatch.fit(none), lambda t, n: t).count() == 0


# --- vantage points ----------------------------------------------------------


def brute_nearest(rows, queries_, k=5):
    out = []
    usable = {}
    for key, v in rows:
        if key is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable[key] = min(usable.get(key, v), v)
    for q in sorted(usable):
        if not queries_(q):
            continue
        a = np.array(usable[q]) / np.abs(usable[q]).max()
        scored = []
        for key, v in usable.items():
            if key != q and len(v) == len(a):
                b = np.array(v) / np.abs(v).max()
                scored.append((float((a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum())), key))
        best = sorted(scored, key=lambda s: (-round(s[0], 12), s[1]))[:k]
        out += [(q, i + 1, key, s) for i, (s, key) in enumerate(best)]
    return out


def vectors(seed, n, d, clusters=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d)) * 3
    return [(i, (centres[i % clusters] + rng.normal(size=d)).tolist()) for i in range(n)]


def compare(spark, rows, shard, factor=1.0):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, rank string, size string")
    index = vptree.build(table, shard=shard)
    got = sorted(map(tuple, vptree.search(index, F.col("vec_id") % 10 == 0, factor=factor).collect()))
    return got, brute_nearest(rows, lambda i: i % 10 == 0)


def test_exact_search_equals_brute_force(spark):
    rows = vectors(1, 400, 8)
    rows += [(1000 + i, rows[20][1]) for i in range(7)]  # ties: equal vectors
    rows += [(2000, None), (2010, [0.0] * 8), (2020, [float("nan")] * 8), (2030, [1.0, None] + [0.0] * 6), (2040, []),
             (2050, [float("inf")] * 8), (None, [1.0] * 8), (2060, [1.0, 2.0]), (2061, [2.0, 1.0]), (30, rows[30][1]),
             (2070, [1e200] * 8), (2071, [1e-200] * 8)]
    got, want = compare(spark, rows, shard=50)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_hundreds_of_equal_vectors_are_all_candidates():
    for seed in range(20):
        units = vptree._unit(np.repeat(np.random.default_rng(seed).normal(size=(1, 64)), 300, axis=0))
        for asked in (1, 2, 7):
            tree = vptree.Tree(units)
            search = vptree.Nearest(tree, units[:asked], np.arange(asked), np.full(asked, np.inf), 5, 1.0)
            search.walk(tree.root, np.arange(asked))
            assert len(search.pairs()[0]) == asked * (len(units) - 1)


def test_relaxed_search_keeps_recall(spark):
    got, want = compare(spark, vectors(2, 600, 16), shard=100, factor=0.8)
    found = {g[:1] + g[2:3] for g in got}
    assert sum((w[0], w[2]) in found for w in want) / len(want) >= 0.9


def test_pruning_looks_at_few_vectors():
    units = vptree._unit(np.random.default_rng(3).normal(size=(5000, 3)))
    tree, looked = vptree.Tree(units), []
    search = vptree.Nearest(tree, units[:20], np.arange(20), np.full(20, np.inf), 5, 1.0)
    look = search._look
    search._look = lambda places, asked: (looked.append(len(places) * len(asked)), look(places, asked))
    search.walk(tree.root, np.arange(20))
    assert sum(looked) < 0.25 * 20 * len(units)


def test_search_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vptree.search(vptree.build(empty), F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = vptree.search(vptree.build(two), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0.0)]


# --- near copies -------------------------------------------------------------


def brute_one_of_each(rows, words=5, similarity=0.8):
    """Keys that stay: the smallest of each group that all pairs of alike texts join."""
    def shingles(text):
        own = text.lower().split()
        return {tuple(own[i:i + words]) for i in range(len(own) - words + 1)} or {tuple(own)}

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(key, least.get(root(i), key))
    return set(least.values())


def variants(seed, n, size=300, edits=6):
    """Variants of a text, and the text itself with the largest key."""
    rng = random.Random(seed)
    source = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    rows = []
    for i in range(n):
        words = list(source)
        for at in rng.sample(range(size), edits):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((seed * 1000 + i, " ".join(words)))
    return [*rows, (seed * 1000 + n, " ".join(source))]


def test_variants_whose_source_comes_last_are_one_group(spark):
    rows = variants(1, 40) + variants(2, 40, edits=9) + variants(3, 20, edits=20) + variants(4, 10, size=12, edits=1)
    kept = brute_one_of_each(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == kept
    assert 1000 in kept and not kept & set(range(1001, 1041))


def test_alike_texts_with_far_fingerprints_are_found(spark):
    rows = variants(5, 1, size=60, edits=1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # no fingerprint proposes a pair: only equal ones are in a group
    assert [r["doc_id"] for r in simhash.one_of_each(docs, radius=0).collect()] == [5000]


def test_one_of_each_equals_all_pairs(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "COMMON", 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 0").limit(400)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(table).collect()} == brute_one_of_each(rows)


def test_small_batches_hold_for_the_work_alone(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    @common.small_batches
    def work(df, fails):
        assert int(df.sparkSession.conf.get(name)) <= common.BATCH
        return 1 // (1 - fails)

    assert work(spark.range(1), 0) == 1
    with pytest.raises(ZeroDivisionError):
        work(spark.range(1), 1)
    assert spark.conf.get(name) == before

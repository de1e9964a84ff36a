"""The stages of the pipeline on the smallest tables."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tallyrank.llm import common, packing
from tallyrank.llm.queries import vocabulary
from tallyrank.session import scratch_path


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """What each stage was given and has kept."""
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        found[name] = (docs, out)
        docs = out
    return found


def test_columns_stay(steps):
    for name, (before, after) in list(steps.items())[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes, name


def test_clean_documents_stay_through_language_id(steps):
    before, after = steps["language_id"]
    assert before.where(F.col("text").rlike(r"\p{L}{3}")).join(after, "doc_id", "left_anti").count() == 0


def test_toxic_documents_go(steps, spark, sf_dir):
    before, after = steps["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = before.join(labels.where("toxic = 0"), "doc_id")
    assert clean.join(after, "doc_id", "left_anti").count() <= 0.05 * clean.count()


def test_most_toxic_documents_go(spark):
    """With as many labels as a lexicon needs; the smallest tables have eleven toxic ones."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = pipeline.without_toxic(spark, docs, sf).select("doc_id").withColumn("kept", F.lit(1))
    stays = F.avg(F.coalesce("kept", F.lit(0))).alias("s")
    rows = docs.join(labels, "doc_id").join(kept, "doc_id", "left").groupBy("toxic").agg(stays).collect()
    rate = {r["toxic"]: r["s"] for r in rows}
    assert rate[1] <= 0.15 and rate[0] >= 0.97


def test_copies_go_and_all_else_stays(steps):
    before, after = steps["simhash"]
    rows = before.select("doc_id", "text").collect()
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    assert kept <= set(first.values())

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    texts = {r["doc_id"]: r["text"] for r in rows}
    for gone in set(first.values()) - kept:
        own = shingles(texts[gone])
        best = max(len(own & s) / len(own | s) for s in (shingles(texts[k]) for k in kept))
        assert best >= 0.8


def test_one_of_each_group_of_near_copies_stays(steps):
    """The smallest id of each group that pairs of 0.8 join, counted over all pairs."""
    before, after = steps["simhash"]
    sets = {}
    for r in before.select("doc_id", "text").collect():
        words = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        small, large = sorted((len(sets[i]), len(sets[j])))
        if small >= 0.8 * large:
            shared = len(sets[i] & sets[j])
            if shared >= 0.8 * (small + large - shared) - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == {root(i) for i in sets}


def test_secrets_are_masked(steps):
    before, after = steps["secrets"]
    assert after.count() == before.count()
    found = re.compile(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}")
    for r in after.collect():
        assert not found.search(r["text"]) and r["n_chars"] == len(r["text"])


def test_every_document_is_packed(steps):
    before, after = steps["packing"]
    whole = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("total"))
    assert whole.where("n != total").count() == 0 and whole.count() == before.count()


def test_stages_take_rows_that_are_awkward_or_missing(spark, awkward, sf_dir):
    docs = awkward.select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")
    )
    for table in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES[:-1]:
            assert stage(spark, table, sf_dir).columns == docs.columns
            assert stage(spark, table, sf_dir).count() <= table.count()
        assert (pipeline.STAGES[-1][1](spark, table, sf_dir).count() > 0) == (table is docs)


def test_run_is_the_stages_in_order(spark, sf_dir, steps):
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = sorted(map(tuple, pipeline.run(spark, sf_dir).select(*order).collect()))
    assert got == sorted(map(tuple, steps["packing"][1].select(*order).collect()))


def test_rows_of_every_stage_are_written_in_small_batches(spark, sf_dir):
    """They are written after the stage's function has returned, so that the session's settings count."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.parquet.columnarReaderBatchSize": "4096"}
    before = {n: spark.conf.get(n) for n in names}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    try:
        for name, stage in pipeline.STAGES:
            for n, v in names.items():
                spark.conf.set(n, v)
            stage(spark, docs, sf_dir)
            assert [int(spark.conf.get(n)) for n in names] == [common.BATCH, common.READ], name
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_a_worker_lets_go_of_another_stages_vocabulary():
    packing.load(vocabulary("byte_bpe_50k.json"))
    common.works_for("packing")
    assert packing.load.cache_info().currsize == 1
    common.works_for("simhash")
    assert packing.load.cache_info().currsize == 0


def test_the_tokenizer_is_read_only_where_the_merger_cannot_do():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    encoder, own = packing.Encoder(path), Tokenizer.from_file(path)
    special = encoder.special[0] if encoder.special else ""
    for text, read in (("plain words  and more\n", False), (f"one {special} two", bool(special))):
        want = own.encode(text, add_special_tokens=False).ids
        assert list(memoryview(encoder.encode([text])[0]).cast("I")) == want
        assert ("tokenizer" in vars(encoder)) == read

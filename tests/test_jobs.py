"""The whole way from CSV files to answered requests."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tallyrank import jobs
from tallyrank.catalog import fixtures as fx
from tallyrank.functions.scalars import known
from tallyrank.ml import search, stack
from tallyrank.sources import tables


@pytest.fixture(scope="module")
def files(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    items, lines = fx.items(spark, sf_dir), fx.lines(spark, sf_dir)
    csv = {"header": True, "quote": '"', "escape": '"'}
    items.select(
        "title", F.col("id"), F.col("air_date").alias("original_air_date"), F.lit("x1").alias("production_code"),
        "season", "number_in_season",
        F.when(F.col("id") % 23 != 0, F.col("id")).cast("int").alias("number_in_series"), F.col("viewers").alias("us_viewers_in_millions"),
        F.col("rating").alias("imdb_rating"), F.lit(5).alias("imdb_votes"),
        F.col("image").alias("image_url"), F.col("link").alias("video_url"),
    ).write.options(**csv).csv(str(root / "items"))
    lines.select(
        F.col("item_id").alias("episode_id"),
        F.when(F.col("words") > 140, "sing, for president").otherwise(F.col("txt")).alias("raw_text"),
        F.initcap(F.col("speaking").cast("string")).alias("speaking_line"),
        F.col("place_id").alias("location_id"), F.col("who").alias("raw_character_text"),
        F.col("place").alias("raw_location_text"), F.col("words").alias("word_count"),
    ).write.options(**csv).csv(str(root / "lines"))
    (root / "names.csv").write_text("character\nred,\nblue,\n")
    (root / "places.csv").write_text("name\nNATION_1,\nNATION_2,\n")
    return root


def test_files_read_as_tables(spark, sf_dir, files):
    items, lines = jobs.load(spark, str(files / "items"), str(files / "lines"))
    want = fx.items(spark, sf_dir).agg(F.count(known("rating")), F.sum("id"), F.count("air_date")).first()
    got = items.agg(F.count("imdb_rating"), F.sum("id"), F.count("original_air_date")).first()
    assert tuple(got) == tuple(want)
    want = fx.lines(spark, sf_dir).agg(F.count("*"), F.count("speaking"), F.count("place_id")).first()
    got = lines.agg(F.count("*"), F.count("speaking_line"), F.count("location_id")).first()
    assert tuple(got) == tuple(want)
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(files / "items"), "nope string", by_name=True)


def test_train_precompute_answer(spark, files, tmp_path):
    paths = {"items": str(files / "items"), "lines": str(files / "lines"), "group_term": "red"}
    model, store = str(tmp_path / "model"), str(tmp_path / "store")
    first, second = stack.first_stage(), stack.second_stage()
    errors = jobs.train(
        spark, **paths, model=model, draws=1, folds=2, max_rounds=1,
        first_params={"maxIter": 2}, second_params={"maxIter": 2},
        first_space={first.maxIter: search.Between(2, 4)}, second_space={second.maxIter: search.Between(2, 4)},
    )
    assert {(r.stage, r.split) for r in errors.collect()} == {
        (stage, split) for stage in ("first", "second") for split in ("train", "test")
    }
    jobs.precompute(
        spark, **paths, names=str(files / "names.csv"), places=str(files / "places.csv"),
        model=model, store=store, default={**jobs.EMPTY_RECORD, "title": "none"},
    )
    records = tables.read_store(spark, store)
    assert records.count() == 2 * 2 * 2 * 2 * 2
    found = records.where("title <> 'none'")
    assert found.count() > 0 and found.where("predicted is null or rating is null").count() == 0
    asked = spark.createDataFrame(
        [("red", "NATION_1", "Location", "True", "False"), ("red", "nowhere", "Location", "True", "False")],
        jobs.REQUEST_COLUMNS,
    )
    asked.write.parquet(str(tmp_path / "requests"))
    jobs.main([
        "answer", "--requests", str(tmp_path / "requests"), "--store", store,
        "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "state"), "--default",
        '{"title": "nothing", "predicted": 0, "rating": 0, "image": "", "link": ""}',
    ])
    answers = {r.place: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    stored = records.where(
        "name = 'red' and place = 'NATION_1' and priority = 'Location' and song and not politics"
    ).first()
    assert answers["NATION_1"].title == stored.title and answers["NATION_1"].song is True
    assert answers["nowhere"].title == "nothing"


def test_commands_start_as_documented():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for command in ([sys.executable, "tallyrank_job.py"], [sys.executable, "-m", "tallyrank.jobs"]):
        shown = subprocess.run([*command, "--help"], cwd=root, capture_output=True, text=True, timeout=120)
        assert shown.returncode == 0 and "{train,score,precompute,answer,compare}" in shown.stdout


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "large.csv"
    path.write_text("id,txt\n" + "".join(f"{i},text number {i}\n" for i in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        table = tables.read_csv(spark, str(path), "id long, txt string")
        assert table.rdd.getNumPartitions() > 4 and table.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,txt\n1,x\n")
    (tmp_path / "b.csv").write_text("txt,id\ny,2\n")
    with pytest.raises(ValueError, match="different headers"):
        tables.read_csv(spark, str(tmp_path), "id long, txt string", by_name=True)


def test_a_store_is_read_whole_while_it_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "store")
    tables.write_store(spark.range(3).toDF("k"), path)
    before = tables.read_store(spark, path)
    tables.write_store(spark.range(5).toDF("k"), path)
    assert before.count() == 3 and tables.read_store(spark, path).count() == 5

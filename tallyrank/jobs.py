"""Jobs for ``spark-submit``: train, score, precompute, answer, compare.

    spark-submit tallyrank_job.py train --items items.csv --lines lines.csv --group-term Smith --model out/model

``python -m tallyrank.jobs train …`` starts the same on one machine.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank import spec as defaults
from tallyrank.ml import compare, stack
from tallyrank.plans import choices, features
from tallyrank.plans.features import model_table
from tallyrank.session import clear_scratch, write_through
from tallyrank.sources import tables
from tallyrank.spec import ItemSpec, LineSpec, Terms
from tallyrank.streaming import requests as streaming

# The columns of the two source files.
ITEM_COLUMNS = (
    "id bigint, title string, original_air_date string, season int, number_in_season int, "
    "number_in_series int, "
    "us_viewers_in_millions double, imdb_rating double, image_url string, video_url string"
)
LINE_COLUMNS = (
    "episode_id bigint, raw_text string, speaking_line boolean, location_id bigint, "
    "raw_character_text string, raw_location_text string, word_count double"
)
ITEMS = ItemSpec(
    aired="original_air_date", views="us_viewers_in_millions", rating="imdb_rating",
    image="image_url", link="video_url", series="number_in_series",
)
LINES = LineSpec(
    key="episode_id", name="raw_character_text", place="raw_location_text", place_key="location_id",
    text="raw_text", speaking="speaking_line", words="word_count",
)
REQUEST_COLUMNS = "name string, place string, priority string, song string, politics string"
EMPTY_RECORD = {"title": "", "predicted": 0.0, "rating": 0.0, "image": "", "link": ""}


def load(spark: SparkSession, items: str, lines: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both source files; the lines leniently, as they quote inconsistently.

    ``multi_line`` is for files with line breaks in quoted fields; each is then one task.
    """
    return (
        tables.read_csv(spark, items, ITEM_COLUMNS, by_name=True, multi_line=multi_line),
        tables.read_csv(spark, lines, LINE_COLUMNS, by_name=True, lenient=True, multi_line=multi_line),
    )


def training_table(items: DataFrame, lines: DataFrame, group_term: str) -> DataFrame:
    """The imputed feature table, written once for the many passes of training."""
    cleaned = features.clean_items(items, ITEMS)
    return write_through(
        model_table(features.item_features(cleaned, lines, group_term, LINES)), "model-table"
    )


def train(
    spark, items: str, lines: str, group_term: str, model: str, multi_line: bool = False, **options
) -> DataFrame:
    """Trains the stack, saves it and returns the errors of both stages."""
    result = stack.train_stack(training_table(*load(spark, items, lines, multi_line), group_term), **options)
    stack.save_model(result.model, model)
    return stack.error_rows(spark, result.errors)


def scored(item_table: DataFrame, line_table: DataFrame, group_term: str, model: str) -> DataFrame:
    """All items with their predicted rating and the columns to display."""
    table = training_table(item_table, line_table, group_term)
    return stack.batch_score(stack.load_model(model), table, item_table.select("id", "title"))


def score(
    spark, items: str, lines: str, group_term: str, model: str, out: str, multi_line: bool = False
) -> None:
    """Writes all items with their predicted rating and the columns to display."""
    scored(*load(spark, items, lines, multi_line), group_term, model).write.mode("errorifexists").parquet(out)


def precompute(
    spark, items: str, lines: str, names: str, places: str, group_term: str, model: str, store: str,
    default: dict | None = None, multi_line: bool = False,
) -> None:
    """Writes the record of every preference combination, for lists of names and places of any length."""
    item_table, line_table = load(spark, items, lines, multi_line)
    terms = Terms((), (), defaults.SONG_TEXT_TERMS, defaults.SONG_NAME_TERMS, defaults.CIVIC_TOPIC_TERMS)
    predictions = scored(item_table, line_table, group_term, model).select("id", "predicted")
    records = choices.recommend_choices(
        item_table, line_table, *[tables.read_lookup(spark, path, "value") for path in (names, places)],
        terms, default or EMPTY_RECORD, predictions=predictions, item_spec=ITEMS, line_spec=LINES,
    )
    tables.write_store(records, store, partition_by="priority")


def answer(spark, requests: str, store: str, out: str, checkpoint: str, default: dict | None = None) -> None:
    """Answers the request files that arrived since the last run."""
    records = tables.read_store(spark, store)
    stream = streaming.read_requests(spark, requests, REQUEST_COLUMNS)
    streaming.answer_requests(
        stream, records, default or EMPTY_RECORD, out, checkpoint
    ).awaitTermination()


def comparison(
    spark, items: str, lines: str, group_term: str, model: str, multi_line: bool = False, **options
) -> DataFrame:
    """Train and test error of all models."""
    table = training_table(*load(spark, items, lines, multi_line), group_term)
    return compare.compare_models(table, stack.load_model(model), **options)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallyrank.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *arguments: str) -> None:
        sub = jobs.add_parser(name)
        for argument in arguments:
            sub.add_argument(f"--{argument}", required=True)
        if name in ("precompute", "answer"):
            sub.add_argument("--default", type=json.loads, help="default record as JSON")
        if "items" in arguments:
            sub.add_argument("--multi-line", action="store_true", help="quoted fields span lines")

    job("train", "items", "lines", "group-term", "model")
    job("score", "items", "lines", "group-term", "model", "out")
    job("precompute", "items", "lines", "names", "places", "group-term", "model", "store")
    job("answer", "requests", "store", "out", "checkpoint")
    job("compare", "items", "lines", "group-term", "model")
    arguments = vars(parser.parse_args(argv))
    run = {"train": train, "score": score, "precompute": precompute, "answer": answer, "compare": comparison}
    spark = SparkSession.builder.getOrCreate()
    try:
        result = run[arguments.pop("job")](spark, **arguments)
        if result is not None:
            result.orderBy(*[F.col(c) for c in result.columns[:2]]).show(truncate=False)
    finally:
        clear_scratch(spark)


if __name__ == "__main__":
    main()

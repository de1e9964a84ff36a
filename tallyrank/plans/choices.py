"""Recommendations for any number of names and places.

Choices are rows, not columns of a plan: (item, choice, matched lines) holds only what matches, found by
bringing texts and choices together by leading characters. What does not match needs no row of its
own either. In the first cut an item without a matching name can only be among the best of its place,
so the ``CUTS[0]`` best items of every place stand in for all of these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.functions.text import odds
from tallyrank.operators.rank import cascade, topk
from tallyrank.plans.recommend import (
    KEYS, complete_items, enrich, held_choices, line_scores, ranking_stages, with_default,
)
from tallyrank.session import write_through
from tallyrank.spec import CUTS, PRIORITIES, ItemSpec, LineSpec, Terms


def term_counts(lines: DataFrame, key: str, column: str, choices: DataFrame, value: str = "value") -> DataFrame:
    """(id, value, matched): how many lines of an item hold a choice, where any do.

    The distinct texts that hold a choice are written first: by their size as files Spark tells whether
    they can be sent to the lines, so that of these only what matches is shuffled.
    """
    texts = lines.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.lower(column).alias("_text"))
    texts = texts.where("_text is not null")
    held = write_through(held_choices(texts.select("_text").distinct(), choices, value), "held-choices")
    return texts.join(held, "_text").groupBy("id", "value").agg(F.count(F.lit(1)).alias("matched"))


def _at_least_floor(rows: DataFrame, by: str, value: str, cut: int) -> DataFrame:
    """Rows whose value the ``cut``-th best of their group does not exceed."""
    best = topk(rows, [value], cut, by=[by])
    floors = best.groupBy(by).agg(F.when(F.count(F.lit(1)) >= cut, F.min(value)).alias("_floor"))
    return rows.join(floors, by).where(F.col("_floor").isNull() | (F.col(value) >= F.col("_floor"))).drop("_floor")


def candidates(
    base: DataFrame, named: DataFrame, placed: DataFrame, names: DataFrame, places: DataFrame, cut: int,
) -> DataFrame:
    """One row per item and (name, place, priority) that may survive the first cut.

    ``named`` and ``placed`` hold (id, name, name_odds) and (id, place, place_odds) of what matches.
    """
    best = topk(placed, ["place_odds"], cut, by=["place"])
    # the best of each place that do not match the name
    fillers = best.crossJoin(names).join(named.select("id", "name"), ["id", "name"], "left_anti").select(
        "id", "name", "place", F.lit(0.0).alias("name_odds"), "place_odds"
    )
    # a name leads: all places, where the item matches none they fall after the cut but take part in it
    leading = _at_least_floor(named, "name", "name_odds", cut).crossJoin(places).join(placed, ["id", "place"], "left")
    leading = leading.select("id", "name", "place", "name_odds", F.coalesce("place_odds", F.lit(0.0)).alias("place_odds"))
    # a place leads: items that match both
    both = _at_least_floor(placed, "place", "place_odds", cut).join(named, "id").select(
        "id", "name", "place", "name_odds", "place_odds"
    )

    def led(rows: DataFrame, priority: str, first: str, second: str) -> DataFrame:
        return rows.withColumns({
            "priority": F.lit(priority), "primary_odds": F.col(first), "secondary_odds": F.col(second),
        })

    by_name = led(leading.unionByName(fillers), PRIORITIES[0], "name_odds", "place_odds")
    by_place = led(both.unionByName(fillers), PRIORITIES[1], "place_odds", "name_odds")
    return by_name.unionByName(by_place).join(base, "id")


def _distinct(choices: DataFrame, value: str, name: str) -> DataFrame:
    return choices.select(F.col(value).alias(name)).where(F.col(name).isNotNull()).distinct()


def recommend_choices(
    items: DataFrame, lines: DataFrame, names: DataFrame, places: DataFrame, terms: Terms, default: dict, *,
    predictions: DataFrame | None = None, cuts: Sequence[int] = CUTS, value: str = "value",
    item_spec: ItemSpec = ItemSpec(), line_spec: LineSpec = LineSpec(),
) -> DataFrame:
    """The whole recommendation table with names and places as tables of any length.

    Of ``terms`` only the lists of songs and topics are used. Written in between: names and places of the
    lines, which are read four times, texts that hold a choice, scored items, odds and winners.
    """
    fixed = Terms((), (), terms.song_text, terms.song_name, terms.topic)
    totals = line_scores(lines, fixed, line_spec).drop("matched_names", "matched_places")
    base = write_through(complete_items(items, item_spec).select(
        F.col(item_spec.key).alias("id"), F.col(item_spec.rating).alias("rating")
    ).join(totals, "id").select(
        "id", "rating", "n_lines", F.col("song").alias("song_score"), F.col("topic").alias("topic_score")
    ), "scored-items")

    narrow = write_through(lines.select(line_spec.key, line_spec.name, line_spec.place), "line-names")

    def matched(column: str, choices: DataFrame, name: str) -> DataFrame:
        counts = term_counts(narrow, line_spec.key, column, choices, value).join(base.select("id", "n_lines"), "id")
        ratio: Column = odds(F.col("matched"), F.col("n_lines") - F.col("matched"))
        return write_through(counts.select("id", F.col("value").alias(name), ratio.alias(f"{name}_odds")), f"{name}-odds")

    every_name, every_place = _distinct(names, value, "name"), _distinct(places, value, "place")
    rows = candidates(
        base, matched(line_spec.name, names, "name"), matched(line_spec.place, places, "place"),
        every_name, every_place, cuts[0],
    )
    found = cascade(rows, ranking_stages(fixed, cuts), by=KEYS[:3])
    records = enrich(found, items, predictions, item_spec)
    grid = every_name.crossJoin(every_place)
    for name, values in (("priority", PRIORITIES), ("song", (True, False)), ("politics", (True, False))):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return with_default(grid, records, KEYS, default)

"""Preference scores per item, the ranking cascade and the recommendation table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.functions.scalars import parse_flag
from tallyrank.functions.text import contains_flag, keyword_score, normalise, odds, song_flags
from tallyrank.operators.impute import dropna_any
from tallyrank.operators.rank import cascade, kth_floor
from tallyrank.plans.features import DEALT, ROWS
from tallyrank.session import partition_count, write_through
from tallyrank.spec import CUTS, PRIORITIES, ItemSpec, LineSpec, Stage, Terms

KEYS = ("name", "place", "priority", "song", "politics")
#: Leading characters by which texts and choices are brought together.
PART = 4


def line_scores(lines: DataFrame, terms: Terms, spec: LineSpec = LineSpec()) -> DataFrame:
    """Every score of every item from one scan and one grouping of the lines.

    ``matched_names`` and ``matched_places`` count matching rows per term in list
    order, ``n_lines`` all rows; ``song`` and ``topic`` are the summed scores.
    Complements and negated scores follow from ``n_lines``.
    """
    lowered = lines.select(
        F.col(spec.key).alias("id"),
        F.lower(spec.name).alias("_name"), F.lower(spec.place).alias("_place"),
        F.lower(spec.text).alias("_text"),
    ).where("id is not null")
    flagged = lowered.select(
        "id",
        *[_flag("_name", t).alias(f"_n{i}") for i, t in enumerate(terms.names)],
        *[_flag("_place", t).alias(f"_p{i}") for i, t in enumerate(terms.places)],
        song_flags(
            "_text", "_name", [normalise(t) for t in terms.song_text],
            [normalise(t) for t in terms.song_name], case_sensitive=True,
        ).alias("_song"),
        keyword_score("_text", [normalise(t) for t in terms.topic], case_sensitive=True).alias("_topic"),
    )
    sums = flagged.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(terms.names))],
        *[F.sum(f"_p{i}").alias(f"_p{i}") for i in range(len(terms.places))],
        F.sum("_song").alias("song"),
        F.sum("_topic").alias("topic"),
    )
    return sums.select(
        "id", "n_lines",
        F.array(*[f"_n{i}" for i in range(len(terms.names))]).alias("matched_names"),
        F.array(*[f"_p{i}" for i in range(len(terms.places))]).alias("matched_places"),
        "song", "topic",
    )


def _flag(lowered: str, term: str) -> Column:
    """The flag of a term on a column that is in lower case already."""
    return contains_flag(lowered, normalise(term), case_sensitive=True)


def match_odds(
    lines: DataFrame, key: str, column: str, wanted: Sequence[str], *, rows: int = ROWS
) -> DataFrame:
    """Matched rows, other rows and their odds per group and term, all terms in one scan.

    About ``rows`` lines come to a partition; those of one group are dealt out before they are summed.
    """
    flagged = lines.where(F.col(key).isNotNull()).select(
        key, F.lower(column).alias("_c"), (F.spark_partition_id() % DEALT).alias("_from")
    )
    parts = partition_count(lines, rows)
    flags = [_flag("_c", t).alias(f"_t{i}") for i, t in enumerate(wanted)]
    counted = flagged.select(key, "_from", *flags).repartition(parts, key, "_from").groupBy(key, "_from").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_t{i}").alias(f"_t{i}") for i in range(len(wanted))]
    )
    sums = counted.repartition(parts, key).groupBy(key).agg(
        *[F.sum(c).alias(c) for c in ("_n", *[f"_t{i}" for i in range(len(wanted))])]
    )
    rows = F.array(*[
        F.struct(F.lit(t).alias("term"), F.col(f"_t{i}").alias("matched")) for i, t in enumerate(wanted)
    ])
    unmatched = F.col("_n") - F.col("matched")
    return sums.select(key, "_n", F.inline(rows)).select(
        key, "term", "matched", unmatched.alias("unmatched"),
        odds(F.col("matched"), unmatched).alias("odds"),
    )


def negated(score: Column, top: int, n_lines: Column) -> Column:
    """Summed distance from the top score over all lines of the item."""
    return top * n_lines - score


def preference_grid(
    source: DataFrame, names: Sequence[str], places: Sequence[str],
    priorities: Sequence[str] = PRIORITIES,
) -> DataFrame:
    """Every combination of preference values, once per row of ``source``."""
    grid = source
    for column, values in (
        ("name", names), ("place", places), ("priority", priorities),
        ("song", (True, False)), ("politics", (True, False)),
    ):
        grid = grid.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def complete_items(items: DataFrame, spec: ItemSpec = ItemSpec()) -> DataFrame:
    """Items without a missing value in any column but the view counts."""
    return dropna_any(items.drop(spec.views))


def ranking_stages(terms: Terms, cuts: Sequence[int] = CUTS, top: int = 1) -> list[Stage]:
    """The four stages of a recommendation.

    The first ranks by name and place odds in the order the priority asks for;
    song and topic preference only come in for its survivors.
    """
    song = "if(song, song_score, 2 * n_lines - song_score)"
    topic = f"if(politics, topic_score, {len(terms.topic)} * n_lines - topic_score)"
    return [
        Stage(("primary_odds", "secondary_odds"), cuts[0], keep="place_odds != 0"),
        Stage((song,), cuts[1], keep="name_odds != 0", expand=("song", (True, False))),
        Stage((topic,), cuts[2], expand=("politics", (True, False))),
        Stage(("rating",), top),
    ]


def scored_items(items: DataFrame, scores: DataFrame, spec: ItemSpec = ItemSpec()) -> DataFrame:
    """Complete items with their rating and scores."""
    return complete_items(items, spec).select(
        F.col(spec.key).alias("id"), F.col(spec.rating).alias("rating")
    ).join(scores, "id")


def ranked_items(scored: DataFrame, terms: Terms) -> DataFrame:
    """Scored items with the odds of every name and place."""
    return scored.select(
        "id", "rating", "n_lines",
        F.col("song").alias("song_score"), F.col("topic").alias("topic_score"),
        _odds_rows(terms.names, "matched_names").alias("name_rows"),
        _odds_rows(terms.places, "matched_places").alias("place_rows"),
    )


def _odds_rows(wanted: Sequence[str], matched: str) -> Column:
    return F.array(*[
        F.struct(
            F.lit(t).alias("term"),
            odds(F.col(matched)[i], F.col("n_lines") - F.col(matched)[i]).alias("odds"),
        )
        for i, t in enumerate(wanted)
    ])


def odds_floors(ranked: DataFrame, terms: Terms, cut: int) -> dict[str, float | None]:
    """Per name and place, odds that at least ``cut`` items reach: one number each."""
    values = {
        _floor_name(rows, i): F.col(rows)[i]["odds"]
        for rows, wanted in (("name_rows", terms.names), ("place_rows", terms.places))
        for i in range(len(wanted))
    }
    return kth_floor(ranked, values, cut, "id").first()["floor"].asDict()


def _floor_name(rows: str, i: int) -> str:
    return f"{rows}_{i}"


def candidate_rows(
    ranked: DataFrame, terms: Terms, priorities: Sequence[str] = PRIORITIES,
    floors: dict[str, float | None] | None = None,
) -> DataFrame:
    """One row per item and (name, place, priority) that may survive the first cut.

    The cut takes the best items by the leading odds, so an item below a floor
    that enough items reach cannot survive and is not spread over the second
    dimension. When the place leads, items without a matching place sort last
    and fall right after the cut; they are left out at once.
    """
    leads = []
    for priority in priorities:
        name_leads = priority == PRIORITIES[0]
        rows, wanted = ("name_rows", terms.names) if name_leads else ("place_rows", terms.places)
        for i, term in enumerate(wanted):
            value = F.col(rows)[i]["odds"]
            usable = F.lit(True) if name_leads else value > 0
            floor = (floors or {}).get(_floor_name(rows, i))
            if floor is not None:
                usable = usable & (value >= floor)
            leads.append(F.when(usable, F.struct(
                F.lit(priority).alias("priority"), F.lit(term).alias("lead"), value.alias("primary_odds")
            )))
    name_first = F.col("priority") == PRIORITIES[0]
    base = ["id", "rating", "n_lines", "song_score", "topic_score"]
    spread = (
        ranked.select(*base, "name_rows", "place_rows", F.inline(F.array_compact(F.array(*leads))))
        .select(
            *base, "priority", "lead", "primary_odds",
            F.inline(F.when(name_first, F.col("place_rows")).otherwise(F.col("name_rows"))),
        )
        .withColumnRenamed("odds", "secondary_odds")
    )
    return spread.select(
        *base, "priority", "primary_odds", "secondary_odds",
        F.when(name_first, F.col("lead")).otherwise(F.col("term")).alias("name"),
        F.when(name_first, F.col("term")).otherwise(F.col("lead")).alias("place"),
        F.when(name_first, F.col("primary_odds")).otherwise(F.col("secondary_odds")).alias("name_odds"),
        F.when(name_first, F.col("secondary_odds")).otherwise(F.col("primary_odds")).alias("place_odds"),
    )


def winners(
    items: DataFrame, scores: DataFrame, terms: Terms,
    cuts: Sequence[int] = CUTS, top: int = 1, spec: ItemSpec = ItemSpec(),
) -> DataFrame:
    """The best item(s) for every preference combination that has one.

    The scored items are written once: they are read twice, first for the floors
    of the cut and then for the ranking, and the lines are to be scanned once.
    """
    ranked = ranked_items(write_through(scored_items(items, scores, spec), "scored-items"), terms)
    candidates = candidate_rows(ranked, terms, floors=odds_floors(ranked, terms, cuts[0]))
    return cascade(candidates, ranking_stages(terms, cuts, top), by=KEYS[:3])


def enrich(
    found: DataFrame, items: DataFrame, predictions: DataFrame | None = None, spec: ItemSpec = ItemSpec()
) -> DataFrame:
    """Adds title, rating and urls (and the predicted rating) to the winning ids.

    The winners are written first: by their size as files Spark tells whether to
    send them to the item table or to shuffle both.
    """
    display = items.select(F.col(spec.key).alias("id"), *[
        F.col(c).alias(a) for c, a in zip(spec.display(), ("title", "rating", "image", "link"))
    ])
    keyed = found.select("id", *[c for c in KEYS if c in found.columns])
    keyed = write_through(keyed, "winners")
    result = display.join(keyed, "id")
    if predictions is not None:
        wanted = predictions.select("id", "predicted").join(keyed.select("id").distinct(), "id", "left_semi")
        result = result.join(wanted, "id", "left")
    return result


def with_default(keys: DataFrame, found: DataFrame, on: Sequence[str], default: dict) -> DataFrame:
    """Every key with its record, or the default record where there is none."""
    joined = keys.join(found.withColumn("_hit", F.lit(True)), list(on), "left")
    filled = {
        c: F.when(F.col("_hit"), F.col(c)).otherwise(F.lit(v).cast(found.schema[c].dataType))
        for c, v in default.items()
    }
    return joined.withColumns(filled).drop("_hit")


def recommend_all(
    spark, items: DataFrame, lines: DataFrame, terms: Terms, default: dict, *,
    predictions: DataFrame | None = None, cuts: Sequence[int] = CUTS,
    item_spec: ItemSpec = ItemSpec(), line_spec: LineSpec = LineSpec(),
) -> DataFrame:
    """The whole recommendation table: one record per preference combination, in one job."""
    found = winners(items, line_scores(lines, terms, line_spec), terms, cuts, spec=item_spec)
    records = enrich(found, items, predictions, item_spec)
    grid = preference_grid(spark.range(1), terms.names, terms.places).drop("id")
    return with_default(grid, records, KEYS, default)


def recommend_one(
    items: DataFrame, lines: DataFrame, terms: Terms, preference: dict, *,
    cuts: Sequence[int] = CUTS, top: int = 1,
    item_spec: ItemSpec = ItemSpec(), line_spec: LineSpec = LineSpec(),
) -> DataFrame:
    """The best item(s) for one preference, in a single pass.

    Every cut is a global sort-and-limit, which keeps no more rows than the cut
    in any task, so floors would save nothing here.
    """
    one = Terms(
        names=(normalise(preference["name"]),), places=(normalise(preference["place"]),),
        song_text=terms.song_text, song_name=terms.song_name, topic=terms.topic,
    )
    scores = line_scores(lines, one, line_spec)
    # any priority but the first means the place comes first
    priority = PRIORITIES[0] if preference["priority"] == PRIORITIES[0] else PRIORITIES[1]
    ranked = ranked_items(scored_items(items, scores, item_spec), one)
    candidates = candidate_rows(ranked, one, (priority,)).withColumns(
        {"song": F.lit(preference["song"]), "politics": F.lit(preference["politics"])}
    )
    stages = [
        Stage(s.order, s.limit, s.keep) for s in ranking_stages(one, cuts, top)
    ]
    return cascade(candidates, stages)


def option_lists(lines: DataFrame, terms: Terms, spec: LineSpec = LineSpec()) -> DataFrame:
    """The choices to offer: names and places that occur in the lines, and the fixed ones."""
    lowered = lines.select(F.lower(spec.name).alias("_name"), F.lower(spec.place).alias("_place"))
    hits = F.array_compact(F.array(*[
        F.when(_flag(column, v) == 1, _option(dimension, v))
        for dimension, column, values in (
            ("name", "_name", terms.names), ("place", "_place", terms.places)
        )
        for v in values
    ]))
    return lowered.select(F.inline(hits)).distinct().unionByName(
        lines.sparkSession.range(1).select(F.inline(_fixed_options()))
    )


def options(
    lines: DataFrame, names: DataFrame, places: DataFrame, spec: LineSpec = LineSpec(), value: str = "value"
) -> DataFrame:
    """As :func:`option_lists`, with the choices as tables of any length.

    The distinct texts of the lines, far fewer than the lines, look for the choices they
    hold: a choice can only be in a text that holds its first ``PART`` characters, so texts
    and choices meet by these and not all with all.
    """
    found = None
    for dimension, column, wanted in (("name", spec.name, names), ("place", spec.place, places)):
        text = lines.select(F.lower(column).alias("_text")).where("_text is not null").distinct()
        rows = held_choices(text, wanted, value).select(F.lit(dimension).alias("dimension"), "value").distinct()
        found = rows if found is None else found.unionByName(rows)
    return found.unionByName(lines.sparkSession.range(1).select(F.inline(_fixed_options())))


def held_choices(texts: DataFrame, wanted: DataFrame, value: str = "value") -> DataFrame:
    """(_text, value): the choices each of the distinct lower-case texts holds; empty choices are held by none."""
    choices = wanted.select(F.col(value).alias("value"), F.lower(F.trim(value)).alias("_low")).distinct()
    choices = choices.where("_low != ''").withColumn("_part", F.substring("_low", 1, PART))
    sizes = [r[0] for r in choices.select(F.length("_part").alias("n")).distinct().collect()]
    starts = F.expr("sequence(1, length(_text))")

    def of_size(n: int) -> Column:
        return F.transform(starts, lambda i: F.col("_text").substr(i, F.lit(n)))

    every = F.flatten(F.array(*map(of_size, sizes))) if sizes else F.array().cast("array<string>")
    held = texts.where("_text != ''").select("_text", F.explode(F.array_distinct(every)).alias("_part"))
    return held.join(choices, "_part").where(F.contains("_text", "_low")).select("_text", "value").distinct()


def _fixed_options() -> Column:
    return F.array(*[
        _option(dimension, v)
        for dimension, values in (
            ("priority", PRIORITIES), ("song", ("False", "True")), ("politics", ("False", "True"))
        )
        for v in values
    ])


def _option(dimension: str, value: str) -> Column:
    return F.struct(F.lit(dimension).alias("dimension"), F.lit(value).alias("value"))


def lookup(requests: DataFrame, store: DataFrame, default: dict) -> DataFrame:
    """Answers preference requests from the stored table; unknown keys get the default.

    Works on a batch or a streaming ``requests`` table. The flags may come as text.
    """
    typed = requests.withColumns({c: parse_flag(c) for c in ("song", "politics")})
    return with_default(typed, store, KEYS, default)

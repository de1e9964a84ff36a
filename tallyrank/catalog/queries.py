"""The registered queries: each takes (session, table folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.catalog import fixtures as fx
from tallyrank.functions import scalars, text
from tallyrank.ml import compare, forest, knn, search, split, stack, trees
from tallyrank.operators import aggregate, impute, ordering, profile, rank
from tallyrank.plans import charts, choices, features, recommend
from tallyrank.session import scratch_path, write_through
from tallyrank.sources import tables
from tallyrank.spec import ItemSpec, LineSpec

ITEM, LINE = ItemSpec(), LineSpec()
RECORD = ["id", "title", "rating", "image", "link"]
PREFERENCE = {
    "name": " Blue ", "place": "NATION_1", "priority": "Characters", "song": True, "politics": False,
}
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    REGISTRY[function.__name__] = function
    return function


def _finite(column: str, out: str) -> list:
    """Odds for comparison: the finite value, and a flag where every row matched."""
    infinite = F.col(column) == float("inf")
    return [
        F.round(F.when(~infinite, F.col(column)), 6).alias(out),
        infinite.cast("bigint").alias(f"{out}_infinite"),
    ]


# --- sources -----------------------------------------------------------------


@query
def scan_csv(spark, sf):
    path = scratch_path(spark, "csv")
    fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(
            F.concat(F.lit('say "'), "o_orderpriority", F.lit('",\n'), "o_orderstatus")
        ).alias("note"),
        F.when(F.col("o_orderkey") % 8 == 0, "NaN")
        .when(F.col("o_orderkey") % 11 == 0, "")
        .otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.to_date("o_orderdate").alias("day"),
    ).write.options(header=True, quote='"', escape='"').csv(path)
    return tables.read_csv(spark, path, "id bigint, note string, price double, day date", multi_line=True)


@query
def scan_csv_lenient(spark, sf):
    path = scratch_path(spark, "csv")
    key = F.col("o_orderkey")
    quoted = F.concat(F.lit('"a ""'), "o_orderpriority", F.lit('"" b"'))
    fx.table(spark, sf, "orders").select(
        F.when(key % 11 == 0, F.concat_ws(",", key, quoted, key % 100, F.lit("surplus")))
        .when(key % 7 == 0, F.concat_ws(",", key, quoted))
        .otherwise(F.concat_ws(",", key, quoted, key % 100)).alias("raw")
    ).write.options(header=True, sep="\u0001", quote="\u0000", escape="\u0000").csv(path)
    return tables.read_csv(spark, path, "id bigint, txt string, n bigint", lenient=True)


# --- scalar expressions ------------------------------------------------------


@query
def year_cycle_flag(spark, sf):
    flag = scalars.four_year_flag(ITEM.aired).cast("bigint").alias("cycle_year")
    return fx.items(spark, sf).select("id", flag)


@query
def contains_flag(spark, sf):
    flags = [text.contains_flag("line", f" {t.title()} ").cast("bigint").alias(f"has_{t}") for t in fx.TEXT_TERMS]
    sources = [text.contains_flag("source", t).cast("bigint").alias(f"from_{t}") for t in fx.SOURCE_TERMS]
    return fx.text_lines(spark, sf).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), *flags, *sources
    )


@query
def contains_complement(spark, sf):
    flags = [
        text.contains_complement(LINE.name, t).cast("bigint").alias(f"not_{t}") for t in fx.TERMS.names
    ]
    return fx.lines(spark, sf).select("item_id", "who", *flags)


def _keyword_rows(spark, sf):
    """Lines with their topic terms, and lines of real text with some common endings."""
    lines = fx.lines(spark, sf).select(
        F.lit("lines").alias("source"), F.col("item_id").alias("key"),
        text.keyword_score(LINE.text, fx.TERMS.topic).alias("score"),
        F.lit(len(fx.TERMS.topic)).alias("top"),
    )
    prose = fx.text_lines(spark, sf).select(
        F.lit("text_lines").alias("source"), F.col("doc_id").alias("key"),
        text.keyword_score("line", fx.TEXT_TERMS).alias("score"), F.lit(len(fx.TEXT_TERMS)).alias("top"),
    )
    return lines.unionByName(prose)


@query
def keyword_score(spark, sf):
    return _keyword_rows(spark, sf).select("source", "key", F.col("score").cast("bigint").alias("score"))


@query
def keyword_score_negated(spark, sf):
    score, top = F.col("score"), F.col("top")
    return aggregate.grouped(
        _keyword_rows(spark, sf), ["source", "key"],
        F.sum(text.polarity(score, top, True)).alias("score"),
        F.sum(text.polarity(score, top, False)).alias("score_negated"),
    )


@query
def match_odds(spark, sf):
    return recommend.match_odds(fx.text_lines(spark, sf), "doc_id", "line", fx.TEXT_TERMS).select(
        "doc_id", "term", "matched", "unmatched", *_finite("odds", "odds")
    )


@query
def composite_key(spark, sf):
    flags = [scalars.flag_text(scalars.parse_flag(c)) for c in ("song", "politics")]
    key = scalars.composite_key("name", "place", "priority", *flags).alias("preference")
    return fx.requests(spark, sf).select("request_id", key)


# --- filters -----------------------------------------------------------------


@query
def dropna_any(spark, sf):
    return impute.dropna_any(fx.items(spark, sf).drop(ITEM.views))


@query
def strided_sample(spark, sf):
    items = fx.items(spark, sf)
    slices = {"early": (0, 276, 4), "late": (276, 600, 4), "rest": (600, None, 4)}
    return ordering.strided_slices(
        items.select("id", scalars.known_in(items, "rating")), "id", slices, name="series"
    ).select("series", "position", "id", "rating")


@query
def dedupe_keys(spark, sf):
    wanted = fx.requests(spark, sf).select(
        "name", "place", "priority", *[scalars.parse_flag(c).alias(c) for c in ("song", "politics")]
    )
    known = wanted.where((F.col("priority") == "Location") & F.col("song"))
    return rank.dedupe_keys(wanted, recommend.KEYS, known)


@query
def speaking_lines(spark, sf):
    return features.speaking_lines(fx.lines(spark, sf), drop=["txt", "place_id"])


@query
def filtered_count(spark, sf):
    return profile.filtered_count(fx.lines(spark, sf), scalars.at_least(LINE.words, 100), LINE.speaking)


@query
def long_rows(spark, sf):
    return fx.lines(spark, sf).where(scalars.at_least(LINE.words, 100)).select("who", "item_id", "words")


# --- joins -------------------------------------------------------------------


@query
def left_join_agg(spark, sf):
    matched = aggregate.grouped(
        fx.lines(spark, sf), LINE.key,
        F.sum(text.contains_flag(LINE.name, fx.GROUP_TERM)).alias("matched"),
        F.sum(text.contains_complement(LINE.name, fx.GROUP_TERM)).alias("unmatched"),
    )
    items = fx.items(spark, sf).select("id", "title")
    return items.join(matched, items["id"] == matched["item_id"], "left").drop("item_id")


@query
def inner_join_titles(spark, sf):
    items = fx.items(spark, sf)
    return features.clean_items(items).select("id", "views", "rating").join(items.select("id", "title"), "id")


@query
def aligned_ratio(spark, sf):
    lines = fx.lines(spark, sf)
    in_group = text.matches(LINE.name, fx.GROUP_TERM, case_sensitive=True)
    part = aggregate.grouped(lines.where(in_group), LINE.key, F.count(LINE.speaking).alias("part"))
    whole = aggregate.grouped(lines, LINE.key, F.count(LINE.speaking).alias("whole"))
    return aggregate.aligned_ratio(part, whole, LINE.key, "part", "whole").withColumn(
        "ratio", F.round("ratio", 6)
    )


@query
def preference_grid(spark, sf):
    """The 280 preferences, each with the lines that match its name and its place."""
    totals = fx.lines(spark, sf).agg(
        F.create_map(*[
            part for t in fx.TERMS.names
            for part in (F.lit(t), F.sum(text.contains_flag(LINE.name, t)))
        ]).alias("by_name"),
        F.create_map(*[
            part for t in fx.TERMS.places
            for part in (F.lit(t), F.sum(text.contains_flag(LINE.place, t)))
        ]).alias("by_place"),
    )
    return recommend.preference_grid(totals, fx.TERMS.names, fx.TERMS.places).select(
        *recommend.KEYS,
        F.col("by_name")[F.col("name")].alias("name_lines"),
        F.col("by_place")[F.col("place")].alias("place_lines"),
    )


def _store(spark, sf):
    return recommend.recommend_all(
        spark, fx.items(spark, sf), fx.lines(spark, sf), fx.TERMS, fx.DEFAULT
    )


@query
def lookup_join(spark, sf):
    path, store = scratch_path(spark, "store"), _store(spark, sf)
    tables.write_store(store, path, partition_by="priority")
    return recommend.lookup(
        fx.requests(spark, sf), tables.read_store(spark, path, store.schema), fx.DEFAULT
    ).select("request_id", *recommend.KEYS, *RECORD)


# --- aggregations ------------------------------------------------------------


@query
def group_sum(spark, sf):
    lines = fx.lines(spark, sf)
    return aggregate.grouped(
        lines, LINE.key,
        F.sum(scalars.known_in(lines, "words")).alias("words"),
        F.sum(text.contains_flag(LINE.name, "old")).alias("matched"),
    )


@query
def group_mean_max(spark, sf):
    lines = fx.lines(spark, sf)
    words = scalars.known_in(lines, "words")
    return aggregate.grouped(
        lines, LINE.key, F.round(F.avg(words), 6).alias("mean_words"), F.max(words).alias("max_words"),
    )


@query
def group_count_nonnull(spark, sf):
    counted = aggregate.grouped(fx.lines(spark, sf), LINE.key, F.count("speaking").alias("n_speaking"))
    return counted.orderBy(LINE.key)


@query
def conditional_share(spark, sf):
    in_group = text.matches(LINE.name, fx.GROUP_TERM, case_sensitive=True)
    return aggregate.grouped(
        fx.lines(spark, sf), LINE.key,
        F.round(aggregate.conditional_share(in_group, LINE.speaking), 6).alias("share"),
        F.round(aggregate.conditional_share(in_group, LINE.speaking, "zero"), 6).alias("share_or_zero"),
    )


@query
def group_nunique(spark, sf):
    return aggregate.grouped(
        fx.lines(spark, sf), LINE.key, F.countDistinct(LINE.place_key).alias("n_places")
    )


@query
def group_count_all(spark, sf):
    return aggregate.group_count_all(fx.lines(spark, sf), LINE.key)


@query
def group_cardinality(spark, sf):
    return aggregate.group_cardinality(fx.lines(spark, sf), LINE.key)


@query
def global_min_max(spark, sf):
    return profile.global_min_max(fx.items(spark, sf), ["id", "air_date", "rating"])


@query
def metric_summary(spark, sf):
    return profile.metric_summary(fx.items(spark, sf), ["viewers", "rating"])


@query
def describe(spark, sf):
    items = features.clean_items(fx.items(spark, sf))
    numeric = ["id", "season", "number_in_season", "views", "rating", "title_len", "cycle_year"]
    exact = [F.round(c, 9).alias(c) for c in ("min", "p25", "p50", "p75", "max")]
    return profile.describe(items, numeric).select(
        "metric", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *exact
    )


@query
def null_profile(spark, sf):
    return profile.null_profile(fx.items(spark, sf))


@query
def histogram(spark, sf):
    items = features.clean_items(fx.items(spark, sf))
    every = profile.histograms(items, {"rating": 30, "views": 30, "title_len": 40})
    return every.select(
        "metric", "bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n"
    )


@query
def fixed_bins(spark, sf):
    return profile.fixed_bins(fx.lines(spark, sf), LINE.words, 0, 115, 5)


@query
def key_coverage(spark, sf):
    """Coverage of item ids by the lines, with the gaps between them counted as a check."""
    lines = fx.lines(spark, sf)
    return aggregate.key_coverage(lines, LINE.key).withColumn("n_listed", aggregate.missing_count(lines, LINE.key))


@query
def missing_keys(spark, sf):
    """Item ids that no line has, between the smallest and the largest that one has."""
    return aggregate.missing_keys(fx.lines(spark, sf), LINE.key)


# --- imputation --------------------------------------------------------------


def _features(spark, sf):
    return features.item_features(
        features.clean_items(fx.items(spark, sf)), fx.lines(spark, sf), fx.GROUP_TERM
    )


@query
def impute_mean(spark, sf):
    table = features.model_table(_features(spark, sf))
    return table.select("id", *[F.round(c, 6).alias(c) for c in features.IMPUTED])


@query
def backfill(spark, sf):
    filled = features.clean_items(fx.items(spark, sf), fill="before", keep_urls=False)
    series = ordering.backfill(fx.series(spark, sf), ["value"], "event_id")
    return filled.select(
        F.lit("items").alias("source"), F.col("id").alias("key"), "air_date", "cycle_year",
        "views", F.col("rating").alias("value"),
    ).unionByName(
        series.select(F.lit("series").alias("source"), F.col("event_id").alias("key"), "value"),
        allowMissingColumns=True,
    )


@query
def fill_zero(spark, sf):
    return impute.fill_constant(fx.series(spark, sf), 0, ["value"])


# --- ranking -----------------------------------------------------------------


@query
def topk(spark, sf):
    """The five best items of each season, and over all seasons."""
    items = fx.items(spark, sf)
    items = items.select("season", "id", scalars.known_in(items, "rating"), "viewers")
    per_season = rank.topk(items, ["rating", "viewers"], 5, by=["season"], rank="place")
    overall = rank.topk(items, ["rating", "viewers"], 5, rank="place")
    return per_season.unionByName(overall.withColumn("season", F.lit(None).cast("bigint")))


def _scores(spark, sf):
    return recommend.line_scores(fx.lines(spark, sf), fx.TERMS)


@query
def cascade_topk(spark, sf):
    """Up to five items per preference, in place of one."""
    found = recommend.winners(fx.items(spark, sf), _scores(spark, sf), fx.TERMS, top=5)
    return found.select(*recommend.KEYS, "id", "rating")


@query
def recommend_one(spark, sf):
    found = recommend.recommend_one(fx.items(spark, sf), fx.lines(spark, sf), fx.TERMS, PREFERENCE)
    return found.select("id", "rating", "song_score", "topic_score", "n_lines")


@query
def recommend_all(spark, sf):
    return _store(spark, sf)


@query
def recommend_choices(spark, sf):
    """The recommendation table with names and places as tables of any length."""
    names, places = (spark.createDataFrame([(t,) for t in terms], "value string") for terms in (fx.TERMS.names, fx.TERMS.places))
    return choices.recommend_choices(fx.items(spark, sf), fx.lines(spark, sf), names, places, fx.TERMS, fx.DEFAULT)


@query
def option_lists(spark, sf):
    """The choices, with names and places from lookup lists whose rows end in a stray delimiter."""
    values = {}
    for dimension, terms in (("name", fx.TERMS.names), ("place", fx.TERMS.places)):
        path = scratch_path(spark, dimension)
        rows = spark.createDataFrame([(t,) for t in terms], "value string")
        rows.select(F.concat("value", F.lit(",")).alias("value,")).write.options(
            header=True, sep="\u0001", quote="\u0000", escape="\u0000"
        ).csv(path)
        values[dimension] = tables.read_lookup(spark, path, "value")
    return recommend.options(fx.lines(spark, sf), values["name"], values["place"])


# --- item tables -------------------------------------------------------------


@query
def clean_items(spark, sf):
    return features.clean_items(fx.items(spark, sf))


@query
def item_features(spark, sf):
    table = _features(spark, sf).drop("image", "link")
    return table.withColumns({c: F.round(c, 6) for c in ("mean_words", "group_share")})


@query
def item_features_in_series(spark, sf):
    """The feature table of items that also carry their number in the whole series."""
    items = fx.items(spark, sf).withColumn("number_in_series", F.col("id") * 3 % 1009)
    cleaned = features.clean_items(items, ItemSpec(series="number_in_series"))
    table = features.item_features(cleaned, fx.lines(spark, sf), fx.GROUP_TERM).drop("image", "link")
    return table.withColumns({c: F.round(c, 6) for c in ("mean_words", "group_share")})


def _ratio(spark, sf, column, wanted):
    found = recommend.match_odds(fx.lines(spark, sf), LINE.key, column, wanted)
    items = fx.items(spark, sf).select("id")
    return items.join(found, items["id"] == found["item_id"], "left").select(
        "id", "term", "matched", "unmatched", *_finite("odds", "odds")
    )


@query
def entity_ratio(spark, sf):
    return _ratio(spark, sf, LINE.name, fx.TERMS.names)


@query
def location_ratio(spark, sf):
    return _ratio(spark, sf, LINE.place, fx.TERMS.places)


def _item_scores(spark, sf, score, top):
    items = fx.items(spark, sf).select("id")
    return items.join(_scores(spark, sf), "id", "left").select(
        "id", "n_lines", score, recommend.negated(F.col(score), top, F.col("n_lines")).alias(f"{score}_negated")
    )


@query
def song_score(spark, sf):
    return _item_scores(spark, sf, "song", 2)


@query
def topic_score(spark, sf):
    return _item_scores(spark, sf, "topic", len(fx.TERMS.topic))


# --- chart series ------------------------------------------------------------


@query
def time_series(spark, sf):
    """The series behind the chart, back-filled, written as CSV and read again."""
    items = features.clean_items(fx.items(spark, sf), fill="before", keep_urls=False)
    path = scratch_path(spark, "series")
    tables.write_series(charts.time_series(items, "air_date", ["rating", "views"]), path)
    return tables.read_csv(spark, path, "x date, id bigint, series string, y double")


@query
def feature_target_pairs(spark, sf):
    pairs = profile.long_form(
        _features(spark, sf), "id", "rating", ["title_len", "mean_words", "group_share", "max_words"]
    )
    return pairs.withColumn("x", F.round("x", 6))


# --- rating models -----------------------------------------------------------


def _model_table(spark, sf):
    """The imputed feature table, written once: every fit reads it many times."""
    return write_through(features.model_table(_features(spark, sf)), "model-table")


@query
def train_test_split(spark, sf):
    return split.with_split(fx.items(spark, sf).select("id"))


def _neighbours(table):
    tagged = split.with_split(table)
    train = tagged.where(F.col("split") == "train")
    near = knn.knn_predict(train, tagged, features.FEATURES, "rating")
    return tagged.select("id", "split", "rating").join(near, "id")


@query
def knn_regress(spark, sf):
    return _neighbours(_model_table(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("rating", "predicted")}
    )


@query
def rmse(spark, sf):
    scored = _neighbours(_model_table(spark, sf))
    return scored.groupBy("split").agg(F.round(split.rmse("rating", "predicted"), 6).alias("rmse"))


@query
def predicted_vs_actual(spark, sf):
    """Every item by id, with its predicted and its actual rating."""
    series = charts.predicted_vs_actual(_neighbours(_model_table(spark, sf)))
    return series.withColumns({c: F.round(c, 6) for c in ("rating", "predicted")})


@query
def predicted_vs_actual_strided(spark, sf):
    """Every fourth item by id, with its predicted and its actual rating."""
    series = charts.predicted_vs_actual(_neighbours(_model_table(spark, sf)))
    return ordering.strided_sample(series, "id", 0, None, 4).withColumns(
        {c: F.round(c, 6) for c in ("rating", "predicted")}
    )


@query
def recommend_enriched(spark, sf):
    """The recommendation table with the predicted rating next to the actual one."""
    items, table = fx.items(spark, sf), _model_table(spark, sf)
    found = recommend.winners(items, _scores(spark, sf), fx.TERMS)
    found = write_through(found.select("id", *recommend.KEYS), "winners")
    train = split.with_split(table).where(F.col("split") == "train")
    wanted = table.join(found.select("id").distinct(), "id")
    predictions = knn.knn_predict(train, wanted, features.FEATURES, "rating")
    records = recommend.enrich(found, items, predictions)
    grid = recommend.preference_grid(spark.range(1), fx.TERMS.names, fx.TERMS.places).drop("id")
    default = {**fx.DEFAULT, "predicted": 0.0}
    return recommend.with_default(grid, records, recommend.KEYS, default).withColumn(
        "predicted", F.round("predicted", 6)
    )


def _fitted(spark, sf, estimator):
    vectors = stack.assembler().transform(split.with_split(_model_table(spark, sf)))
    model = estimator.fit(vectors.where(F.col("split") == "train"))
    return model.transform(vectors).select("id", "split", "rating", "predicted")


@query
def adaboost_r2(spark, sf):
    return _fitted(spark, sf, compare.boosting())


@query
def gbt_regress(spark, sf):
    return _fitted(spark, sf, compare.gradient_boosting(rounds=500, lossType="absolute"))


def _stack(table):
    """A stack with the stages' own settings, fitted on the training rows."""
    train, _ = split.train_test_split(table)
    return stack.stack_pipeline(stack.first_stage(), stack.second_stage()).fit(train)


@query
def stack_regress(spark, sf):
    table = _model_table(spark, sf)
    return _stack(table).transform(split.with_split(table)).select("id", "split", "rating", stack.FIRST, "predicted")


@query
def feature_importance(spark, sf):
    model = _stack(_model_table(spark, sf))
    return charts.labelled_importances(stack.feature_importances(spark, model))


# On features of few values trees grown until nothing is left to split predict the mean of
# their group, which SQL can tell. These queries put the whole way of the models to that test.

FEW_VALUED = ("number_in_season", "cycle_year")
PURE = {"maxDepth": 12}


def _pure_models():
    """For rows that count by their weight."""
    return {
        "forest": compare.forest(trees=1, depth=12, bootstrap=False, weightCol="weight"),
        "boosting": compare.boosting(rounds=1, weightCol="weight", **PURE),
        "gradient_boosting": compare.gradient_boosting(rounds=1, weightCol="weight", **PURE),
    }


def _pure_vectors(spark, sf):
    return stack.assembler(FEW_VALUED).transform(split.with_split(_model_table(spark, sf)))


def _pure_groups(vectors):
    """Equal rows of features of few values once, with their number, for the fits over them."""
    groups = trees.equal_rows(vectors.select(*FEW_VALUED, "rating", "split"))
    return stack.assembler(FEW_VALUED).transform(write_through(groups, "split-groups"))


def _pure_fitted(groups):
    train = groups.where(F.col("split") == "train")
    return {name: model.fit(train) for name, model in _pure_models().items()}


@query
def models_group_mean(spark, sf):
    """What each kind of tree model predicts for every item."""
    scored = _pure_vectors(spark, sf)
    models = _pure_fitted(_pure_groups(scored))
    # all of them in one pass over the items
    for name, model in models.items():
        scored = model.transform(scored).withColumnRenamed("predicted", name)
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.round(n, 6).alias("predicted")) for n in models])
    return scored.select("id", "split", F.inline(rows)).select("model", "id", "split", "predicted")


@query
def forest_regress(spark, sf):
    """A forest of 400 trees without a limit of depth."""
    table = split.with_split(_model_table(spark, sf))
    grown = forest.fit(table.where(F.col("split") == "train"), features.FEATURES, "rating")
    return table.select("id", "split", "rating").join(grown.predict(table), "id")


@query
def forest_chain(spark, sf):
    """A tree far deeper than thirty levels, grown to purity: it predicts the mean of rows with equal features.

    Labels halve from one feature value to the next, so every split parts the largest from the rest.
    """
    items = fx.items(spark, sf).select("id", (F.col("id") % 60).alias("step"))
    label = F.pow(F.lit(2.0), -F.col("step")) * (1 + F.col("id") % 7 / 100)
    table = write_through(items.withColumn("label", label), "chain")
    grown = forest.fit(table, ["step"], "label", trees=1, bootstrap=False, few=12_000)
    return grown.predict(table).select("id", F.round(F.log2("predicted"), 6).alias("log_predicted"))


SPLIT_BY = ("number_in_season", "cycle_year", "title_len")


def _grown(spark, sf):
    """The nodes of a tree of three levels."""
    vectors = stack.assembler(SPLIT_BY).transform(split.with_split(_model_table(spark, sf)))
    learner = DecisionTreeRegressor(featuresCol="features", labelCol="rating", maxDepth=3)
    return trees.node_table(spark, learner.fit(vectors.where(F.col("split") == "train")))


@query
def tree_nodes(spark, sf):
    """What every split of a tree gains on how many rows."""
    names = F.array(*map(F.lit, SPLIT_BY))
    return _grown(spark, sf).where("feature is not null").select(
        names[F.col("feature")].alias("feature"), "rows", F.round("gain", 9).alias("gain")
    )


@query
def feature_shares(spark, sf):
    """Importances from the nodes of a tree, with their labels, the largest first."""
    return charts.labelled_importances(trees.importances(_grown(spark, sf), SPLIT_BY)).withColumn(
        "importance", F.round("importance", 6)
    )


def _few_valued(spark, sf):
    """Vectors of the features of few values, written once for the many fits over them."""
    return write_through(_pure_vectors(spark, sf).select("id", "split", "rating", "features"), "few-valued")


@query
def boosting_rounds(spark, sf):
    """Three rounds of boosting with each loss: what the weighted median of the trees predicts."""
    vectors = _few_valued(spark, sf)
    train = vectors.where(F.col("split") == "train")
    parts = [
        compare.boosting(rounds=fx.ROUNDS, loss=loss, stepSize=rate, **PURE).fit(train).transform(vectors).select(
            F.lit(loss).alias("loss"), "id", F.round("predicted", 6).alias("predicted")
        )
        for loss, rate in fx.BOOSTED
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def absolute_rounds(spark, sf):
    """Three rounds of boosting of the absolute error: leaves are medians of residuals."""
    vectors = _few_valued(spark, sf)
    model = compare.median_boosting(rounds=fx.ROUNDS, stepSize=0.3, **PURE).fit(vectors.where(F.col("split") == "train"))
    return model.transform(vectors).select("id", "split", F.round("predicted", 6).alias("predicted"))


def _searched(spark, sf):
    """A learner with the ranges its search draws from, training rows and rows held out."""
    vectors = _few_valued(spark, sf)
    learner = compare.boosting(**PURE)
    space = search.boosting_space(learner, fx.SEARCH_ROUNDS)
    train, held = (vectors.where(F.col("split") == s) for s in ("train", "test"))
    return learner, space, train, held


def _search_groups(spark, sf):
    """A learner with all that its search draws from, and equal training rows of a fold once, with their number."""
    tagged = split.with_folds(split.with_split(_model_table(spark, sf)), fx.FOLDS)
    train = tagged.where(F.col("split") == "train").select(*FEW_VALUED, "rating", "fold")
    groups = write_through(trees.equal_rows(train), "search-groups")
    learner = compare.boosting(weightCol="weight", **PURE)
    return learner, search.boosting_space(learner), stack.assembler(FEW_VALUED).transform(groups)


def _search_rows(found, turn):
    for i, (chosen, scores) in enumerate(zip(found.settings, found.scores)):
        for fold, score in enumerate(scores):
            yield (
                turn, i, chosen["loss"], chosen["stepSize"], chosen["maxIter"], fold, round(score, 6), i == found.best
            )


SEARCH_ROW = "turn int, draw int, loss string, rate double, rounds int, fold int, r2 double, chosen boolean"


@query
def random_search(spark, sf):
    """Every draw's score on every fold, and which draw is chosen; all losses, rates and rounds."""
    learner, space, train = _search_groups(spark, sf)
    found = search.random_search(learner, train, space, draws=fx.DRAWS, folds=fx.FOLDS, seed=fx.SEED)
    return spark.createDataFrame(list(_search_rows(found, 0)), SEARCH_ROW)


@query
def retrain_until(spark, sf):
    """Searches repeated until the hold-out error is low enough, at most a stated number of times.

    The run is broken off after its first search; a second one goes on from the store.
    """
    learner, space, train, held = _searched(spark, sf)
    store = search.Store(spark, scratch_path(spark, "searches"))
    options = {"draws": fx.DRAWS, "folds": fx.FOLDS, "seed": fx.SEED, "store": store}
    search.retrain_until(learner, train, held, space, 0.0, max_rounds=1, **options)
    found = search.retrain_until(learner, train, held, space, 0.0, max_rounds=fx.TURNS, **options)
    rows = [(turn, round(error, 6), error == min(found.errors)) for turn, error in enumerate(found.errors)]
    return spark.createDataFrame(rows, "turn int, rmse double, best boolean")


@query
def comparison_group_mean(spark, sf):
    """Training and test error of each kind of tree model."""
    groups = _pure_groups(_pure_vectors(spark, sf))
    parts = [compare.split_errors(m.transform(groups), name, weight="weight") for name, m in _pure_fitted(groups).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("rmse", F.round("rmse", 6))


@query
def cv_folds(spark, sf):
    return split.with_folds(fx.items(spark, sf).select("id"), 4)


@query
def cv_group_mean(spark, sf):
    """Cross-validated error of each kind of tree model, on as many folds as training takes."""
    tagged = split.with_folds(_model_table(spark, sf), 4)
    groups = write_through(trees.equal_rows(tagged.select(*FEW_VALUED, "rating", "fold")), "fold-groups")
    vectors = stack.assembler(FEW_VALUED).transform(groups)
    errors = {(name, "cv"): search.cv_rmse(model, vectors, 4) for name, model in _pure_models().items()}
    return stack.error_rows(spark, errors).withColumn("rmse", F.round("rmse", 6))


def _stack_scores(spark, sf):
    """All items scored with a stack that was saved and loaded."""
    table, path = _model_table(spark, sf), scratch_path(spark, "stack")
    train, _ = split.train_test_split(table)
    train = write_through(trees.equal_rows(train.select(*FEW_VALUED, "rating")), "train-groups")
    pipeline = stack.stack_pipeline(
        stack.first_stage(maxIter=1, weightCol="weight", **PURE),
        stack.second_stage(maxIter=1, weightCol="weight", **PURE), FEW_VALUED,
    )
    stack.save_model(pipeline.fit(train), path)
    return stack.batch_score(stack.load_model(path), table, fx.items(spark, sf))


@query
def stack_group_mean(spark, sf):
    """All items with the stack's prediction and what is displayed."""
    scored = _stack_scores(spark, sf)
    return scored.select("id", "title", "season", "views", *[F.round(c, 6).alias(c) for c in ("rating", "predicted")])


@query
def recommend_stacked(spark, sf):
    """The recommendation table with the stack's predicted rating next to the actual one."""
    items = fx.items(spark, sf)
    found = recommend.winners(items, _scores(spark, sf), fx.TERMS)
    records = recommend.enrich(found, items, _stack_scores(spark, sf))
    grid = recommend.preference_grid(spark.range(1), fx.TERMS.names, fx.TERMS.places).drop("id")
    table = recommend.with_default(grid, records, recommend.KEYS, {**fx.DEFAULT, "predicted": 0.0})
    return table.withColumn("predicted", F.round("predicted", 6))


@query
def predicted_vs_actual_stacked(spark, sf):
    """Every fourth item by id, with the stack's prediction and the actual rating."""
    series = charts.predicted_vs_actual(_stack_scores(spark, sf))
    return ordering.strided_sample(series, "id", 0, None, 4).withColumns(
        {c: F.round(c, 6) for c in ("rating", "predicted")}
    )

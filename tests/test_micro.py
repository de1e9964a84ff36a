"""Small tables with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tallyrank.functions import scalars, text
from tallyrank.operators import aggregate, impute, ordering, profile, rank
from tallyrank.plans import features, recommend
from tallyrank.sources import tables
from tallyrank.spec import LineSpec, Stage


def test_conditional_share(spark, sorted_rows):
    df = spark.createDataFrame(
        [(1, "A Smith", True), (1, "x", False), (2, "x", True), (2, None, True), (3, "B Smith", None)],
        "k int, who string, speaking boolean",
    )
    hit = text.matches("who", "Smith", case_sensitive=True)
    got = df.groupBy("k").agg(
        aggregate.conditional_share(hit, "speaking").alias("s"),
        aggregate.conditional_share(hit, "speaking", "zero").alias("z"),
    )
    assert sorted_rows(got) == [(1, 0.5, 0.5), (2, None, 0.0), (3, None, None)]


def test_odds(spark):
    df = spark.createDataFrame([(2, 4), (3, 0), (0, 5)], "m long, u long")
    assert [r[0] for r in df.select(text.odds(F.col("m"), F.col("u"))).collect()] == [0.5, math.inf, 0.0]


def test_missing_text_is_no_match(spark, sorted_rows):
    df = spark.createDataFrame([(1, "Nan"), (1, None), (1, "x"), (None, "nan")], "k int, c string")
    got = recommend.match_odds(df, "k", "c", ["nan", "%"])
    assert sorted_rows(got) == [(1, "%", 0, 3, 0.0), (1, "nan", 1, 2, 0.5)]


def test_terms_are_literal(spark):
    df = spark.createDataFrame([("a.b",), ("axb",)], "c string")
    assert [r[0] for r in df.select(text.contains_flag("c", " A.B ")).collect()] == [1, 0]


def test_word_boundary(spark):
    df = spark.createDataFrame([("using it",), ("we sing",)], "c string")
    assert [r[0] for r in df.select(text.contains_flag("c", "sing")).collect()] == [1, 1]
    bounded = text.contains_flag("c", "sing", word_boundary=True)
    assert [r[0] for r in df.select(bounded).collect()] == [0, 1]


def test_song_flags_and_polarity(spark):
    df = spark.createDataFrame([("They sing", "Singer 1"), ("no", None)], "txt string, who string")
    score = text.song_flags("txt", "who", ["singing", "sing"], ["singer"])
    got = df.select(score, text.polarity(score, 2, False), text.polarity(score, 2, F.lit(True))).collect()
    assert [tuple(r) for r in got] == [(2, 0, 2), (0, 2, 0)]


def test_negated_score(spark):
    df = spark.createDataFrame([(3, 4)], "score long, n long")
    assert df.select(recommend.negated(F.col("score"), 2, F.col("n"))).first()[0] == 5


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_backfill(spark, ranges):
    df = spark.createDataFrame(list(enumerate([None, 3, None, 5, None])), "i int, v int")
    got = ordering.backfill(df, ["v"], "i", ranges=ranges).orderBy("i")
    assert [r.v for r in got.collect()] == [3, 3, 5, 5, None]
    again = ordering.backfill(got, ["v"], "i", ranges=ranges).orderBy("i")
    assert again.collect() == got.collect()


def test_backfill_within_groups(spark):
    data = [("a", 0, None), ("a", 1, 1.0), ("b", 0, 2.0), ("b", 1, None), ("b", 2, None)]
    df = spark.createDataFrame(data, "g string, i int, v double")
    got = ordering.backfill(df, ["v"], "i", by=["g"], ranges=2).orderBy("g", "i")
    assert [r.v for r in got.collect()] == [1.0, 1.0, 2.0, None, None]


def test_fixed_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 4.0, 5.0, 100.0, 114.0, 115.0, 130.0)], "x double")
    got = {r.low: r.n for r in profile.fixed_bins(df, "x", 0, 115, 5).collect()}
    assert len(got) == 23 and sum(got.values()) == 5
    assert (got[0], got[5], got[100], got[110]) == (2, 1, 1, 1)
    more = {r.low: r.n for r in profile.fixed_bins(df, "x", 0, 115, 5, overflow=True).collect()}
    assert len(more) == 24 and more[115] == 2


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in range(4)], "x double")
    assert [r.n for r in profile.histogram(df, "x", 3).orderBy("bin").collect()] == [1, 1, 2]
    flat = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    got = profile.histogram(flat, "x", 4).orderBy("bin").collect()
    assert [r.n for r in got] == [0, 0, 2, 0] and (got[0].low, got[-1].high) == (4.5, 5.5)


def test_describe(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 7.0, None, float("nan"))], "x double")
    row = profile.describe(df, ["x"], ranges=3).first()
    assert (row["count"], row["min"], row["p25"], row["p50"], row["p75"], row["max"]) == (4, 1, 1.75, 3, 4.75, 7)
    assert row["std"] == pytest.approx(2.6457513) and row["mean"] == 3.5


def test_describe_of_nothing(spark):
    df = spark.createDataFrame([(1.0, None)], "x double, y double")
    got = {r.metric: r for r in profile.describe(df, ["x", "y"]).collect()}
    assert got["y"]["count"] == 0 and got["y"]["p50"] is None and got["x"]["p50"] == 1.0


def test_rounding(spark):
    df = spark.createDataFrame([(0.25, 0.35, 2.675)], "a double, b double, c double")
    got = df.select(scalars.round_even("a", 1), scalars.round_even("b", 1), scalars.round_even("c", 2))
    assert tuple(got.first()) == (0.2, 0.4, 2.68)


def test_year_flag(spark):
    df = spark.createDataFrame([("2016-02-01",), ("2015-01-01",), (None,)], "d string")
    flag = scalars.four_year_flag(F.col("d").cast("date"))
    assert [r[0] for r in df.select(flag).collect()] == [1, 0, 0]


def test_flags_as_text(spark):
    df = spark.createDataFrame([("False",), ("True",), (" true",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.parse_flag("s")).collect()] == [False, True, True, False, False]
    key = scalars.composite_key(F.lit("a b"), scalars.flag_text(F.lit(False)))
    assert df.select(key).first()[0] == "a b False"


def test_cut_is_not_refilled(spark):
    df = spark.createDataFrame([(1, 3, 0), (2, 1, 1), (3, 2, 1), (4, 0, 1)], "id int, a int, l int")
    got = rank.cascade(df, [Stage(("a",), 2, keep="l != 0")])
    assert [r.a for r in got.collect()] == [2]


def test_cascade_expands_keys_late(spark, sorted_rows):
    df = spark.createDataFrame(
        [("g", i, s, 10 - s) for i, s in enumerate((4, 9, 1, 7))], "k string, id int, up int, down int"
    )
    stages = [
        Stage(("up",), 3),
        Stage(("if(wanted, up, down)",), 1, expand=("wanted", (True, False))),
    ]
    got = rank.cascade(df, stages, by=["k"]).select("k", "wanted", "id")
    assert sorted_rows(got) == [("g", False, 0), ("g", True, 1)]


def test_dedupe_keys(spark, sorted_rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    known = spark.createDataFrame([(2, "b")], "k int, v string")
    assert sorted_rows(rank.dedupe_keys(df, ["k", "v"], known)) == [(1, "a")]


def test_impute_mean_skips_missing(spark, sorted_rows):
    df = spark.createDataFrame([(1, 1.0, 4), (2, None, None), (3, float("nan"), 2), (4, 3.0, 6)], "i int, x double, n int")
    got = impute.impute_mean(df, ["x", "n"])
    assert sorted_rows(got) == [(1, 1.0, 4.0), (2, 2.0, 4.0), (3, 2.0, 2.0), (4, 3.0, 6.0)]


def test_dropna_keeps_infinity(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),)], "x double")
    assert sorted(r.x for r in impute.dropna_any(df).collect()) == [1.0, math.inf]
    assert impute.dropna_any(df.withColumn("y", F.lit(1)), ["y"]).count() == 4


def test_missing_keys(spark):
    df = spark.createDataFrame([(3,), (4,), (7,), (7,)], "k long")
    assert tuple(aggregate.key_coverage(df, "k").first()) == (3, 7, 4, 3, 2)
    assert sorted(r.k for r in aggregate.missing_keys(df, "k").collect()) == [5, 6]


def test_groups_drop_missing_keys(spark, sorted_rows):
    df = spark.createDataFrame([(1, 2), (None, 3)], "k int, v int")
    assert sorted_rows(aggregate.grouped(df, "k", F.sum("v"))) == [(1, 2)]


def test_speaking_lines_rejects_unknown_columns(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "item_id int, speaking boolean")
    assert [r.item_id for r in features.speaking_lines(df).collect()] == [1]
    with pytest.raises(ValueError):
        features.speaking_lines(df, drop=["nope"])


def test_clean_items_fill_order(spark):
    df = spark.createDataFrame(
        [(1, "ab", None, 1, 1, 2.0, 3.0, "i", "l"), (2, "abc", "2016-05-01", 1, 2, None, 4.0, "i", "l")],
        "id long, title string, air_date string, season long, number_in_season long, viewers double, "
        "rating double, image string, link string",
    )
    flags = {
        fill: [r.cycle_year for r in features.clean_items(df, fill=fill, keep_urls=False).orderBy("id").collect()]
        for fill in (None, "before", "after")
    }
    assert flags == {None: [0, 1], "before": [1, 1], "after": [0, 1]}


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,txt,n\n1,"a ""q"" b",2\n2,NA,nan\n3,"two\nlines",6\n4,,\n')
    got = tables.read_csv(spark, str(path), "id long, txt string, n double", multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 'a "q" b', 2.0), (2, None, None), (3, "two\nlines", 6.0), (4, None, None)]


def test_lenient_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,txt,n\n1,"a ""q"" b",2\n2,short\n3,x,4,5\n5,"multi\nline",6\n')
    got = tables.read_csv(spark, str(path), "id long, txt string, n long", lenient=True, multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 'a "q" b', 2), (2, "short", None), (5, "multi\nline", 6)]
    assert tables.read_csv(spark, str(path), "id long, txt string, n long", lenient=True, multi_line=True).select("id").count() == 3


def test_lookup_list(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text("name\nAnn,\nTwo Words,\n")
    assert [r.name for r in tables.read_lookup(spark, str(path), "name").collect()] == ["Ann", "Two Words"]


def test_store_round_trip(spark, tmp_path, sorted_rows):
    df = spark.createDataFrame([("a", "x", 1.5), ("b", "y", None)], "k string, priority string, v double")
    path = str(tmp_path / "store")
    tables.write_store(df, path, partition_by="priority")
    back = tables.read_store(spark, path, df.schema).select(*df.columns)
    assert sorted_rows(back) == sorted_rows(df)


def test_series_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.5)], "series string, x int, y double")
    path = str(tmp_path / "series")
    tables.write_series(df, path)
    assert tables.read_csv(spark, path, df.schema).collect() == df.collect()


def test_missing_text_in_line_features(spark):
    df = spark.createDataFrame(
        [(1, None, None, None, "t", True, 4.0), (1, "Red", 7, None, None, True, None)],
        "item_id long, who string, place_id long, place string, txt string, speaking boolean, words double",
    )
    row = features.line_features(df, LineSpec(), "red").first()
    assert (row.mean_words, row.max_words, row.group_share, row.n_places) == (4.0, 4.0, None, 1.0)
    assert features.line_features(df, LineSpec(), "red", case_sensitive=False).first().group_share == 0.5


def test_nan_is_missing_everywhere(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 5.0), (2, nan), (3, 200.0), (4, None), (5, 7.0)], "id long, v double")
    assert profile.filtered_count(df, scalars.at_least("v", 100), "v").first()[0] == 1
    assert profile.fixed_bins(df, "v", 0, 10, 5, overflow=True).orderBy("low").collect() == [(0, 0), (5, 2), (10, 1)]
    assert tuple(profile.global_min_max(df, ["v"]).first()) == (5.0, 200.0)
    assert [r.v for r in ordering.backfill(df, ["v"], "id").orderBy("id").collect()] == [5.0, 200.0, 200.0, 7.0, 7.0]
    ends = spark.createDataFrame([(1.0,), (inf,), (inf,)], "v double")
    assert ordering.exact_quantiles(ends, ["v"], (0.5,)).first().p50 == inf


def test_rows_without_order_value_stand_last(spark):
    df = spark.createDataFrame([(i if i % 3 else None, i) for i in range(1, 31)], "k long, n long")
    for stop in (3, 25, 20_000, None):
        got = ordering.strided_sample(df, "k", 0, stop, 2).orderBy("position").collect()
        keys = sorted(i for i in range(1, 31) if i % 3) + [None] * 10
        assert [r.k for r in got] == keys[slice(0, stop, 2)]


def test_choices_as_tables(spark):
    lines = spark.createDataFrame([("Old Red Hat", "Nation_1 x"), ("blue", None), (None, "")], "who string, place string")
    names = spark.createDataFrame([("red",), (" Blue ",), ("green",), ("at",), ("",)] + [(f"no{i}",) for i in range(1000)], "value string")
    places = spark.createDataFrame([("NATION_1",), ("nation_2",)], "value string")
    got = {tuple(r) for r in recommend.options(lines, names, places).collect()}
    assert {v for d, v in got if d == "name"} == {"red", " Blue ", "at"}
    assert {v for d, v in got if d == "place"} == {"NATION_1"}

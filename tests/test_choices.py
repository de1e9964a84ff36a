"""Names and places as rows: any number of them, and the same records as with a column for each."""

from pyspark.sql import functions as F

from tallyrank.catalog import fixtures as fx
from tallyrank.plans import choices, recommend


def test_a_thousand_names(spark, sf_dir):
    items, lines = fx.items(spark, sf_dir), fx.lines(spark, sf_dir)
    many = [*fx.TERMS.names, *[f"nobody {i}" for i in range(995)]]
    names, places = (spark.createDataFrame([(v,) for v in values], "value string") for values in (many, fx.TERMS.places))
    found = choices.recommend_choices(items, lines, names, places, fx.TERMS, fx.DEFAULT).cache()
    assert found.count() == 1000 * len(fx.TERMS.places) * 8
    few = recommend.recommend_all(spark, items, lines, fx.TERMS, fx.DEFAULT)
    known = found.where(F.col("name").isin(*fx.TERMS.names)).select(*few.columns)
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, few.collect()))


def test_counts_of_what_matches(spark):
    rows = [(1, "Old Cold"), (1, "old cold"), (1, "x"), (2, None), (2, "scold"), (None, "old"), (3, "")]
    lines = spark.createDataFrame(rows, "k long, who string")
    wanted = spark.createDataFrame([(" OLD ",), ("cold",), ("none",), ("",)], "value string")
    got = {tuple(r) for r in choices.term_counts(lines, "k", "who", wanted).collect()}
    assert got == {(1, " OLD ", 2), (1, "cold", 2), (2, " OLD ", 1), (2, "cold", 1)}


def test_only_texts_that_hold_a_choice_are_written(spark, monkeypatch):
    """Counting choices shuffles and writes no row for a line that holds none."""
    written = []
    monkeypatch.setattr(choices, "write_through", lambda df, name: written.append(df.count()) or df)
    texts = ["Red hen", "red fox", None, *[f"text {i}" for i in range(40)]]
    lines = spark.createDataFrame([(i % 5 if i != 1 else None, t) for i, t in enumerate(texts * 3)], "k long, who string")
    wanted = spark.createDataFrame([("red",), ("fox",), ("owl",)], "value string")
    got = {tuple(r) for r in choices.term_counts(lines, "k", "who", wanted).collect()}
    want = {}
    for r in lines.collect():
        for c in ("red", "fox"):
            if r.k is not None and r.who and c in r.who.lower():
                want[r.k, c] = want.get((r.k, c), 0) + 1
    assert got == {(*at, n) for at, n in want.items()}
    assert written == [3]

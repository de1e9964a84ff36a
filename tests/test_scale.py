"""Results that must not depend on partitioning, skew or ties, and the plans behind them."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrank.catalog import fixtures as fx
from tallyrank.catalog.queries import REGISTRY
from tallyrank.ml.knn import knn_predict
from tallyrank.operators import ordering, rank
from tallyrank.plans import features, recommend
from tallyrank.spec import LineSpec

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["recommend_all", "describe", "backfill", "strided_sample", "item_features"])
def test_same_result_for_any_partitioning(spark, sf_dir, sorted_rows, partitions, name):
    results = []
    for n in (1, 4, 50):
        partitions(n)
        results.append(sorted_rows(REGISTRY[name](spark, sf_dir)))
    assert results[0] == results[1] == results[2]


@QUICK
@given(
    values=st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=60),
    ranges=st.integers(1, 9),
)
def test_backfill_as_pandas(spark, values, ranges):
    df = spark.createDataFrame([(i * 7, v) for i, v in enumerate(values)], "i long, v long")
    got = [r.v for r in ordering.backfill(df, ["v"], "i", ranges=ranges).orderBy("i").collect()]
    want = [None if pd.isna(v) else int(v) for v in pd.Series(values, dtype="float64").bfill()]
    assert got == want


@QUICK
@given(
    values=st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60),
    ranges=st.integers(1, 9),
)
def test_quantiles_as_numpy(spark, values, ranges):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    row = ordering.exact_quantiles(df, ["x"], (0.0, 0.25, 0.5, 0.9, 1.0), ranges).first()
    want = np.quantile(values, (0.0, 0.25, 0.5, 0.9, 1.0))
    assert list(row)[1:] == pytest.approx(list(want), rel=1e-9, abs=1e-9)


def test_quantiles_with_one_value_in_most_rows(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") / 7).alias("x"))
    row = ordering.exact_quantiles(df, ["x"], (0.25, 0.5), 16).first()
    values = [1.0 if i % 3 == 0 else i / 7 for i in range(9000)]
    assert list(row)[1:] == pytest.approx(list(np.quantile(values, (0.25, 0.5))))


def test_positions_with_nulls_last(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, None, 9, 1)], "k long")
    got = {r.k: r.position for r in ordering.row_positions(df, "k", ranges=3).collect()}
    assert got == {1: 0, 3: 1, 5: 2, 9: 3, None: 4}


@pytest.fixture
def crowded(spark):
    """A third of the rows on one order value, some without any."""
    i = F.col("id")
    return spark.range(6000).select(
        F.when(i % 3 == 0, 50.0).when(i % 50 == 1, None).otherwise(i / 60).alias("at"), i.alias("tie"),
        F.when(i % 4 == 0, i).alias("v"), F.lit("x").alias("text"),
    ).repartition(5)


def test_a_crowded_order_value_is_spread_over_ranges(spark, crowded):
    found = ordering.borders(crowded, "at", 16)
    assert found.crowded and not ordering.borders(crowded, "tie", 16).crowded
    sizes = [r["count"] for r in ordering.in_order(crowded, "at", ["tie"], 16, found).groupBy(ordering.RANGE).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 3 * np.median(sizes)


def test_running_total_over_a_crowded_order_value(spark, crowded):
    got = ordering.running_total(crowded, "at", F.coalesce("v", F.lit(0)), "total", tie=["tie"], ranges=16).collect()
    want, total = {}, 0
    for r in sorted(crowded.collect(), key=lambda r: (r["at"] is None, r["at"] or 0, r["tie"])):
        total += r["v"] or 0
        want[r["tie"]] = total
    assert {r["tie"]: r["total"] for r in got} == want


def test_backfill_over_a_crowded_order_value(spark, crowded):
    got = {r["tie"]: r["v"] for r in ordering.backfill(crowded, ["v"], "at", tie=["tie"], ranges=16).collect()}
    want, following = {}, None
    for r in sorted(crowded.collect(), key=lambda r: (r["at"] is None, r["at"] or 0, r["tie"]), reverse=True):
        following = following if r["v"] is None else r["v"]
        want[r["tie"]] = following
    assert got == want


def test_positions_over_a_crowded_order_value(spark, crowded):
    got = [r["position"] for r in ordering.row_positions(crowded, "at", ranges=16).collect()]
    assert sorted(got) == list(range(6000))


def test_strided_sample_is_a_slice(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("id")).repartition(7)
    for start, stop, step in ((0, 276, 4), (276, 600, 4), (5, None, 13)):
        got = [r.id for r in ordering.strided_sample(df, "id", start, stop, step).orderBy("id").collect()]
        assert got == [i * 3 for i in range(1000)][start:stop:step]


def test_topk_beyond_the_group_limit_is_salted(spark, sorted_rows):
    df = spark.range(5000).select("id", F.lit("hot").alias("g"), (F.col("id") % 97).alias("v"))
    plan = rank.topk(df, ["v"], 1500, by=["g"])
    want = sorted(range(5000), key=lambda i: (-(i % 97), i))[:1500]
    assert sorted(r.id for r in plan.collect()) == sorted(want)
    assert "_salt" in plan._jdf.queryExecution().toString()


@QUICK
@given(values=st.lists(st.integers(0, 5), min_size=1, max_size=80), k=st.integers(1, 20))
def test_floor_is_a_safe_bound(spark, values, k):
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    floor = rank.kth_floor(df, {"v": F.col("v")}, k, "id", parts=8).first()["floor"]["v"]
    best = sorted(values, reverse=True)
    if floor is not None:
        assert len(values) >= k and floor <= best[k - 1]


def brute_force(train, queries, k):
    out = {}
    for q, x in queries.items():
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, t)), i, y) for i, (t, y) in train.items())[:k]
        out[q] = sum(y for *_, y in near) / len(near)
    return out


@pytest.mark.parametrize("spread", [1.0, 40.0, 4000.0])
@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("weights", [None, [1.0, 0.0, 0.0]])
def test_neighbours_as_brute_force(spark, spread, hot, weights):
    """With a weak axis, and with a third of all rows at one point of it."""
    source = random.Random(3)
    points = {
        i: ((5.0 if hot and i % 3 == 0 else source.uniform(0, 100)), source.uniform(0, spread), source.randrange(3))
        for i in range(240)
    }
    train = {i: (p, float(i % 11)) for i, p in points.items() if i % 4}
    schema = "id long, a double, b double, c int"
    known = spark.createDataFrame([(i, *p, y) for i, (p, y) in train.items()], schema + ", y double")
    asked = spark.createDataFrame([(i, *p) for i, p in points.items()], schema)
    got = {
        r.id: r.predicted
        for r in knn_predict(known, asked, ["a", "b", "c"], "y", weights=weights, cell_rows=5).collect()
    }
    assert got == pytest.approx(brute_force(train, points, 5))


def test_neighbours_with_a_third_of_equal_rows(spark):
    """Equal rows are cut to k before they meet, and the first by key are chosen."""
    points = {i: (1.0, 2.0) if i % 3 == 0 else (float(i % 50), float(i % 7)) for i in range(300)}
    train = {i: (p, float(i % 13)) for i, p in points.items()}
    known = spark.createDataFrame([(i, *p, y) for i, (p, y) in train.items()], "id long, a double, b double, y double")
    got = {r.id: r.predicted for r in knn_predict(known, known, ["a", "b"], "y", k=3).collect()}
    assert got == pytest.approx(brute_force(train, points, 3))


def test_neighbours_of_a_tiny_training_set(spark):
    known = spark.createDataFrame([(1, 0.0, 2.0), (2, 9.0, 4.0)], "id long, a double, y double")
    asked = spark.createDataFrame([(7, 3.0), (8, 500.0)], "id long, a double")
    got = {r.id: r.predicted for r in knn_predict(known, asked, ["a"], "y").collect()}
    assert got == {7: 3.0, 8: 3.0}


def test_one_hot_item(spark, sf_dir, sorted_rows):
    """An item that holds a third of all lines."""
    lines = fx.lines(spark, sf_dir)
    hot = lines.withColumn("item_id", F.when(F.rand(5) < 0.34, F.lit(1)).otherwise(F.col("item_id")))
    scores = recommend.line_scores(hot, fx.TERMS)
    assert scores.agg(F.sum("n_lines")).first()[0] == lines.count()
    once = scores.where("id = 1").first()
    assert once.n_lines > lines.count() / 4
    assert all(m <= once.n_lines for m in once.matched_names)
    places = hot.where("item_id = 1").select("place_id").na.drop().distinct().count()
    assert features.line_features(hot, LineSpec(), "red").where("id = 1").first().n_places == places


def test_invariants_of_scores(spark, sf_dir):
    n = len(fx.TERMS.topic)
    scores = recommend.line_scores(fx.lines(spark, sf_dir), fx.TERMS)
    bad = scores.where(
        (F.col("song") > 2 * F.col("n_lines")) | (F.col("topic") > n * F.col("n_lines"))
        | F.exists("matched_names", lambda m: m > F.col("n_lines"))
    )
    assert bad.count() == 0


def test_at_most_one_winner_per_preference(spark, sf_dir):
    found = recommend.winners(
        fx.items(spark, sf_dir), recommend.line_scores(fx.lines(spark, sf_dir), fx.TERMS), fx.TERMS
    )
    assert found.groupBy(*recommend.KEYS).count().where("count > 1").count() == 0
    assert found.where("name_odds = 0 or place_odds = 0").count() == 0


def test_pruned_candidates_rank_as_all(spark, sf_dir, sorted_rows):
    """The floors only leave out rows that cannot survive the first cut."""
    items, scores = fx.items(spark, sf_dir), recommend.line_scores(fx.lines(spark, sf_dir), fx.TERMS)
    ranked = recommend.ranked_items(recommend.scored_items(items, scores), fx.TERMS)
    stages = recommend.ranking_stages(fx.TERMS)
    pruned = recommend.candidate_rows(ranked, fx.TERMS, floors=recommend.odds_floors(ranked, fx.TERMS, 40))
    whole = recommend.candidate_rows(ranked, fx.TERMS)
    assert pruned.count() < whole.count()
    keys = [*recommend.KEYS, "id"]
    a = rank.cascade(pruned, stages, by=recommend.KEYS[:3]).select(*keys)
    b = rank.cascade(whole, stages, by=recommend.KEYS[:3]).select(*keys)
    assert sorted_rows(a) == sorted_rows(b)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recommendation_plan(spark, sf_dir):
    items, scores = fx.items(spark, sf_dir), recommend.line_scores(fx.lines(spark, sf_dir), fx.TERMS)
    plan = plan_of(recommend.winners(items, scores, fx.TERMS))
    outer = plan.split("Subquery")[0]
    assert outer.count("WindowGroupLimit") == 5  # four stages, the first also before the shuffle
    assert outer.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scans_are_pruned(spark, sf_dir):
    plan = plan_of(REGISTRY["group_nunique"](spark, sf_dir))
    assert "l_extendedprice" not in plan and "l_quantity" not in plan and "p_name" not in plan
    assert "IsNotNull(l_orderkey)" in plan


@pytest.mark.parametrize("name", [
    "recommend_all", "item_features", "impute_mean", "describe", "histogram", "backfill", "cascade_topk",
    "preference_grid", "entity_ratio", "aligned_ratio", "option_lists", "key_coverage",
])
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = plan_of(REGISTRY[name](spark, sf_dir))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "ArrowPython"):
        assert unwanted not in plan


@pytest.mark.parametrize("cell_rows, piece", [(8_192, 65_536), (40, 65_536), (8, 30), (200, 16)])
def test_neighbours_beyond_a_block_and_in_pieces(spark, cell_rows, piece):
    """Rows whose neighbours lie in other blocks, and a place on the axis that many rows share."""
    rng = random.Random(5)
    rows = [(i, float(rng.randrange(12)) if i % 3 else 4.0, rng.random() * 6, rng.random()) for i in range(240)]
    known = spark.createDataFrame(rows, "id long, a double, b double, y double")
    asked = spark.createDataFrame(
        [(1000 + i, rng.random() * 20 - 4, rng.random() * 6) for i in range(90)] + [(5, 400.0, -3.0)], "id long, a double, b double"
    )
    found = knn_predict(known, asked, ["a", "b"], "y", weights=[1.0, 0.0], cell_rows=cell_rows, piece=piece).collect()
    got = {r["id"]: r["predicted"] for r in found}
    want = {}
    for q in asked.collect():
        near = sorted(rows, key=lambda r: ((r[1] - q["a"]) ** 2 + (r[2] - q["b"]) ** 2, r[0]))[:5]
        want[q["id"]] = sum(r[3] for r in near) / 5
    assert len(found) == len(got) and got == pytest.approx(want)
    few = knn_predict(known.where("id < 3"), asked, ["a", "b"], "y", weights=[1.0, 0.0], cell_rows=cell_rows, piece=piece)
    assert [r["predicted"] for r in few.collect()] == pytest.approx([sum(r[3] for r in rows[:3]) / 3] * 91)
    assert knn_predict(known.limit(0), asked, ["a", "b"], "y", weights=[1.0, 0.0]).count() == 0
    assert knn_predict(known, asked.limit(0), ["a", "b"], "y", weights=[1.0, 0.0]).count() == 0


def test_line_sums_get_more_partitions_with_more_lines(spark, sf_dir, sorted_rows):
    """The memory of a task stays the same as lines grow."""
    lines = fx.lines(spark, sf_dir)
    for work in (
        lambda **o: features.line_features(lines, LineSpec(), "red", **o),
        lambda **o: recommend.match_odds(lines, "item_id", "place", ("nation_1", "nation_2"), **o),
    ):
        fine = work(rows=300)
        assert fine.rdd.getNumPartitions() >= lines.count() / 300 > work().rdd.getNumPartitions()
        assert sorted_rows(fine) == sorted_rows(work())


def test_lines_are_joined_in_partitions_of_bounded_size(spark, sf_dir, sorted_rows, monkeypatch):
    """However many lines there are, no task of the join with their parts sorts more than so many."""
    want = sorted_rows(fx.lines(spark, sf_dir).drop("words"))
    monkeypatch.setattr(fx, "LINE_ROWS", 600)
    lines = fx.lines(spark, sf_dir)
    parts = -(-fx.table(spark, sf_dir, "lineitem").count() // 600)
    assert "hashpartitioning(l_partkey" in (plan := lines._jdf.queryExecution().executedPlan().toString())
    assert parts > 4 and f", {parts})" in plan.split("hashpartitioning(l_partkey", 1)[1].split("\n", 1)[0]
    assert sorted_rows(lines.drop("words")) == want

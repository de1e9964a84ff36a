"""Boosting, stacking, search and scoring."""

import math

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tallyrank.catalog import queries
from tallyrank.ml import adaboost, compare, search, split, stack, trees
from tallyrank.ml.adaboost import AdaBoostR2, AdaBoostR2Model, loss_column, reweighted, weighted_median, weighted_pairs
from tallyrank.plans import charts
from tallyrank.plans.features import FEATURES


@pytest.fixture(scope="module")
def table(spark):
    """A rating that depends on two features, with every model column present."""
    i = F.col("id")
    return spark.range(1, 401).select(
        "id", (i % 22 + 1).alias("number_in_season"), (i % 17).alias("title_len"),
        (i % 4 == 0).cast("int").alias("cycle_year"), (i % 29).cast("double").alias("mean_words"),
        (i % 31 * 3).cast("double").alias("max_words"), (i % 10 / 10).alias("group_share"),
        (i % 7).cast("double").alias("n_places"),
        (4 + i % 29 / 10 + F.when(i % 10 > 5, 2.0).otherwise(0.0)).alias("rating"),
        F.lit(1.0).alias("views"), F.lit("img").alias("image"), F.lit("vid").alias("link"),
        F.lit(1).alias("season"),
    ).cache()


@pytest.fixture(scope="module")
def fitted(table):
    return stack.stack_pipeline(
        stack.first_stage(maxIter=4), stack.second_stage(maxIter=4)
    ).fit(table)


def spread(table):
    return table.agg(F.stddev_pop("rating")).first()[0]


def test_one_round_by_hand(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (2.0,), (0.0,)], "e double")
    lost = loss_column(F.col("e"), 2.0, "linear")
    mean_loss = df.agg(F.avg(lost)).first()[0]
    beta = mean_loss / (1 - mean_loss)
    assert mean_loss == 0.25 and math.log(1 / beta) == pytest.approx(math.log(3))
    raw = [r[0] for r in df.select(reweighted(F.lit(0.25), lost, beta, 1.0)).collect()]
    assert raw == pytest.approx([1 / 12, 1 / 12, 1 / 4, 1 / 12])
    assert [w / sum(raw) for w in raw] == pytest.approx([1 / 6, 1 / 6, 1 / 2, 1 / 6])


def test_losses(spark):
    df = spark.createDataFrame([(1.0,)], "e double")
    got = [df.select(loss_column(F.col("e"), 2.0, l)).first()[0] for l in ("linear", "square", "exponential")]
    assert got == pytest.approx([0.5, 0.25, 1 - math.exp(-0.5)])
    with pytest.raises(ValueError):
        loss_column(F.col("e"), 2.0, "huber")


def test_weighted_median(spark):
    df = spark.createDataFrame([(3.0, 1.0, 2.0), (1.0, 1.0, 9.0)], "a double, b double, c double")
    columns = [F.col(c) for c in "abc"]
    for weights, want in (([1, 1, 1], [2.0, 1.0]), ([1, 1, 5], [2.0, 9.0]), ([1, 2, 1], [1.0, 1.0])):
        median = weighted_median(weighted_pairs(columns, weights), sum(weights))
        assert [r[0] for r in df.select(median).collect()] == want


def test_first_round_with_half_the_loss_is_kept_alone(spark):
    """Errors 0, 1, 2, 1 of a constant tree: mean loss one half."""
    vectors = stack.assembler(["x"]).transform(
        spark.createDataFrame([(0.0, 3.0), (0.0, 2.0), (0.0, 4.0), (0.0, 3.0)], "x double, label double")
    )
    model = AdaBoostR2(maxIter=5).fit(vectors)
    assert len(model.trees) == 1 and model.weights == [1.0]


def test_perfect_fit_stops(spark):
    vectors = stack.assembler(["x"]).transform(
        spark.createDataFrame([(float(i), float(i > 4)) for i in range(10)], "x double, label double")
    )
    model = AdaBoostR2(maxIter=5).fit(vectors)
    assert len(model.trees) == 1
    assert [r.prediction for r in model.transform(vectors).collect()] == [0.0] * 5 + [1.0] * 5


@pytest.mark.parametrize("loss", ["linear", "square", "exponential"])
def test_boosting_beats_the_mean(table, loss):
    vectors = stack.assembler().transform(table)
    model = compare.boosting(rounds=4, loss=loss, checkpointInterval=2).fit(vectors)
    assert 1 < len(model.trees) <= 4
    assert search.holdout_rmse(model, vectors, "predicted") < 0.9 * spread(table)


def test_many_trees(table):
    """More trees than are scored at once: repeating a model does not move its median."""
    vectors = stack.assembler().transform(table)
    model = compare.boosting(rounds=4).fit(vectors)
    times = 120 // len(model.trees)
    many = model._copyValues(AdaBoostR2Model(model.trees * times, model.weights * times))
    a, b = (m.transform(vectors).orderBy("id").select("predicted").collect() for m in (model, many))
    assert len(many.trees) > 100 and a == b


def test_boosting_survives_saving(table, tmp_path):
    vectors = stack.assembler().transform(table)
    model = compare.boosting(rounds=3, stepSize=0.5).fit(vectors)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = AdaBoostR2Model.load(str(tmp_path / "m"))
    assert back.weights == model.weights and back.getOrDefault("stepSize") == 0.5
    a, b = (m.transform(vectors).orderBy("id").select("predicted").collect() for m in (model, back))
    assert a == b


def test_stack_survives_saving_and_scores(spark, table, fitted, tmp_path):
    path = str(tmp_path / "stack")
    stack.save_model(fitted, path)
    titles = spark.createDataFrame([(i, f"t{i}") for i in range(1, 301)], "id long, title string")
    scored = stack.batch_score(stack.load_model(path), table, titles)
    assert scored.count() == 300 and stack.FIRST not in scored.columns
    want = fitted.transform(table).select("id", F.col("predicted").alias("p"))
    assert scored.join(want, "id").where("predicted <> p").count() == 0


def test_importances(spark, fitted):
    rows = charts.labelled_importances(stack.feature_importances(spark, fitted)).collect()
    assert {r.feature for r in rows} == {*FEATURES, stack.FIRST}
    assert sum(r.importance for r in rows) == pytest.approx(1.0)
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)


def test_out_of_fold_stack(table):
    model = stack.fit_out_of_fold(table, stack.first_stage(maxIter=2), stack.second_stage(maxIter=2), folds=2)
    assert search.holdout_rmse(model, table, "predicted") < spread(table)


def test_split_is_whole_disjoint_and_stable(table):
    train, test = split.train_test_split(table)
    a, b = ({r.id for r in part.select("id").collect()} for part in (train, test))
    assert not a & b and len(a | b) == 400 and 0.7 < len(a) / 400 < 0.9
    again = {r.id for r in split.train_test_split(table.repartition(13))[0].select("id").collect()}
    other = {r.id for r in split.train_test_split(table, salt="x")[0].select("id").collect()}
    assert again == a and other != a


def test_drawn_settings(spark):
    learner = GBTRegressor()
    space = {learner.maxDepth: [3, 4], learner.maxIter: search.Between(5, 8)}
    maps = search.draw_param_maps(space, 20, seed=1)
    assert maps == search.draw_param_maps(space, 20, seed=1)
    assert {m[learner.maxDepth] for m in maps} == {3, 4}
    assert {m[learner.maxIter] for m in maps} == {5, 6, 7}


def test_cv_rmse_is_the_root_of_the_mean_square(table):
    vectors = stack.assembler().transform(table)
    learner = compare.gradient_boosting(rounds=2)
    folds = split.with_folds(vectors, 2)
    squares = [
        search.holdout_rmse(learner.fit(folds.where(F.col("fold") != i)), folds.where(F.col("fold") == i), "predicted") ** 2
        for i in range(2)
    ]
    assert search.cv_rmse(learner, vectors, 2) == pytest.approx(math.sqrt(sum(squares) / 2))


def test_retraining_is_bounded(table):
    vectors = stack.assembler().transform(table)
    learner = compare.gradient_boosting()
    space = {learner.maxDepth: [2, 3], learner.maxIter: search.Between(1, 3)}
    found = search.retrain_until(learner, vectors, vectors, space, 0.0, max_rounds=2, draws=1, folds=2)
    assert len(found.errors) == 2 and not found.reached
    assert search.holdout_rmse(found.model, vectors, "predicted") == pytest.approx(min(found.errors))
    once = search.retrain_until(learner, vectors, vectors, space, 100.0, draws=1, folds=2)
    assert len(once.errors) == 1 and once.reached


class Counted(AdaBoostR2):
    """Boosting that counts its fits, and breaks down after some."""

    fits, most = [], 10_000

    def _fit(self, dataset):
        if len(self.fits) >= self.most:
            raise RuntimeError("broken off")
        self.fits.append(self.getOrDefault("maxIter"))
        return super()._fit(dataset)


def counted(**params):
    Counted.fits, Counted.most = [], 10_000
    return Counted(featuresCol="features", labelCol="rating", predictionCol="predicted", **params)


def test_draws_that_differ_in_rounds_share_a_fit(table):
    vectors = stack.assembler().transform(table).cache()
    learner = counted()
    settings = [{learner.maxIter: n, learner.stepSize: rate} for n, rate in ((2, 0.5), (4, 0.5), (3, 0.3), (1, 0.5))]
    scores = search.fold_scores(learner, vectors, settings, 2, "r2")
    assert sorted(Counted.fits) == [3, 3, 4, 4]
    folds = split.with_folds(vectors, 2)
    for chosen, row in zip(settings, scores):
        for fold in range(2):
            alone = search.fold_scores(learner, vectors, [chosen], 2, "r2")[0]
            assert row[fold] == pytest.approx(alone[fold])
    assert folds.count() == 400


def test_search_resumes_where_it_was_broken_off(spark, table, tmp_path):
    vectors = stack.assembler().transform(table).cache()
    learner = counted()
    space = {learner.loss: ["linear", "square"], learner.stepSize: [0.3, 0.5], learner.maxIter: search.Between(1, 4)}
    options = {"draws": 2, "folds": 2, "parallelism": 1, "store": search.Store(spark, str(tmp_path / "s"))}
    other = {**options, "store": search.Store(spark, str(tmp_path / "whole"))}
    whole = search.retrain_until(learner, vectors, vectors, space, 0.0, max_rounds=2, **other)
    needed = len(Counted.fits)
    Counted.fits, Counted.most = [], 3
    with pytest.raises(RuntimeError):
        search.retrain_until(learner, vectors, vectors, space, 0.0, max_rounds=2, **options)
    Counted.most = 10_000
    again = search.retrain_until(learner, vectors, vectors, space, 0.0, max_rounds=2, **options)
    assert len(Counted.fits) == needed and again.errors == pytest.approx(whole.errors)
    assert [s.settings for s in again.searches] == [s.settings for s in whole.searches]
    # nothing is fitted anew, unless the rows change
    search.retrain_until(learner, vectors, vectors, space, 0.0, max_rounds=2, **options)
    assert len(Counted.fits) == needed
    search.retrain_until(learner, vectors.where("id > 5"), vectors, space, 0.0, max_rounds=1, **options)
    assert len(Counted.fits) > needed


def test_best_draw():
    nan = float("nan")
    assert search.best_draw([[0.1, 0.3], [0.2, 0.3], [0.3, 0.2]], True) == 1
    assert search.best_draw([[0.1, 0.3], [nan, 0.0]], False) == 0 and search.best_draw([[nan], [0.1]], True) == 1


# --- the absolute error ---


def test_median_rounds_by_hand(spark):
    """One feature of two values, rate one half.

    Start: median of 0, 1, 2, 10, 12, 20 = 6. Residuals left -6, -5, -4: median -5; right 4, 6, 14: median 6.
    Round 2: left -3.5, -2.5, -1.5: median -2.5; right 1, 3, 11: median 3. Sum left 6 - 2.5 - 1.25, right 6 + 3 + 1.5.
    """
    rows = [(0.0, y) for y in (0.0, 1.0, 2.0)] + [(1.0, y) for y in (10.0, 12.0, 20.0)]
    vectors = stack.assembler(["x"]).transform(spark.createDataFrame(rows, "x double, rating double"))
    model = compare.median_boosting(rounds=2, stepSize=0.5, maxDepth=1).fit(vectors)
    assert model.start == 6.0
    got = {r["x"]: r["predicted"] for r in model.transform(vectors).collect()}
    assert got == {0.0: pytest.approx(2.25), 1.0: pytest.approx(10.5)}
    first = {r["x"]: r["predicted"] for r in model.upto(1).transform(vectors).collect()}
    assert first == {0.0: pytest.approx(3.5), 1.0: pytest.approx(9.0)}


def test_lower_median_of_an_even_leaf(spark):
    rows = [(0.0, 1.0)] * 3 + [(0.0, 5.0)] * 3
    vectors = stack.assembler(["x"]).transform(spark.createDataFrame(rows, "x double, rating double"))
    model = compare.median_boosting(rounds=1, stepSize=1.0).fit(vectors)
    assert model.start == 3.0 and model.transform(vectors).first()["predicted"] == 1.0


def test_median_boosting_lowers_the_absolute_error_and_survives_saving(spark, table, tmp_path):
    vectors = stack.assembler().transform(table)
    model = compare.median_boosting(rounds=6, stepSize=0.5, checkpointInterval=2).fit(vectors)

    def error(m):
        return m.transform(vectors).agg(F.avg(F.abs(F.col("rating") - F.col("predicted")))).first()[0]

    errors = [error(model.upto(n)) for n in (1, 3, 6)]
    assert errors[0] > errors[1] > errors[2]
    assert sum(model.featureImportances) == pytest.approx(1.0)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = search.Store(spark, str(tmp_path)).load("../m")
    a, b = (m.transform(vectors).orderBy("id").select("predicted").collect() for m in (model, back))
    assert a == b


def test_median_stage_in_a_stack(table):
    model = stack.stack_pipeline(stack.first_stage(maxIter=2), stack.median_stage(maxIter=3, stepSize=0.5)).fit(table)
    assert search.holdout_rmse(model, table, "predicted") < spread(table)


def test_boosting_does_not_see_how_often_rows_come(table):
    """Rows doubled: the same groups with twice the weight, so the same model."""
    vectors = stack.assembler().transform(table)
    once, twice = (compare.boosting(rounds=3).fit(v) for v in (vectors, vectors.unionByName(vectors)))
    assert once.weights == pytest.approx(twice.weights)
    assert [t.toDebugString.partition("\n")[2] for t in once.trees] == [t.toDebugString.partition("\n")[2] for t in twice.trees]


def test_comparison_has_all_models(table, fitted):
    rows = compare.compare_models(table, fitted, trees=3, rounds=2, depth=4).collect()
    assert len(rows) == 10 and len({(r.model, r.split) for r in rows}) == 10
    assert all(r.rmse < 3 for r in rows)


# --- gradient boosting in blocks ---


@pytest.mark.parametrize("loss", ["squared", "absolute"])
def test_gradient_boosting_is_that_of_mllib(table, loss):
    """On features whose values are all candidates, the same trees; many blocks and renewed sums change nothing."""
    settings = {"lossType": loss, "stepSize": 0.3, "maxIter": 7, "maxDepth": 3}
    names = ["number_in_season", "title_len", "mean_words", "n_places"]
    uneven = table.withColumn("rating", F.col("rating") + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000)
    vectors = stack.assembler(names).transform(uneven.repartition(3)).cache()
    want = GBTRegressor(featuresCol="features", labelCol="rating", predictionCol="p", **settings).fit(vectors)
    got = compare.gradient_boosting(rounds=7, checkpointInterval=2, **{k: v for k, v in settings.items() if k != "maxIter"}).fit(vectors)
    pairs = got.transform(want.transform(vectors)).select("p", "predicted").collect()
    assert [r["predicted"] for r in pairs] == pytest.approx([r["p"] for r in pairs])
    assert list(got.featureImportances) == pytest.approx(list(want.featureImportances), abs=1e-9)


def test_a_round_of_gradient_boosting_is_one_short_job_a_level(spark, table):
    vectors = stack.assembler().transform(table).cache()
    vectors.count()
    tracker = spark.sparkContext.statusTracker()

    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"rounds{rounds}", "")
        compare.gradient_boosting(rounds=rounds, lossType="absolute").fit(vectors)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(f"rounds{rounds}"))

    assert jobs(12) - jobs(2) <= 10 * 3


def test_gradient_boosting_survives_saving_and_holds_smaller_models(spark, table, tmp_path):
    vectors = stack.assembler().transform(table)
    model = compare.gradient_boosting(rounds=5, lossType="absolute").fit(vectors)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = search.Store(spark, str(tmp_path)).load("../m")
    a, b = (m.transform(vectors).orderBy("id").select("predicted").collect() for m in (model, back))
    assert a == b
    less = compare.gradient_boosting(rounds=3, lossType="absolute").fit(vectors)
    a, b = (m.transform(vectors).orderBy("id").select("predicted").collect() for m in (model.upto(3), less))
    assert a == b


# --- AdaBoost.R2 in blocks ---


def test_a_round_of_boosting_is_one_short_job_a_level_and_one_for_its_losses(spark, table):
    vectors = stack.assembler().transform(table).cache()
    vectors.count()
    tracker = spark.sparkContext.statusTracker()

    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"boosted{rounds}", "")
        model = compare.boosting(rounds=rounds).fit(vectors)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(model.trees) == rounds
        return len(tracker.getJobIdsForGroup(f"boosted{rounds}"))

    assert jobs(4) - jobs(2) <= 2 * (3 + 1)


def test_large_trees_are_scored_as_small_ones(table, monkeypatch):
    vectors = stack.assembler().transform(table)
    model = compare.boosting(rounds=3).fit(vectors)
    a = model.transform(vectors).orderBy("id").select("predicted").collect()
    monkeypatch.setattr("tallyrank.ml.adaboost.MOST_NODES", 0)
    assert a == model.transform(vectors).orderBy("id").select("predicted").collect()


# --- rows that count by a weight ---


@pytest.fixture(scope="module")
def repeated(table):
    """Rows of features of few values as they are, and equal ones once with their number."""
    tagged = split.with_folds(table, 2).select("number_in_season", "cycle_year", F.round("rating", 0).alias("rating"), "fold")
    vectors = stack.assembler(["number_in_season", "cycle_year"])
    return vectors.transform(tagged).cache(), vectors.transform(trees.equal_rows(tagged)).cache()


@pytest.mark.parametrize("learner", [compare.forest, compare.boosting, compare.gradient_boosting])
def test_weighted_rows_give_the_model_and_the_errors_of_repeated_rows(repeated, learner):
    rows, groups = repeated
    settings = {"trees": 1, "depth": 5, "bootstrap": False} if learner is compare.forest else {"rounds": 3}
    plain, weighted = learner(**settings), learner(**settings, weightCol="weight")
    assert groups.count() < rows.count() == groups.agg(F.sum("weight")).first()[0]
    pairs = weighted.fit(groups).transform(plain.fit(rows).transform(rows).withColumnRenamed("predicted", "p"))
    pairs = pairs.select("p", "predicted").collect()
    assert [r["predicted"] for r in pairs] == pytest.approx([r["p"] for r in pairs])
    assert search.cv_rmse(weighted, groups, 2) == pytest.approx(search.cv_rmse(plain, rows, 2))
    a, b = (search.holdout_rmse(m.fit(t), t, "predicted") for m, t in ((plain, rows), (weighted, groups)))
    assert a == pytest.approx(b)


def test_weighted_r2_is_that_of_repeated_rows(repeated):
    rows, groups = repeated
    plain, weighted = compare.boosting(rounds=3), compare.boosting(rounds=3, weightCol="weight")
    a, b = (search.fold_scores(m, t, [{}], 2, "r2")[0] for m, t in ((plain, rows), (weighted, groups)))
    assert a == pytest.approx(b)


# --- few distinct rows, all rounds in one task ---


def test_rounds_in_one_task_are_those_of_many_tasks(spark, table, monkeypatch):
    vectors = stack.assembler().transform(table.repartition(3)).cache()
    vectors.count()
    tracker = spark.sparkContext.statusTracker()

    def fitted(rounds, loss):
        spark.sparkContext.setJobGroup(f"{loss}{rounds}{adaboost.ROWS}", "")
        model = compare.boosting(rounds=rounds, loss=loss, checkpointInterval=2).fit(vectors)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return model, len(tracker.getJobIdsForGroup(f"{loss}{rounds}{adaboost.ROWS}"))

    for loss in adaboost.LOSSES:
        (near, jobs), (_, fewer) = fitted(6, loss), fitted(2, loss)
        assert jobs == fewer and len(near.trees) == 6
        with monkeypatch.context() as patched:
            patched.setattr(adaboost, "ROWS", 150)
            spread, more = fitted(6, loss)
        assert more > jobs
        assert near.weights == pytest.approx(spread.weights)
        a, b = (m.transform(vectors).orderBy("id").select("predicted").collect() for m in (near, spread))
        assert [r["predicted"] for r in a] == pytest.approx([r["predicted"] for r in b])


def test_the_search_draws_from_the_whole_range_of_rounds(spark, sf_dir, monkeypatch):
    spaces = []
    monkeypatch.setattr(search, "random_search", lambda _, train, space, **options: spaces.append(space) or search.Search([], [], 0, None))
    queries.random_search(spark, sf_dir)
    assert search.Between(*search.BOOST_ROUNDS) in spaces[0].values()

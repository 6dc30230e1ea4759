import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ridecast.operators import sampling
from ridecast.operators.metrics import regression_scores
from ridecast.plans import prepare, scoring, search
from ridecast.plans import training as ml
from ridecast.schemas import FEATURES, REQUEST, TARGET, TRIPS
from ridecast.streaming.requests import score_stream
from tests import fixtures as fx

SMALL = ml.BoostParams(10, 4, 0.3, 1.0, 0, 1, "squared")


@pytest.fixture(scope="module")
def table(spark):
    """A non-linear target on plausible features."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        average, rain = float(rng.uniform(5, 30)), float(rng.exponential(0.2) * (rng.random() < 0.3))
        member, trace, dow = int(rng.random() < 0.6), int(rng.random() < 0.1), int(rng.integers(0, 7))
        y = 10 + 0.3 * average - 4 * member + (8 if dow >= 5 and not member else 0) - 5 * (rain > 0.1) * (average > 15)
        angle = 2 * np.pi * dow / 7
        rows.append((i, average, rain, member, float(np.sin(angle)), float(np.cos(angle)), trace, float(y + rng.normal(0, 1))))
    ddl = "seq_id INT, avg_duration_prev_7days DOUBLE, HPCP DOUBLE, is_registered INT, dow_sin DOUBLE, dow_cos DOUBLE, has_trace INT, duration_min DOUBLE"
    return spark.createDataFrame(rows, ddl).repartition(4).cache()


@pytest.fixture(scope="module")
def parts(table):
    return sampling.train_test(table, ["seq_id"], 0.2, 1)


@pytest.fixture(scope="module")
def trees(parts):
    return ml.fit_trees(parts[0], SMALL)


def matrix(df):
    pdf = df.orderBy("seq_id").toPandas()
    x = pdf[list(FEATURES)].to_numpy(float)
    x[:, 0] = (x[:, 0] - x[:, 0].mean()) / x[:, 0].std()
    x[:, 1] = np.log1p(x[:, 1])
    return x, pdf[TARGET].to_numpy()


def coordinate_descent(x, y, alpha, ratio):
    """1/(2n) |y - Xw - b|^2 + alpha ratio |w|_1 + alpha (1 - ratio) / 2 |w|^2."""
    n, center = len(y), x.mean(axis=0)
    xc, yc, w = x - center, y - y.mean(), np.zeros(x.shape[1])
    for _ in range(5000):
        for j in range(x.shape[1]):
            rest = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / n
            w[j] = np.sign(rest) * max(abs(rest) - alpha * ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - ratio))
    return w, y.mean() - center @ w


@pytest.mark.parametrize("alpha,ratio", [(0.1, 0.5), (0.5, 0.2), (0.3, 1.0), (0.4, 0.0)])
def test_elastic_net_matches_coordinate_descent(spark, table, alpha, ratio):
    model = ml.fit_elastic_net(table, alpha, ratio)
    w, intercept = coordinate_descent(*matrix(table), alpha, ratio)
    got = {r.feature: r.coefficient for r in ml.coefficients(model, spark).collect()}
    assert [got[name] for name in FEATURES] == pytest.approx(list(w), abs=1e-6)
    assert got["intercept"] == pytest.approx(intercept, abs=1e-6)


def test_feature_vector(table):
    vectors = Pipeline(stages=ml.feature_stages()).fit(table).transform(table)
    got = np.array([r.v for r in vectors.orderBy("seq_id").select(vector_to_array("features").alias("v")).collect()])
    assert np.allclose(got, matrix(table)[0])


def test_population_scaler_and_inverse(frame):
    df = frame([(1.0,), (2.0,), (6.0,)], "x DOUBLE")
    stages = [
        ml.PopulationScaler(inputCol="x", outputCol="z"),
        ml.PopulationScaler(inputCol="z", outputCol="back", fitted_on="x", inverse=True),
    ]
    rows = Pipeline(stages=stages).fit(df).transform(df).collect()
    assert np.std([r.z for r in rows]) == pytest.approx(1.0)
    assert [r.back for r in rows] == pytest.approx([r.x for r in rows])
    flat = frame([(5.0,), (5.0,)], "x DOUBLE")
    assert {r.z for r in ml.PopulationScaler(inputCol="x", outputCol="z").fit(flat).transform(flat).collect()} == {0.0}
    with pytest.raises(ValueError):
        ml.PopulationScaler(inputCol="x", outputCol="z").fit(frame([(None,)], "x DOUBLE"))


def test_scaling_is_fitted_on_the_training_part(parts):
    train, test = parts
    fitted = Pipeline(stages=ml.feature_stages()).fit(train)
    mean = fitted.transform(test).agg(F.avg(ml.SCALED)).first()[0]
    assert mean != 0.0
    assert fitted.transform(train).agg(F.avg(ml.SCALED)).first()[0] == pytest.approx(0.0, abs=1e-9)


def test_null_feature_is_refused(spark, trees):
    bad = spark.createDataFrame([(None, 0.0, 1, 0.0, 1.0, 0)], "avg_duration_prev_7days DOUBLE, HPCP DOUBLE, is_registered INT, dow_sin DOUBLE, dow_cos DOUBLE, has_trace INT")
    with pytest.raises(Exception):
        trees.transform(bad).collect()


def test_trees_beat_linear_beats_baseline(parts, trees):
    train, test = parts
    score = lambda df: regression_scores(df, TARGET, "prediction").first()
    baseline, linear = score(ml.baseline(test)), score(ml.predict(test, ml.fit_elastic_net(train)))
    boosted = score(ml.predict(test, trees))
    assert boosted.rmse < linear.rmse < baseline.rmse
    assert boosted.r2 > linear.r2


@pytest.mark.parametrize("params", [ml.SQUARED_TREES, ml.ABSOLUTE_TREES, ml.TUNED_TREES, ml.PLAIN_TREES])
def test_parameter_mapping(spark, params):
    trees = ml.boosted_trees(params, rows=2000)
    assert (trees.getMaxIter(), trees.getMaxDepth()) == (params.n_estimators, params.max_depth)
    assert trees.getStepSize() == params.learning_rate / (2 if params.loss == "squared" else 1)
    assert trees.getLossType() == params.loss and trees.getMinInstancesPerNode() >= 1
    assert trees.getSubsamplingRate() == params.subsample and trees.getMinInfoGain() == 2 * params.gamma / 2000


def test_studied_sets_keep_splitting_and_beat_the_linear_model(spark):
    """Boosting goes on after the first tree where that leaves something to explain: sums of waves
    over two features have more cells than a tree of depth ten has leaves."""
    rows = spark.range(12_000).select(
        F.col("id").alias("seq_id"),
        (F.rand(1) * 25 + 5).alias(FEATURES[0]),
        F.rand(3).alias("HPCP"),
        (F.rand(4) < 0.6).cast("int").alias("is_registered"),
        (F.col("id") % 7).alias("dow"),
        (F.rand(5) < 0.1).cast("int").alias("has_trace"),
    )
    average, weekend = F.col(FEATURES[0]), (F.col("dow") >= 5).cast("int")
    waves = 6 * F.sin(average * 2) + 6 * F.sin(F.col("HPCP") * 50)
    target = 30 + 0.5 * average - 4 * F.col("is_registered") + 6 * weekend * (1 - F.col("is_registered")) + waves
    table = prepare.with_weekday_cycle(rows).withColumn(TARGET, target + F.randn(6) / 2).repartition(4).cache()
    train, test = sampling.train_test(table, ["seq_id"], 0.2, 1)
    score = lambda df: regression_scores(df.select(TARGET, "prediction").cache(), TARGET, "prediction").first()
    scores = {}
    for name, params in (("squared", ml.SQUARED_TREES), ("absolute", ml.ABSOLUTE_TREES), ("tuned", ml.TUNED_TREES)):
        model = ml.fit_trees(train, params)
        growing = [tree.numNodes > 1 for tree in model.stages[-1].trees]
        print(name, [tree.numNodes for tree in model.stages[-1].trees])
        assert sum(growing) > len(growing) / 2, name
        scores[name] = score(ml.predict(test, model))
    linear = score(ml.predict(test, ml.fit_elastic_net(train)))
    assert scores["tuned"].mae < linear.mae < score(ml.baseline(test)).mae


def test_save_and_load(spark, parts, trees, tmp_path):
    path = str(tmp_path / "model")
    ml.save_model(trees, path)
    loaded = ml.load_model(path)
    rows = lambda model: sorted(tuple(r) for r in ml.predict(parts[1], model).select("seq_id", "prediction").collect())
    assert rows(loaded) == rows(trees)


def test_feature_use_counts_splits(spark, trees):
    got = {r.feature: r.splits for r in ml.feature_use(trees, spark).collect()}
    assert list(got) and set(got) == set(FEATURES)
    expected = sum(tree.numNodes - (tree.numNodes + 1) // 2 for tree in trees.stages[-1].trees)
    assert sum(got.values()) == expected  # inner nodes of binary trees


def test_parameter_draw(spark):
    grid = search.parameter_grid(spark)
    assert grid.count() == 864
    drawn = search.draw_parameters(grid)
    rows = {tuple(r) for r in drawn.collect()}
    assert len(rows) == 60 and rows <= {tuple(r) for r in grid.collect()}
    assert rows == {tuple(r) for r in search.draw_parameters(grid.repartition(5)).collect()}
    assert rows != {tuple(r) for r in search.draw_parameters(grid, seed=1).collect()}


def test_random_search_and_refit(spark, table, tmp_path):
    grid = search.parameter_grid(spark, {
        "n_estimators": [2, 5], "max_depth": [2], "learning_rate": [0.1, 0.5], "subsample": [1.0], "gamma": [0], "min_child_weight": [1],
    })
    drawn = search.draw_parameters(grid, 3)
    folds = sampling.hash_folds(table, ["seq_id"], 2)
    scores = search.random_search(folds, drawn).cache()
    assert scores.count() == 6
    results = search.search_results(scores)
    assert results.count() == 3
    one = results.first()
    mine = [r.mae for r in scores.collect() if (r.n_estimators, r.learning_rate) == (one.regressor__n_estimators, one.regressor__learning_rate)]
    assert (one.mae_avg, one.mae_std) == pytest.approx((np.mean(mine), np.std(mine)))
    # A fold's score is the score of a model fitted without it.
    params = drawn.first().asDict()
    model = ml.fit_trees(folds.where("fold <> 0"), ml.BoostParams(**params))
    direct = regression_scores(model.transform(folds.where("fold = 0")), TARGET, "prediction").first()
    same = scores.where(" AND ".join(f"{k} = {v}" for k, v in params.items()) + " AND fold = 0").first()
    assert same.mae == pytest.approx(direct.mae)
    best = search.refit_best(table, results)
    least = min(r.mae_avg for r in results.collect())
    winner = [r for r in results.collect() if r.mae_avg == least][0]
    assert best.stages[-1].getNumTrees == winner.regressor__n_estimators


REQUESTS = [
    (1, "13.5", "0.2", "5", "false", "false"),
    (2, None, "0.2", "5", "true", "false"),
    (3, "13.5", "-0.1", "5", "true", "false"),
    (4, "13.5", "0.1", "7", "true", "false"),
    (5, "13.5", "0.1", "-1", "true", "false"),
    (6, "13.5", "0.1", "2.5", "maybe", None),
    (7, "0", "0", "0", "1", "no"),
    (8, "-3", "-2", "9", None, "x"),
]


def test_validation_reasons(spark):
    got = {r.request_id: r for r in scoring.validate(spark.createDataFrame(REQUESTS, REQUEST)).collect()}
    assert {i for i, r in got.items() if r.is_valid} == {1, 7}
    assert got[2].reasons == ["avg_duration_prev_7days: missing"]
    assert got[3].reasons == ["HPCP: below 0"]
    assert got[4].reasons == got[5].reasons == ["dow: not in 0..6"]
    assert got[6].reasons == ["dow: not valid", "is_registered: not valid", "has_trace: missing"]
    assert len(got[8].reasons) == 5
    assert (got[7].is_registered, got[7].has_trace, got[7].dow) == (True, False, 0)
    raw = scoring.validate(spark.createDataFrame(REQUESTS, REQUEST))
    assert scoring.accepted(raw).count() == 2 and scoring.rejected(raw).count() == 6


def test_request_features_equal_the_training_features(spark):
    df = scoring.request_features(scoring.accepted(scoring.validate(spark.createDataFrame(REQUESTS, REQUEST))))
    row = df.where("request_id = 1").first()
    assert (row.dow_sin, row.dow_cos) == pytest.approx((np.sin(2 * np.pi * 5 / 7), np.cos(2 * np.pi * 5 / 7)))
    assert (row.is_registered, row.has_trace) == (0, 0) and set(FEATURES) <= set(df.columns)


def test_scores_keep_every_request(spark, trees):
    scored = {r.request_id: r for r in scoring.score(spark.createDataFrame(REQUESTS, REQUEST), trees).collect()}
    assert scored.keys() == set(range(1, 9))
    assert {i for i, r in scored.items() if r.duration is not None} == {1, 7}
    features = scoring.request_features(scoring.accepted(scoring.validate(spark.createDataFrame(REQUESTS, REQUEST))))
    for row in trees.transform(features).collect():
        assert scored[row.request_id].duration == row.prediction


def test_stream_equals_batch_and_resumes(spark, trees, tmp_path):
    raw = spark.createDataFrame(REQUESTS * 20, REQUEST)
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    raw.repartition(5).write.json(source)
    score_stream(spark, trees, source, sink, state, files_per_trigger=2).awaitTermination()
    batch = sorted(map(str, scoring.score(raw, trees).collect()))
    assert sorted(map(str, spark.read.parquet(sink).drop("raw").collect())) == batch
    # New files continue from the checkpoint: old requests are not scored again.
    spark.createDataFrame([(99, "10", "0", "1", "true", "false")], REQUEST).write.mode("append").json(source)
    score_stream(spark, trees, source, sink, state).awaitTermination()
    again = spark.read.parquet(sink)
    assert again.count() == len(batch) + 1 and again.where("request_id = 99").count() == 1


def test_preparation_of_arriving_trips(spark, tmp_path):
    """The stateless part of the preparation runs on a stream as it does on a table."""
    raw = spark.createDataFrame(fx.edge_trips() + fx.station_trips(), fx.TRIP_DDL)
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    raw.write.json(source)
    arriving = prepare.typed_trips(spark.readStream.schema(TRIPS).json(source))
    arriving.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(sink).awaitTermination()
    columns = ["seq_id", "start_date", "strt_statn", "duration_min", "is_registered"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(spark.read.parquet(sink)) == rows(prepare.typed_trips(raw))


def test_training_rows_of_one_file_are_dealt_to_tasks(parts, monkeypatch):
    seen, fit = [], ml.GBTRegressor.fit

    def counted(self, dataset, params=None):
        seen.append(dataset.rdd.getNumPartitions())
        return fit(self, dataset)

    monkeypatch.setattr(ml.GBTRegressor, "fit", counted)
    train = parts[0].coalesce(1)
    plain = ml.fit_trees(train, ml.BoostParams(2, 2, 0.5))
    rows = train.count()
    monkeypatch.setattr(ml, "TASK_ROWS", -(-rows // 6))
    dealt = ml.fit_trees(train, ml.BoostParams(2, 2, 0.5))
    assert seen == [1, 6]
    assert [type(s) for s in dealt.stages] == [type(s) for s in plain.stages]
    assert ml.predict(train, dealt).count() == rows

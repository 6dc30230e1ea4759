"""Scaling, fitted models, search and scoring on the cleaned training table."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ridecast.functions.flags import fixed_point
from ridecast.operators import sampling
from ridecast.operators.metrics import regression_scores, stack_scores
from ridecast.plans import scoring
from ridecast.plans import training as ml
from ridecast.schemas import FEATURES, METRICS, TARGET
from ridecast.session import kept_path, new_shared_path, written_once
from ridecast.sources import driver_tables as src
from ridecast.streaming.requests import score_stream
from ridecast_queries.preparation import cleaned, with_fixed
from ridecast_queries.registry import fp, query
from ridecast_queries.scoring import written_requests
from ridecast_queries.tables import share_sql

_KEY = ["seq_id"]


def model_table(spark, sf):
    """The cleaned training table, written once because every fit reads it many times."""
    return written_once(spark, "model-table", sf, lambda: cleaned(spark, sf).select("seq_id", *FEATURES, TARGET))


_SETS = {"squared": ml.SQUARED_TREES, "absolute": ml.ABSOLUTE_TREES, "tuned": ml.TUNED_TREES, "plain": ml.PLAIN_TREES}


def fitted(spark, sf, name):
    """A model fitted once on the training part, saved in the shared folder and loaded from there."""

    def build(path):
        train = split(spark, sf)[0]
        ml.save_model(ml.fit_elastic_net(train) if name == "linear" else ml.fit_trees(train, _SETS[name]), path)

    return ml.load_model(kept_path(spark, f"{name}-model", sf, build))


def split(spark, sf):
    return sampling.train_test(model_table(spark, sf), _KEY, 0.2, ml.SEED)


@query(
    "standardise",
    f"""SELECT c.seq_id, {fp("(c.avg_duration_prev_7days - s.m) / s.d", ml.SCALED)}
        FROM cleaned c CROSS JOIN (SELECT avg(avg_duration_prev_7days) AS m, stddev_pop(avg_duration_prev_7days) AS d
                                   FROM cleaned) s""",
)
def standardise(spark, sf):
    df = model_table(spark, sf)
    scaler = ml.PopulationScaler(inputCol=FEATURES[0], outputCol=ml.SCALED)
    return with_fixed(scaler.fit(df).transform(df).select("seq_id", ml.SCALED), ml.SCALED)


@query(
    "target_scaling_roundtrip",
    f"""SELECT c.seq_id, {fp("(c.duration_min - s.m) / s.d", "scaled")}, {fp("c.duration_min", "restored")}
        FROM cleaned c CROSS JOIN (SELECT avg(duration_min) AS m, stddev_pop(duration_min) AS d FROM cleaned) s""",
)
def target_scaling_roundtrip(spark, sf):
    df = model_table(spark, sf)
    stages = [
        ml.PopulationScaler(inputCol=TARGET, outputCol="scaled"),
        ml.PopulationScaler(inputCol="scaled", outputCol="restored", fitted_on=TARGET, inverse=True),
    ]
    both = Pipeline(stages=stages).fit(df).transform(df)
    return with_fixed(both.select("seq_id", "scaled", "restored"), "scaled", "restored")


_VECTOR_SQL = ", ".join(
    [
        fp("(c.avg_duration_prev_7days - s.m) / s.d", ml.SCALED),
        fp('ln(1 + c."HPCP")', ml.LOGGED),
        "CAST(c.is_registered AS DOUBLE) AS is_registered",
        fp("c.dow_sin", "dow_sin"),
        fp("c.dow_cos", "dow_cos"),
        "CAST(c.has_trace AS DOUBLE) AS has_trace",
    ]
)


@query(
    "pipeline_features",
    f"""SELECT c.seq_id, {_VECTOR_SQL}
        FROM cleaned c CROSS JOIN (SELECT avg(avg_duration_prev_7days) AS m, stddev_pop(avg_duration_prev_7days) AS d
                                   FROM cleaned) s""",
)
def pipeline_features(spark, sf):
    df = model_table(spark, sf)
    vectors = Pipeline(stages=ml.feature_stages()).fit(df).transform(df)
    values = vectors.select("seq_id", vector_to_array("features").alias("v"))
    columns = values.select("seq_id", *[F.col("v")[i].alias(name) for i, name in enumerate(ml.VECTOR_INPUTS)])
    return with_fixed(columns, ml.SCALED, ml.LOGGED, "dow_sin", "dow_cos")


def _elastic_net_sql() -> str:
    """Coordinate descent on the covariances of the training part, as common table expressions."""
    n = range(1, 7)
    columns = ['ln(1 + "HPCP")', "is_registered", "dow_sin", "dow_cos", "has_trace"]
    x = ", ".join(["(avg_duration_prev_7days - m) / d AS x1", *[f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(columns, 2)]])
    pairs = [(i, j) for i in n for j in n if i <= j]
    covariances = ", ".join([f"covar_pop(x{i}, x{j}) AS c{i}{j}" for i, j in pairs] + [f"covar_pop(x{i}, y) AS r{i}, avg(x{i}) AS a{i}" for i in n])
    steps = []
    for i in n:
        # Coefficients that this round has changed already are `u`, the others `w`.
        rest = " - ".join([f"r{i}", *[f"c{min(i, k)}{max(i, k)} * {'u' if k < i else 'w'}{k}" for k in n if k != i]])
        steps.append(f"sign({rest}) * greatest(abs({rest}) - CAST(0.05 AS DOUBLE), 0) / (c{i}{i} + CAST(0.05 AS DOUBLE)) AS u{i}")
    return f"""WITH RECURSIVE marked AS (SELECT *, {share_sql("split", seed=ml.SEED)} < CAST(0.2 AS DOUBLE) AS test FROM cleaned),
        s AS (SELECT avg(avg_duration_prev_7days) AS m, stddev_pop(avg_duration_prev_7days) AS d FROM marked WHERE NOT test),
        f AS (SELECT seq_id, test, duration_min AS y, {x} FROM marked CROSS JOIN s),
        g AS (SELECT {covariances}, avg(y) AS ay FROM f WHERE NOT test),
        cd(step, {", ".join(f"w{i}" for i in n)}) AS (
          SELECT 0, {", ".join("CAST(0 AS DOUBLE)" for _ in n)}
          UNION ALL SELECT step + 1, {", ".join(steps)} FROM cd CROSS JOIN g WHERE step < 400),
        fit AS (SELECT cd.*, ay - ({" + ".join(f"w{i} * a{i}" for i in n)}) AS b FROM cd CROSS JOIN g WHERE step = 400)"""


def _rounded(expression: str, name: str, digits: int) -> str:
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"floor(({expression}) * {scale} + CAST(0.5 AS DOUBLE)) / {scale} AS {name}"


def _sum_sql() -> str:
    return " + ".join(["b", *[f"w{i} * x{i}" for i in range(1, 7)]])


@query(
    "elastic_net_predict",
    f"""{_elastic_net_sql()} SELECT seq_id, y AS duration_min, {_rounded(_sum_sql(), "prediction", 2)} FROM f CROSS JOIN fit WHERE test""",
)
def elastic_net_predict(spark, sf):
    """Predictions at two decimals: the two solvers end within 1e-6 of each other."""
    train, test = split(spark, sf)
    predicted = ml.predict(test, ml.fit_elastic_net(train)).select("seq_id", TARGET, "prediction")
    return predicted.withColumn("prediction", fixed_point(F.col("prediction"), 2))


@query(
    "elastic_net_one_feature",
    f"""WITH z AS (SELECT duration_min AS y, (avg_duration_prev_7days - avg(avg_duration_prev_7days) OVER ())
                         / stddev_pop(avg_duration_prev_7days) OVER () AS x FROM cleaned),
            c AS (SELECT covar_pop(x, y) AS xy, var_pop(x) AS xx, avg(y) AS y FROM z)
       SELECT {fp("sign(xy) * greatest(abs(xy) - CAST(0.05 AS DOUBLE), 0) / (xx + CAST(0.05 AS DOUBLE))", "coefficient")},
              {fp("y", "intercept")} FROM c""",
)
def elastic_net_one_feature(spark, sf):
    """With one standardised feature the solution is a soft threshold, which SQL can say."""
    df = model_table(spark, sf)
    stages = [
        ml.PopulationScaler(inputCol=FEATURES[0], outputCol=ml.SCALED),
        VectorAssembler(inputCols=[ml.SCALED], outputCol="features"),
        ml.ElasticNet(alpha=0.1, l1Ratio=0.5),
    ]
    linear = Pipeline(stages=stages).fit(df).stages[-1]
    row = [(float(linear.coefficients[0]), float(linear.intercept))]
    fitted = spark.createDataFrame(row, "coefficient DOUBLE, intercept DOUBLE")
    return with_fixed(fitted, "coefficient", "intercept")


@query(
    "one_split_tree",
    f"""SELECT is_registered, count(*) AS trips, {fp("avg(duration_min)", "prediction")} FROM cleaned GROUP BY 1""",
)
def one_split_tree(spark, sf):
    """One tree with one split on a flag predicts the mean of either side."""
    df = model_table(spark, sf)
    trees = ml.boosted_trees(ml.BoostParams(1, 1, 0.5), df.count())
    stages = [VectorAssembler(inputCols=["is_registered"], outputCol="features"), trees]
    scored = ml.predict(df, Pipeline(stages=stages).fit(df))
    sides = scored.groupBy("is_registered", "prediction").agg(F.count(F.lit(1)).alias("trips"))
    return with_fixed(sides, "prediction")


_NAMED = [*[(name, f"w{i}") for i, name in enumerate(FEATURES, 1)], ("intercept", "b")]


@query(
    "elastic_net_coefficients",
    _elastic_net_sql() + " " + " UNION ALL ".join(f"SELECT '{name}' AS feature, {_rounded(w, 'coefficient', 4)} FROM fit" for name, w in _NAMED),
)
def elastic_net_coefficients(spark, sf):
    fitted_here = ml.coefficients(ml.fit_elastic_net(split(spark, sf)[0]), spark)
    return fitted_here.withColumn("coefficient", fixed_point(F.col("coefficient"), 4))


@query(
    "two_split_trees",
    f"""WITH a AS (SELECT is_registered AS r, avg(duration_min) AS m FROM cleaned GROUP BY 1)
        SELECT is_registered, count(*) AS trips, {fp("any_value(m)", "prediction")}
        FROM cleaned JOIN a ON is_registered = r GROUP BY 1""",
)
def two_split_trees(spark, sf):
    """The first tree leaves no residual on a flag, so a second one changes nothing."""
    df = model_table(spark, sf)
    return _flag_trees(df, ml.BoostParams(2, 1, 0.5), ["is_registered"])


def _flag_trees(df, params, features):
    stages = [VectorAssembler(inputCols=features, outputCol="features"), ml.boosted_trees(params, df.count())]
    scored = ml.predict(df, Pipeline(stages=stages).fit(df))
    sides = scored.groupBy(*features, "prediction").agg(F.count(F.lit(1)).alias("trips"))
    return with_fixed(sides, "prediction")


# Two flags that every trip has; a depth of one makes each tree a split on one of them.
_FLAGS = "(SELECT CAST(seq_id % 2 AS INTEGER) AS a, CAST(seq_id % 3 = 0 AS INTEGER) AS b, 8.0 * (seq_id % 2) + 3.0 * CAST(seq_id % 3 = 0 AS INTEGER) AS y FROM cleaned)"


def _flagged(spark, sf):
    key = F.col("seq_id")
    a, b = (key % 2).cast("int"), (key % 3 == 0).cast("int")
    return model_table(spark, sf).select("seq_id", a.alias("a"), b.alias("b"), (a * 8.0 + b * 3.0).alias(TARGET))


@query(
    "shrunken_second_tree",
    f"""WITH t AS (SELECT *, avg(y) OVER (PARTITION BY a) AS first FROM {_FLAGS} f),
            u AS (SELECT *, avg(y - first) OVER (PARTITION BY b) AS second FROM t)
       SELECT a, b, count(*) AS trips, {fp("any_value(first + CAST(0.3 AS DOUBLE) * second)", "prediction")} FROM u GROUP BY 1, 2""",
)
def shrunken_second_tree(spark, sf):
    """The second tree adds its mean residual times the learning rate."""
    return _flag_trees(_flagged(spark, sf), ml.BoostParams(2, 1, 0.3), ["a", "b"])


_GAIN = f"""WITH g AS (SELECT count(*) * (var_pop(y) - avg(v)) / 2 AS total
                      FROM (SELECT y, var_pop(y) OVER (PARTITION BY a) AS v FROM {_FLAGS} f) x)"""


@query(
    "split_at_gamma",
    f"""SELECT side, CASE WHEN side = 'below' THEN CAST(3 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS nodes,
              {fp("total * CASE WHEN side = 'below' THEN CAST(0.99 AS DOUBLE) ELSE CAST(1.01 AS DOUBLE) END", "gamma")}
       FROM ({_GAIN} SELECT total FROM g) t, (VALUES ('below'), ('above')) s(side)""",
)
def split_at_gamma(spark, sf):
    """A split is made just below its total reduction of the loss, and not just above."""
    df = _flagged(spark, sf).select("a", TARGET)
    sides = df.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.var_pop(TARGET).alias("v")).agg(F.sum(F.col("n") * F.col("v")), F.sum("n")).first()
    n = sides[1]
    total = (n * df.agg(F.var_pop(TARGET)).first()[0] - sides[0]) / 2
    rows = []
    for side, gamma in (("below", total * 0.99), ("above", total * 1.01)):
        stages = [VectorAssembler(inputCols=["a"], outputCol="features"), ml.boosted_trees(ml.BoostParams(1, 1, 0.5, gamma=gamma), n)]
        tree = Pipeline(stages=stages).fit(df).stages[-1].trees[0]
        rows.append((side, tree.numNodes, float(gamma)))
    return with_fixed(spark.createDataFrame(rows, "side STRING, nodes BIGINT, gamma DOUBLE"), "gamma")


def _scores_of(spark, sf, name):
    """Scores on the test part and on the training part, to see overfitting."""
    parts = sampling.with_split(model_table(spark, sf), _KEY, 0.2, ml.SEED)
    scored = ml.baseline(parts) if name == "baseline" else ml.predict(parts, fitted(spark, sf, name))
    pairs = scored.select("split", TARGET, "prediction").persist()
    scores = regression_scores(pairs, TARGET, "prediction", ["split"])
    return scores.select(F.lit(name).alias("model"), *scores.columns)


@query("trees_squared")
def trees_squared(spark, sf):
    return _scores_of(spark, sf, "squared")


@query("trees_absolute")
def trees_absolute(spark, sf):
    return _scores_of(spark, sf, "absolute")


@query("trees_tuned")
def trees_tuned(spark, sf):
    return _scores_of(spark, sf, "tuned")


@query("trees_plain")
def trees_plain(spark, sf):
    return _scores_of(spark, sf, "plain")


@query("model_comparison")
def model_comparison(spark, sf):
    """Baseline, linear, squared and tuned model, each on the test and the training part."""
    tables = [_scores_of(spark, sf, name) for name in ("baseline", "linear", "squared", "tuned")]
    return stack_scores(*[t.select(F.concat_ws(" ", "model", "split").alias("id"), *METRICS) for t in tables])


@query("feature_use")
def feature_use(spark, sf):
    return ml.feature_use(fitted(spark, sf, "tuned"), spark)


@query(
    "model_roundtrip",
    f"""SELECT count(*) AS trips, CAST(0 AS BIGINT) AS changed FROM cleaned
        WHERE {share_sql("split", seed=ml.SEED)} < CAST(0.2 AS DOUBLE)""",
)
def model_roundtrip(spark, sf):
    """How many predictions a saved and loaded model changes."""
    train, test = split(spark, sf)
    model, path = ml.fit_elastic_net(train), new_shared_path(spark, "model")
    ml.save_model(model, path)
    both = ml.predict(test, model).withColumnRenamed("prediction", "_before")
    both = ml.predict(both, ml.load_model(path))
    changed = F.count_if(~F.col("_before").eqNullSafe(F.col("prediction")))
    return both.agg(F.count(F.lit(1)).alias("trips"), changed.alias("changed"))


@query("batch_scoring")
def batch_scoring(spark, sf):
    model = fitted(spark, sf, "tuned")
    return scoring.score(src.requests(spark, sf), model)


_OUTCOME_SQL = "SELECT request_id, reasons = '' AS is_scored, reasons FROM checked"


def outcome(scored):
    """Which requests got a duration, and why the others did not."""
    return scored.select(
        "request_id", F.col("duration").isNotNull().alias("is_scored"), F.array_join("reasons", "; ").alias("reasons")
    )


@query("batch_scoring_outcome", _OUTCOME_SQL)
def batch_scoring_outcome(spark, sf):
    return outcome(batch_scoring(spark, sf))


@query("stream_scoring_outcome", _OUTCOME_SQL)
def stream_scoring_outcome(spark, sf):
    return outcome(stream_scoring(spark, sf))


@query("stream_scoring")
def stream_scoring(spark, sf):
    model = fitted(spark, sf, "tuned")
    sink = new_shared_path(spark, "scored")
    score_stream(spark, model, written_requests(spark, sf), sink, new_shared_path(spark, "scored-state")).awaitTermination()
    return spark.read.parquet(sink)

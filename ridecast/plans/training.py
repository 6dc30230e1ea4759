"""Feature pipeline, regressors with the studied parameters, and model tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridecast.schemas import FEATURES, TARGET
from ridecast.session import ensure_checkpoint_dir, new_shared_path

SEED = 78239  # fixed value: the seed of the studies
#: Training rows that one task takes.
TASK_ROWS = 250_000
SCALED, LOGGED = "avg_duration_prev_7days_scaled", "HPCP_log"
# The vector keeps the order of FEATURES.
VECTOR_INPUTS = (SCALED, LOGGED, *FEATURES[2:])


def _mean_and_scale(df: DataFrame, column: str) -> tuple[float, float]:
    """Mean and population standard deviation; a constant column gets scale 1."""
    mean, std = df.agg(F.avg(column), F.stddev_pop(column)).first()
    if mean is None:
        raise ValueError(f"{column} has no values to scale")
    return mean, std or 1.0


class PopulationScaler(Estimator, HasInputCol, HasOutputCol):
    """Standardise a column with its mean and *population* standard deviation.

    Spark ML's own scaler divides by the sample deviation. The fitted stage is a plain
    SQLTransformer, so a fitted pipeline saves and loads like any other. `inverse` maps
    scaled values back.
    """

    inverse = Param(Params._dummy(), "inverse", "map scaled values back", TypeConverters.toBoolean)
    fitted_on = Param(Params._dummy(), "fitted_on", "column to take mean and deviation from", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, inverse=False, fitted_on=None):
        super().__init__()
        self._setDefault(inverse=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> Transformer:
        source = self.getOrDefault(self.fitted_on) if self.isSet(self.fitted_on) else self.getInputCol()
        mean, scale = _mean_and_scale(dataset, source)
        column = f"`{self.getInputCol()}`"
        if self.getOrDefault(self.inverse):
            formula = f"{column} * {scale!r}D + {mean!r}D"
        else:
            formula = f"({column} - {mean!r}D) / {scale!r}D"
        return SQLTransformer(statement=f"SELECT *, {formula} AS `{self.getOutputCol()}` FROM __THIS__")


class ElasticNet(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Elastic net with the (alpha, l1_ratio) convention on the unscaled label.

    Spark's normal solver (one pass over the data, for a few features) divides the label
    by its population deviation before it regularises, which leaves the L1 part as it is
    and divides the L2 part by that deviation; the parameters are mapped accordingly.
    """

    alpha = Param(Params._dummy(), "alpha", "overall strength", TypeConverters.toFloat)
    l1Ratio = Param(Params._dummy(), "l1Ratio", "share of the L1 part", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, alpha=0.1, l1Ratio=0.5, featuresCol="features", labelCol=TARGET, predictionCol="prediction"):
        super().__init__()
        self._set(**{"alpha": 0.1, "l1Ratio": 0.5, "labelCol": TARGET, **self._input_kwargs})

    def _fit(self, dataset: DataFrame) -> LinearRegressionModel:
        alpha, ratio = self.getOrDefault(self.alpha), self.getOrDefault(self.l1Ratio)
        spread = dataset.agg(F.stddev_pop(self.getLabelCol())).first()[0] or 1.0
        l1, l2 = alpha * ratio, alpha * (1.0 - ratio) * spread
        strength = l1 + l2
        return LinearRegression(
            featuresCol=self.getFeaturesCol(),
            labelCol=self.getLabelCol(),
            predictionCol=self.getPredictionCol(),
            regParam=strength,
            elasticNetParam=l1 / strength if strength else 0.0,
            standardization=False,
            solver="normal",
            maxIter=1000,
            tol=1e-9,
        ).fit(dataset)


def feature_stages(handle_invalid: str = "error") -> list:
    """Scaled average, log of the rain, the rest as it is, assembled in a fixed order."""
    return [
        PopulationScaler(inputCol=FEATURES[0], outputCol=SCALED),
        SQLTransformer(statement=f"SELECT *, log1p(`{FEATURES[1]}`) AS `{LOGGED}` FROM __THIS__"),
        VectorAssembler(inputCols=list(VECTOR_INPUTS), outputCol="features", handleInvalid=handle_invalid),
    ]


def model_pipeline(regressor: Estimator) -> Pipeline:
    """Features and regressor as one estimator, so that the scaling is fitted on the training part."""
    return Pipeline(stages=[*feature_stages(), regressor])


@dataclass(frozen=True)
class BoostParams:
    """Boosted-tree parameters under the names of the search table."""

    n_estimators: int
    max_depth: int
    learning_rate: float
    subsample: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1
    loss: str = "squared"


# The parameter sets of the studies.
SQUARED_TREES = BoostParams(50, 5, 0.5, 0.75, 1, 0, "squared")
ABSOLUTE_TREES = BoostParams(20, 10, 0.01, 0.75, 1, 0, "absolute")
TUNED_TREES = BoostParams(20, 10, 0.5, 1.0, 5, 3, "absolute")
PLAIN_TREES = BoostParams(10, 10, 0.01, 0.75, 0, 1, "squared")


def boosted_trees(params: BoostParams, rows: int, seed: int = SEED) -> GBTRegressor:
    """Spark's boosted trees with the meaning the searched parameters have, for `rows` training rows.

    `gamma` is the least *total* reduction of the loss by a split. Spark's gain is a
    reduction of variance per row of the node, so the least gain is 2 * gamma / rows; that is
    exact at the root, and deep nodes are pruned less than the total form would.
    `learning_rate` shrinks each tree. With the squared loss Spark fits a tree to twice the
    residual, so its step is half the rate. Spark's first tree counts in full whatever the
    rate, which matters for rates as small as 0.01. `min_child_weight` is the least number of
    rows in a node (at least 1).
    """
    return GBTRegressor(
        featuresCol="features",
        labelCol=TARGET,
        maxIter=params.n_estimators,
        maxDepth=params.max_depth,
        stepSize=params.learning_rate / 2 if params.loss == "squared" else params.learning_rate,
        subsamplingRate=params.subsample,
        minInfoGain=2.0 * params.gamma / max(1, rows),
        minInstancesPerNode=max(1, int(params.min_child_weight)),
        lossType=params.loss,
        seed=seed,
    )


def fit_trees(train: DataFrame, params: BoostParams, seed: int = SEED) -> PipelineModel:
    """Fit features and boosted trees; long boosting cuts its lineage in the shared folder.

    Spark keeps each partition's rows as vectors and reads them in every level of every tree, and files of a few
    columns hold many more rows than a task should: beyond `TASK_ROWS` rows they are dealt evenly, once.
    """
    ensure_checkpoint_dir(train.sparkSession)
    rows = train.count()
    trees = boosted_trees(params, rows, seed)
    if rows <= TASK_ROWS:
        return model_pipeline(trees).fit(train)
    features = Pipeline(stages=feature_stages()).fit(train)
    parts = max(-(-rows // TASK_ROWS), train.sparkSession.sparkContext.defaultParallelism)
    dealt = features.transform(train).select("features", TARGET).repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel([*features.stages, trees.fit(dealt)])
    finally:
        dealt.unpersist()


def fit_elastic_net(train: DataFrame, alpha: float = 0.1, l1_ratio: float = 0.5) -> PipelineModel:
    return model_pipeline(ElasticNet(alpha=alpha, l1Ratio=l1_ratio)).fit(train)


def baseline(df: DataFrame) -> DataFrame:
    """The model without training: the trailing average is the prediction."""
    return df.withColumn("prediction", F.col(FEATURES[0]))


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Predictions next to the input columns."""
    return model.transform(df).select(*df.columns, "prediction")


def coefficients(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Coefficient per feature, and the intercept."""
    linear = model.stages[-1]
    rows = [*zip(FEATURES, (float(c) for c in linear.coefficients)), ("intercept", float(linear.intercept))]
    return spark.createDataFrame(rows, "feature STRING, coefficient DOUBLE")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_use(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Number of splits per feature over all trees, unused features included."""
    trees: GBTRegressionModel = model.stages[-1]
    path = new_shared_path(spark, "trees")
    trees.write().overwrite().save(path)
    splits = (
        spark.read.parquet(f"{path}/data")
        .select(F.col("nodeData.split.featureIndex").alias("index"))
        .where(F.col("index") >= 0)
        .groupBy("index")
        .agg(F.count(F.lit(1)).alias("splits"))
    )
    names = spark.createDataFrame(list(enumerate(FEATURES)), "index INT, feature STRING")
    return names.join(splits, "index", "left").select("feature", F.coalesce("splits", F.lit(0)).alias("splits"))

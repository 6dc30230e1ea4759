"""Random search over boosted-tree parameters with cross-validation and five metrics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridecast.operators.metrics import best_first, regression_scores, search_table
from ridecast.plans import boosting
from ridecast.plans.training import SEED, BoostParams, fit_trees
from ridecast.schemas import FEATURES, METRICS, TARGET

# The searched grid, 864 sets.
GRID = {
    "n_estimators": [10, 20, 50, 100],
    "max_depth": [5, 10, 20],
    "learning_rate": [0.01, 0.1, 0.3, 0.5],
    "subsample": [0.75, 1.0],
    "gamma": [0, 1, 5],
    "min_child_weight": [1, 3, 5],
}
DRAWS, FOLDS = 60, 4


def parameter_grid(spark: SparkSession, grid: dict[str, Sequence] = GRID) -> DataFrame:
    """Every combination of the values, one row each."""
    names = list(grid)
    types = ["DOUBLE" if any(isinstance(v, float) for v in grid[name]) else "INT" for name in names]
    rows = list(product(*grid.values()))
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def draw_parameters(grid: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Distinct parameter sets in an order that only the seed decides."""
    order = F.xxhash64(F.lit(seed), *grid.columns)
    return grid.orderBy(order, *grid.columns).limit(draws)


def random_search(
    df: DataFrame,
    params: DataFrame,
    loss: str = "squared",
    seed: int = SEED,
    parallelism: int = 4,
) -> DataFrame:
    """Scores of every parameter set on every fold: (params..., fold, metrics).

    `df` has a `fold` column. The driver only starts the fits, some at a time, and holds
    one row of metrics per fit; training and scoring run on the executors.
    """
    spark = df.sparkSession
    names = params.columns
    drawn = [row.asDict() for row in params.collect()]
    data = df.persist()
    folds = sorted(row[0] for row in data.select("fold").distinct().collect())

    def fit_and_score(job: tuple[dict, int]) -> tuple:
        values, fold = job
        held_out = F.col("fold") == fold
        model = fit_trees(data.where(~held_out), BoostParams(**values, loss=loss), seed)
        scored = model.transform(data.where(held_out)).select(TARGET, "prediction")
        scores = regression_scores(scored, TARGET, "prediction").first()
        return (*[values[name] for name in names], fold, *[scores[metric] for metric in METRICS])

    try:
        with ThreadPool(parallelism) as pool:
            rows = pool.map(fit_and_score, list(product(drawn, folds)), chunksize=1)
    finally:
        data.unpersist()
    fields = [f"{field.name} {field.dataType.simpleString()}" for field in params.schema.fields]
    return spark.createDataFrame(rows, ", ".join([*fields, "fold INT", *[f"{m} DOUBLE" for m in METRICS]]))


def search_results(fold_scores: DataFrame) -> DataFrame:
    """Mean and deviation per parameter set, under the column names of the results file."""
    params = [name for name in fold_scores.columns if name not in ("fold", *METRICS)]
    table = search_table(fold_scores, params)
    return table.withColumnsRenamed({name: f"regressor__{name}" for name in params})


def refit_best(df: DataFrame, results: DataFrame, metric: str = "mae", loss: str = "squared", seed: int = SEED) -> PipelineModel:
    """Fit the best parameter set on all rows: the smallest error, or the largest r2."""
    best = best_first(results, metric, 1).first().asDict()
    params = {k.removeprefix("regressor__"): v for k, v in best.items() if k.startswith("regressor__")}
    return fit_trees(df, BoostParams(**params, loss=loss), seed)


def _written_scores(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """What earlier calls have written, or nothing."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(ddl).parquet(path) if system.exists(folder) else spark.createDataFrame([], ddl)


def staged_search(
    df: DataFrame, params: DataFrame, path: str, loss: str = "squared", seed: int = SEED,
    features: Sequence[str] = FEATURES, key: str = "seq_id", max_bins: int = boosting.MAX_BINS,
) -> DataFrame:
    """Scores of every parameter set on every fold, with one fit for sets that differ in `n_estimators` alone.

    The first trees of a longer fit are the shorter fit, so the longest is fitted once a fold
    and scored at every length in one pass. `df` has a `fold` column. The scores of each fit are
    appended to the table at `path` at once; a call that finds them there does not fit again, so a search that
    was stopped goes on. Returns (params..., fold, metrics) of the sets asked for.
    """
    spark, names = df.sparkSession, params.columns
    fields = [f"{field.name} {field.dataType.simpleString()}" for field in params.schema.fields]
    ddl = ", ".join([*fields, "fold INT", *[f"{m} DOUBLE" for m in METRICS]])
    others = [name for name in names if name != "n_estimators"]
    lengths: dict[tuple, list[int]] = {}
    for row in params.collect():
        lengths.setdefault(tuple(row[name] for name in others), []).append(row["n_estimators"])
    folds = sorted(row[0] for row in df.select("fold").distinct().collect())
    done = {(tuple(r[n] for n in others), r["fold"], r["n_estimators"]) for r in _written_scores(spark, path, ddl).collect()}  # one row a score
    for values, fold in product(lengths, folds):
        wanted = sorted(n for n in set(lengths[values]) if (values, fold, n) not in done)
        if not wanted:
            continue
        held_out = F.col("fold") == fold
        chosen = BoostParams(n_estimators=wanted[-1], **dict(zip(others, values, strict=True)), loss=loss)
        model = boosting.fit(df.where(~held_out), chosen, features, seed=seed, key=key, max_bins=max_bins)
        staged = model.staged(df.where(held_out), wanted, [f"_after_{n}" for n in wanted])
        stages = F.array(*[F.struct(F.lit(n).alias("n_estimators"), F.col(f"_after_{n}").alias("prediction")) for n in wanted])
        scored = staged.select(TARGET, F.explode(stages).alias("_stage")).select(TARGET, "_stage.*")
        scores = regression_scores(scored, TARGET, "prediction", ["n_estimators"]).collect()  # one row a length
        row = dict(zip(others, values, strict=True))
        rows = [(*[{**row, "n_estimators": r["n_estimators"]}[n] for n in names], fold, *[r[m] for m in METRICS]) for r in scores]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
    found = _written_scores(spark, path, ddl).dropDuplicates([*names, "fold"])
    return found.join(params.dropDuplicates(), names, "left_semi").where(F.col("fold").isin(folds))


def refit_best_boosted(
    df: DataFrame, results: DataFrame, metric: str = "mae", loss: str = "squared", seed: int = SEED, features: Sequence[str] = FEATURES, key: str = "seq_id"
) -> boosting.BoostedModel:
    """Fit the best parameter set of a search table on all rows with second-order boosting."""
    best = best_first(results, metric, 1).first().asDict()
    params = {k.removeprefix("regressor__"): v for k, v in best.items() if k.startswith("regressor__")}
    return boosting.fit(df, BoostParams(**params, loss=loss), features, seed=seed, key=key)

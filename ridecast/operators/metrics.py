"""Regression metrics as aggregates, and tables of scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridecast.operators.ranks import exact_quantiles, quantile_row
from ridecast.schemas import METRICS


def metric_aggregates(truth: Column, error: Column) -> dict[str, Column]:
    """Metric name -> aggregate expression; the median needs ranks and is not among them."""
    squares, rows = F.sum(error * error), F.count(error)
    constant = F.min(truth) == F.max(truth)
    return {
        "mae": F.avg(F.abs(error)),
        "mse": F.avg(error * error),
        "rmse": F.sqrt(F.avg(error * error)),
        "r2": F.when(constant, F.when(squares == 0.0, 1.0).otherwise(0.0)).otherwise(
            1.0 - F.try_divide(squares, rows * F.var_pop(truth))
        ),
    }


def regression_scores(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """mae, medae, mse, rmse and r2, overall or per group.

    A missing truth or prediction raises instead of being skipped. The check sits on the
    aggregate, where no filter of the caller can be evaluated after it.
    """
    by = list(by)
    error = F.col("_truth") - F.col(predicted).cast("double")
    pairs = df.select(*by, F.col(truth).cast("double").alias("_truth"), predicted).withColumn("_error", error)
    missing = F.count_if(F.col("_error").isNull()) > 0
    refusal = F.raise_error(F.lit(f"{truth} or {predicted} is null")).cast("double")
    aggregates = metric_aggregates(F.col("_truth"), F.col("_error"))
    means = pairs.groupBy(*by).agg(
        *[F.when(missing, refusal).otherwise(expr).alias(name) for name, expr in aggregates.items()]
    )
    absolute = pairs.select(*by, F.abs("_error").alias("_absolute"))
    if by:
        medians = exact_quantiles(absolute, "_absolute", [0.5], by).select(
            *[F.col(key).alias(f"_{key}") for key in by], F.col("quantile").alias("medae")
        )
        same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in by])
        scores = means.join(medians, same)
    else:
        scores = means.crossJoin(F.broadcast(quantile_row(absolute, "_absolute", [0.5], ["medae"])))
    return scores.select(*by, *METRICS)


def score_row(df: DataFrame, truth: str, predicted: str, model_id: str | None = None) -> DataFrame:
    """The scores of one model with its id."""
    scores = regression_scores(df, truth, predicted)
    return scores.select(F.lit(model_id).cast("string").alias("id"), *METRICS)


def stack_scores(*tables: DataFrame, ignore_id: bool = False) -> DataFrame:
    """Union of score tables without repeated rows.

    By default two models with equal metrics both stay; `ignore_id` compares the
    metrics alone.
    """
    stacked = reduce(lambda a, b: a.unionByName(b), tables)
    return stacked.dropDuplicates(list(METRICS) if ignore_id else ["id", *METRICS])


def search_table(fold_scores: DataFrame, params: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean and population standard deviation over the folds, per parameter set."""
    spread = []
    for metric in metrics:
        spread += [F.avg(metric).alias(f"{metric}_avg"), F.stddev_pop(metric).alias(f"{metric}_std")]
    return fold_scores.groupBy(*params).agg(*spread)


def best_first(table: DataFrame, metric: str = "mae", rows: int | None = None) -> DataFrame:
    """Best parameter sets first: errors ascending, r2 descending; ties in the order of the parameters."""
    column = F.col(f"{metric}_avg")
    params = [name for name in table.columns if not name.endswith(("_avg", "_std"))]
    ordered = table.orderBy(column.desc() if metric == "r2" else column.asc(), *params)
    return ordered if rows is None else ordered.limit(rows)

"""Projections and row filters of the preparation and the overview studies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridecast.functions.flags import minutes


def with_minutes(df: DataFrame, seconds: str = "duration", out: str = "duration_min") -> DataFrame:
    return df.withColumn(out, minutes(F.col(seconds)))


def drop_columns(df: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """Drop columns; the strict form refuses a name that does not exist."""
    unknown = [name for name in columns if name not in df.columns]
    if strict and unknown:
        raise ValueError(f"columns to drop do not exist: {unknown}")
    return df.drop(*columns)


def with_station(df: DataFrame, station: str = "strt_statn") -> DataFrame:
    """Rows that have a start station, with the id as an integer."""
    return df.where(F.col(station).isNotNull()).withColumn(station, F.col(station).cast("int"))


def at_most(df: DataFrame, column: str, cap: float | None) -> DataFrame:
    """Rows not above the cap. No cap (None) keeps every row, also null ones."""
    return df if cap is None else df.where(F.col(column) <= F.lit(cap))


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(name).isNull() for name in columns])


def rows_with_any_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(any_null(columns))


def near_zero(df: DataFrame, column: str, limit: float = 1e-4) -> DataFrame:
    return df.where(F.col(column) < F.lit(limit))


def positive_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key) > 0)


def feature_target(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """The model's inputs and its target, in this order."""
    return df.select(*features, target)


def transpose(df: DataFrame, ids: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Turn the statistic columns of a small result into (ids..., stat, value) rows."""
    return df.select(*ids, *[F.col(name).cast("double").alias(name) for name in stats]).unpivot(
        list(ids), list(stats), "stat", "value"
    )

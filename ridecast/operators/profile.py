"""Counts, group profiles, descriptions and histograms.

Group keys that are null are left out, as a pandas group-by does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridecast.functions.times import seconds_between
from ridecast.operators.ranks import exact_quantiles, quantile_row


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def group_profile(
    df: DataFrame, keys: Sequence[str], target: str, aggregates: dict[str, Column] | None = None
) -> DataFrame:
    """Non-null count and mean of the target per group, or the named aggregates given."""
    if aggregates is None:
        aggregates = {f"{target}_count": F.count(target), f"{target}_mean": F.avg(target)}
    return _keyed(df, keys).groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggregates.items()])


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def non_null_counts(df: DataFrame, by: str) -> DataFrame:
    """Non-null count of every other column per group."""
    others = [name for name in df.columns if name != by]
    return group_profile(df, [by], by, {f"{name}_count": F.count(name) for name in others})


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """The distinct non-null values of each group with their counts, one row each."""
    return _keyed(df, [key, value]).groupBy(key, value).agg(F.count(F.lit(1)).alias("count"))


def distinct_history(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, number of distinct values and the values themselves per group.

    For a column of few values, as a group's values end in one row; `value_counts` is the
    form without that bound. Values are counted before they meet.
    """
    counted = _keyed(df, [key]).groupBy(key, value).agg(F.count(value).alias("_rows"))
    values = counted.groupBy(key).agg(F.sum("_rows").alias("count"), F.sort_array(F.collect_list(value)).alias("unique"))
    return values.select(key, "count", F.size("unique").alias("nunique"), "unique")


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Number of distinct non-null values per column; `is_constant` marks droppable columns."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(*[count(name).alias(name) for name in columns])
    return wide.unpivot([], list(columns), "column", "nunique").withColumn(
        "is_constant", F.col("nunique") <= 1
    )


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """Median, mean and sample standard deviation as one row."""
    moments = df.agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"))
    return quantile_row(df, target, [0.5], ["median"]).crossJoin(F.broadcast(moments))


def _percent(prob: float) -> str:
    return f"{prob * 100:g}%"


def describe(
    df: DataFrame, columns: Sequence[str], percentiles: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """One row per column: count, mean, std, min, percentiles, max. The median is always there."""
    probs = sorted({float(p) for p in percentiles} | {0.5})
    columns = list(columns)
    doubles = df.select(*[F.col(name).cast("double").alias(name) for name in columns])
    stats = {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    }
    wide = doubles.agg(
        *[
            F.struct(*[function(name).alias(stat) for stat, function in stats.items()]).alias(name)
            for name in columns
        ]
    )
    moments = wide.unpivot([], columns, "column", "s").select("column", "s.*")
    long = doubles.unpivot([], columns, "column", "value")
    quantiles = (
        exact_quantiles(long, "value", probs, ["column"], few_groups=True)
        .groupBy("column")
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(_percent(p)) for p in probs])
    )
    # One row per described column on either side.
    return moments.join(F.broadcast(quantiles), "column", "left").select(
        "column", "count", "mean", "std", "min", *[F.col(f"`{_percent(p)}`") for p in probs], "max"
    )


def info(df: DataFrame) -> DataFrame:
    """Type and non-null count per column."""
    wide = df.agg(*[F.count(F.col(f"`{name}`")).alias(name) for name in df.columns])
    entry = [
        F.struct(F.lit(name).alias("column"), F.lit(dtype).alias("type"), F.col(f"`{name}`").alias("non_null"))
        for name, dtype in df.dtypes
    ]
    return wide.select(F.inline(F.array(*entry)))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram between minimum and maximum; every bin has a row.

    Edges follow the usual linear spacing. The last bin includes the maximum, and a
    column of one single value gets a range of width one around it.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_x"))
    lo, hi = F.col("_lo"), F.col("_hi")
    # A global aggregate is one row, whatever the input.
    bounds = values.agg(F.min("_x").alias("_min"), F.max("_x").alias("_max")).select(
        F.when(F.col("_min") == F.col("_max"), F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
        F.when(F.col("_min") == F.col("_max"), F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"),
    )

    def edge(index: Column) -> Column:
        return F.when(index == bins, hi).otherwise(lo + index * ((hi - lo) / F.lit(float(bins))))

    guess = F.least(F.floor((F.col("_x") - lo) / (hi - lo) * F.lit(float(bins))), F.lit(bins - 1))
    index = F.col("_guess")
    placed = (
        F.when(F.col("_x") < edge(index), index - 1)
        .when((index < bins - 1) & (F.col("_x") >= edge(index + 1)), index + 1)
        .otherwise(index)
    )
    counted = (
        values.crossJoin(F.broadcast(bounds))
        .withColumn("_guess", guess)
        .groupBy(placed.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    spine = bounds.where(lo.isNotNull()).select(
        "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return spine.join(counted, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("low"),
        edge(F.col("bin") + 1).alias("high"),
        F.coalesce("_n", F.lit(0)).alias("count"),
    )


def value_histogram(df: DataFrame, column: str) -> DataFrame:
    """Number of rows per value (a category or a day); null is not a value."""
    return group_profile(df, [column], column, {"count": F.count(F.lit(1))})


def completeness(df: DataFrame, time: str = "DATE") -> DataFrame:
    """Hours between the first and last reading against the number of rows."""
    return df.agg(
        F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("actual_rows")
    ).select(
        "first",
        "last",
        (seconds_between(F.col("first"), F.col("last")) / 3600.0).alias("expected_rows"),
        "actual_rows",
        (F.col("actual_rows") < seconds_between(F.col("first"), F.col("last")) / 3600.0).alias("is_short"),
    )


# Expected facts about the data, as conditions that mark a violation.
def quality_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows that break each named rule, in one pass."""
    wide = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return wide.unpivot([], list(rules), "rule", "violations")


def trip_rules() -> dict[str, Column]:
    """What the trip data promise: closed trips, a start station, birth years of members only."""
    member = F.col("subsc_type") == "Registered"
    return {
        "open_trip": ~F.coalesce(F.lower("status") == "closed", F.lit(False)),
        "no_start_station": F.col("strt_statn").isNull(),
        "no_end_station": F.col("end_statn").isNull(),
        "birth_date_of_casual": ~F.coalesce(member, F.lit(False)) & F.col("birth_date").isNotNull(),
    }


def newest(df: DataFrame, time: str, tiebreak: str, rows: int = 5) -> DataFrame:
    """Preview of the newest rows in a stable order."""
    return df.orderBy(F.desc(time), F.asc(tiebreak)).limit(rows)


def sort_by(df: DataFrame, *columns: Column) -> DataFrame:
    """Total order for a sink."""
    return df.orderBy(*columns)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]

"""Trailing averages, lags, trends and gaps.

Every window here runs over a table that was aggregated first (one row per station
and day, one per day, one per distinct time), so a station that holds a third of all
trips still brings only its days into one window partition.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridecast.functions.times import floor_to_hour, hours_between
from ridecast.operators.projection import at_most

STATION = "strt_statn"
DAY = "start_date_trunc"
TOTAL = "daily_trips_total_duration"
COUNT = "daily_trips_count"
STATE_SCHEMA = f"{STATION} INT, {DAY} DATE, {TOTAL} DOUBLE, {COUNT} BIGINT"


def station_day_totals(
    trips: DataFrame, max_trip_duration: float | None = None, value: str = "duration_min"
) -> DataFrame:
    """Total duration and number of trips per station and active day.

    A day on which every trip exceeds the cap has no row. A null duration adds nothing
    to the sum and nothing to the count.
    """
    return (
        at_most(trips, value, max_trip_duration)
        .where(F.col(STATION).isNotNull() & F.col(DAY).isNotNull())
        .groupBy(STATION, DAY)
        .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(TOTAL), F.count(value).alias(COUNT))
    )


def group_lag(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], steps: int = 1) -> DataFrame:
    """Shift columns by some rows inside each group; for tables of one row per group and day."""
    window = Window.partitionBy(*by).orderBy(order)
    return df.select(
        *by, order, *[F.lag(name, steps).over(window).alias(f"{name}_lag{steps}") for name in columns]
    )


def trailing_ratio(days: DataFrame, window_days: int, out: str) -> DataFrame:
    """Ratio of sums over the previous active days of a station; null until they all exist."""
    window = Window.partitionBy(STATION).orderBy(DAY).rowsBetween(-window_days, -1)
    ratio = F.try_divide(F.sum(TOTAL).over(window), F.sum(COUNT).over(window))
    return days.withColumn(out, F.when(F.count(F.lit(1)).over(window) == window_days, ratio))


def station_trailing_avg(
    trips: DataFrame,
    window_days: int = 7,
    max_trip_duration: float | None = None,
    out: str = "avg_duration_prev_7days",
    value: str = "duration_min",
) -> DataFrame:
    """Average trip per station over its previous `window_days` active days.

    The current day is excluded. Active days are days with at least one kept trip, so
    after a winter gap the days before the gap count. `None` and 0 mean no cap.
    """
    days = station_day_totals(trips, max_trip_duration or None, value)
    return trailing_ratio(days, window_days, out).select(STATION, DAY, out)


def empty_station_state(spark: SparkSession) -> DataFrame:
    """The state before the first trip; see `advance_stations`."""
    return spark.createDataFrame([], STATE_SCHEMA)


def advance_stations(
    state: DataFrame,
    arrivals: DataFrame,
    window_days: int = 7,
    max_trip_duration: float | None = 90.0,
    out: str = "avg_duration_prev_7days",
) -> tuple[DataFrame, DataFrame]:
    """(feature of every station-day that arrived, state after it), without reading older trips.

    The state holds the last `window_days` active days of each station, so a step costs what
    arrived and a few rows a station. Arrivals are trips of whole days later than the state's
    days of their station; an earlier or repeated day is refused, since averages that follow it
    have been given out. Over any cut of the trips into such steps the features are those of
    `station_trailing_avg`. Write both results before the next step.
    """
    arrived = station_day_totals(arrivals, max_trip_duration or None).withColumn("_new", F.lit(True))
    days = state.select(STATION, DAY, TOTAL, COUNT, F.lit(False).alias("_new")).unionByName(arrived)
    station = Window.partitionBy(STATION)
    through = F.max(F.when(~F.col("_new"), F.col(DAY))).over(station)
    late = F.raise_error(F.concat(F.lit("a day that is not after the state: "), F.col(DAY).cast("string")))
    days = days.withColumn("_through", through).withColumn(
        DAY, F.when(F.col("_new") & (F.col(DAY) <= F.col("_through")), late.cast("date")).otherwise(F.col(DAY))
    )
    features = trailing_ratio(days, window_days, out).where("_new").select(STATION, DAY, out)
    age = F.row_number().over(station.orderBy(F.desc(DAY)))
    after = days.withColumn("_age", age).where(F.col("_age") <= window_days).select(STATION, DAY, TOTAL, COUNT)
    return features, after


def daily_station_features(
    trips: DataFrame,
    day: dt.date,
    window_days: int = 7,
    max_trip_duration: float | None = 90.0,
    fallback_to_global: bool = False,
    out: str = "avg_duration_prev_7days",
) -> DataFrame:
    """The feature of every known station as of `day`, for a daily refresh.

    With the fallback a station without enough active days gets the average over all
    earlier trips of all stations.
    """
    days = station_day_totals(trips.where(F.col(DAY) < F.lit(day)), max_trip_duration or None)
    newest = Window.partitionBy(STATION).orderBy(F.desc(DAY))
    latest = (
        days.withColumn("_age", F.row_number().over(newest))
        .where(F.col("_age") <= window_days)
        .groupBy(STATION)
        .agg(
            F.when(
                F.count(F.lit(1)) == window_days, F.try_divide(F.sum(TOTAL), F.sum(COUNT))
            ).alias(out)
        )
    )
    if fallback_to_global:
        # A global aggregate is one row, whatever the input.
        overall = days.agg(F.try_divide(F.sum(TOTAL), F.sum(COUNT)).alias("_overall"))
        latest = latest.crossJoin(F.broadcast(overall)).withColumn(
            out, F.coalesce(F.col(out), F.col("_overall"))
        )
    return latest.select(STATION, F.lit(day).alias("as_of"), out)


def daily_trend(
    df: DataFrame, day: str = DAY, target: str = "duration_min", window_days: int = 7
) -> DataFrame:
    """Moving mean of the daily means, current day included; null for the first days."""
    daily = (
        df.where(F.col(day).isNotNull())
        .groupBy(day)
        .agg(F.count(target).alias("count"), F.avg(target).alias("mean"))
    )
    window = Window.orderBy(day).rowsBetween(1 - window_days, 0)
    return daily.withColumn(
        f"{target}_{window_days}davg",
        F.when(F.count("mean").over(window) == window_days, F.avg("mean").over(window)),
    )


def reading_gaps(
    df: DataFrame, time: str = "DATE", by: Sequence[str] = (), each_reading: bool = False
) -> DataFrame:
    """Hours since the previous reading, per distinct reading time.

    Repeated readings of one time are counted in `readings`; their own gap is zero, and
    `each_reading` gives them rows of their own. The
    lag runs inside each hour, and the first reading of an hour takes the last one of the
    hour before it that has any. So a window holds the distinct times of one hour, or the
    hours of one history, however many rows a key has.
    """
    by = list(by)
    times = (
        df.where(F.col(time).isNotNull())
        .groupBy(*by, time)
        .agg(F.count(F.lit(1)).alias("readings"))
        .withColumn("_hour", floor_to_hour(F.col(time)))
    )
    edges = times.groupBy(*by, "_hour").agg(F.max(time).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*by).orderBy("_hour"))
    edges = edges.select(*by, "_hour", before.alias("_before"))
    inside = Window.partitionBy(*by, "_hour").orderBy(time)
    gap = f"{time}_delta_hours"
    gaps = (
        times.withColumn("_previous", F.lag(time).over(inside))
        .join(edges, [*by, "_hour"])
        .select(
            *by,
            time,
            "readings",
            hours_between(F.coalesce("_previous", "_before"), F.col(time)).alias(gap),
        )
    )
    return _each_reading(gaps, gap) if each_reading else gaps


def _each_reading(gaps: DataFrame, gap: str) -> DataFrame:
    """One row per reading: the first of a time keeps the gap, the others have zero.

    Expanded in chunks, so that no array grows with the number of repeated readings.
    """
    chunk = 65_536
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("readings") - 1, F.lit(chunk).cast("bigint")))
    last = F.least(F.col("_start") + chunk, F.col("readings")) - 1
    return (
        gaps.withColumn("_start", starts)
        .withColumn("_nth", F.explode(F.sequence(F.col("_start"), last)))
        .withColumn(gap, F.when(F.col("_nth") == 0, F.col(gap)).otherwise(0.0))
        .drop("readings", "_start", "_nth")
    )

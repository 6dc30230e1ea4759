"""Joins of trips with station averages and weather.

Neither join forces a broadcast: the other side is broadcast when Spark's own size
check allows it, and otherwise sorted and merged, where AQE splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridecast.functions.times import weather_key
from ridecast.operators.windows import DAY, STATION


def attach_station_avg(trips: DataFrame, averages: DataFrame) -> DataFrame:
    """Left join on station and day; trips of an inactive station-day get null."""
    return trips.join(averages, [STATION, DAY], "left")


def with_unique_hours(weather: DataFrame) -> DataFrame:
    """The weather, refusing an hour that has more than one reading (it would repeat trips)."""
    readings = F.count(F.lit(1)).over(Window.partitionBy("DATE"))
    refusal = F.raise_error(F.concat(F.lit("more than one reading at "), F.col("DATE").cast("string")))
    checked = F.when(readings > 1, refusal.cast(weather.schema["DATE"].dataType)).otherwise(F.col("DATE"))
    return weather.withColumn("DATE", checked)


def join_weather(trips: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join on the lagged hour. A repeated hour repeats its trips (see `with_unique_hours`)."""
    keyed = trips.withColumn("date_to_merge_weather_data", weather_key(F.col("start_date")))
    return keyed.join(weather, F.col("date_to_merge_weather_data") == F.col("DATE"), "left")


def with_coverage(joined: DataFrame, weather: DataFrame) -> DataFrame:
    """Flag trips whose lagged hour lies between the first and the last reading, inclusive."""
    # A global aggregate is one row, whatever the input.
    bounds = weather.agg(F.min("DATE").alias("_first"), F.max("DATE").alias("_last"))
    hour = F.col("date_to_merge_weather_data")
    outside = (hour < F.col("_first")) | (hour > F.col("_last"))
    return (
        joined.crossJoin(F.broadcast(bounds))
        .withColumn("has_precip_data", F.when(outside, 0).otherwise(1))
        .drop("_first", "_last")
    )


def fill_weather(df: DataFrame) -> DataFrame:
    """No reading means no rain: inside the covered period by its meaning, outside by convention."""
    covered = F.col("has_precip_data") == 1
    return df.withColumns(
        {
            "HPCP": F.when(covered, F.coalesce("HPCP", F.lit(0.0))).otherwise(F.lit(0.0)),
            "has_trace": F.when(covered, F.coalesce("has_trace", F.lit(0))).otherwise(F.lit(0)).cast("int"),
        }
    )


def attach_weather(trips: DataFrame, weather: DataFrame) -> DataFrame:
    """Prepared trips + prepared weather -> training table."""
    joined = with_coverage(join_weather(trips, weather), weather)
    return fill_weather(joined).drop("date_to_merge_weather_data", "DATE")

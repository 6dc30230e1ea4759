"""From raw trips and weather to the training table, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridecast.functions import flags, times
from ridecast.operators import projection
from ridecast.operators.joins import attach_station_avg, attach_weather
from ridecast.operators.windows import DAY, station_trailing_avg

# The columns that neither the training nor the joins need.
WEATHER_DROPS = (
    "STATION", "STATION_NAME", "ELEVATION", "LATITUDE", "LONGITUDE", "Quality_Flag", "Measurement_Flag",
)
TRIP_DROPS = (
    "duration", "zip_code", "bike_nr", "birth_date", "gender", "status", "subsc_type", "hubway_id",
    "end_date", DAY, "dow",
)


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def prepare_weather(df: DataFrame, drop_unnecessary_columns: bool = True) -> DataFrame:
    """Trace flag and typed time. Rows are not sorted: sort at a sink if the order matters."""
    time = times.parse_weather_time(F.col("DATE")) if _is_text(df, "DATE") else F.col("DATE")
    out = df.withColumns({"has_trace": flags.label_flag(F.col("Measurement_Flag"), "T"), "DATE": time})
    return projection.drop_columns(out, WEATHER_DROPS) if drop_unnecessary_columns else out


def typed_trips(df: DataFrame) -> DataFrame:
    """Trips with a start station, minutes, a start time without seconds, day and flag."""
    start = F.col("start_date")
    start = times.parse_trip_time(start) if _is_text(df, "start_date") else times.floor_to_minute(start)
    return (
        projection.with_station(projection.with_minutes(df))
        .withColumn("start_date", start)
        .withColumns(
            {
                DAY: times.day_of(F.col("start_date")),
                "is_registered": flags.label_flag(F.col("subsc_type"), "Registered"),
            }
        )
    )


def with_weekday_cycle(df: DataFrame, dow: str = "dow") -> DataFrame:
    sine, cosine = times.cyclic(F.col(dow), 7)
    return df.withColumns({"dow_sin": sine, "dow_cos": cosine})


def prepare_trips(
    df: DataFrame,
    window_days: int = 7,
    max_trip_duration: float | None = 90.0,
    station_avg: DataFrame | None = None,
) -> DataFrame:
    """Raw trips -> prepared trips with the trailing average and the weekday cycle.

    `station_avg` takes averages that were written before (`sources.files`): a table
    read back has a known size, so Spark broadcasts it when it is small and the trips
    are not shuffled at all.
    """
    trips = typed_trips(df)
    averages = station_avg
    if averages is None:
        averages = station_trailing_avg(trips, window_days, max_trip_duration)
    joined = attach_station_avg(trips, averages).withColumn("dow", times.weekday(F.col("start_date")))
    return projection.drop_columns(with_weekday_cycle(joined), TRIP_DROPS, strict=False)


def training_table(
    raw_trips: DataFrame, raw_weather: DataFrame, station_avg: DataFrame | None = None
) -> DataFrame:
    """Raw trips + raw weather -> training table."""
    return attach_weather(prepare_trips(raw_trips, station_avg=station_avg), prepare_weather(raw_weather))


def station_average_study(prepared: DataFrame, window_days: int = 4) -> DataFrame:
    """The shorter, uncapped average next to the prepared one, on prepared trips."""
    trips = prepared.withColumn(DAY, times.day_of(F.col("start_date")))
    averages = station_trailing_avg(trips, window_days, None, out="avg_duration_prev_7days_prev_days")
    return attach_station_avg(trips, averages)

"""Explicit schemas of the sources, derived tables and requests."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def struct(columns: str) -> T.StructType:
    """`name TYPE, ...` -> schema, without the session that Spark's own DDL parser needs."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# The column names of the published trip, station and weather files.
TRIPS = struct(
    "seq_id BIGINT, hubway_id BIGINT, status STRING, duration INT, start_date STRING, "
    "strt_statn INT, end_date STRING, end_statn INT, bike_nr STRING, subsc_type STRING, "
    "zip_code STRING, birth_date INT, gender STRING"
)
STATIONS = struct(
    "id INT, terminal STRING, station STRING, municipal STRING, lat DOUBLE, lng DOUBLE, status STRING"
)
WEATHER = struct(
    "STATION STRING, STATION_NAME STRING, ELEVATION DOUBLE, LATITUDE DOUBLE, LONGITUDE DOUBLE, "
    "DATE STRING, HPCP DOUBLE, Measurement_Flag STRING, Quality_Flag STRING"
)

TRAINING = struct(
    "seq_id BIGINT, start_date TIMESTAMP_NTZ, strt_statn INT, end_statn INT, duration_min DOUBLE, "
    "is_registered INT, avg_duration_prev_7days DOUBLE, dow_sin DOUBLE, dow_cos DOUBLE, "
    "HPCP DOUBLE, has_trace INT, has_precip_data INT"
)

# The metric names and the searched parameters, in file order.
METRICS = ("mae", "medae", "mse", "rmse", "r2")
SEARCH = struct(
    "regressor__subsample DOUBLE, regressor__n_estimators INT, regressor__min_child_weight INT, "
    "regressor__max_depth INT, regressor__learning_rate DOUBLE, regressor__gamma INT, "
    + ", ".join(f"{metric}_avg DOUBLE, {metric}_std DOUBLE" for metric in METRICS)
)
SCORES = struct("id STRING, " + ", ".join(f"{metric} DOUBLE" for metric in METRICS))

# Request bodies arrive as JSON; every field is read as its raw text so that the
# validation can tell a missing field from one that cannot be converted.
REQUEST_FIELDS = ("avg_duration_prev_7days", "HPCP", "dow", "is_registered", "has_trace")
REQUEST = struct("request_id BIGINT, " + ", ".join(f"{field} STRING" for field in REQUEST_FIELDS))

# The model's inputs in their order, and its target.
FEATURES = ("avg_duration_prev_7days", "HPCP", "is_registered", "dow_sin", "dow_cos", "has_trace")
TARGET = "duration_min"

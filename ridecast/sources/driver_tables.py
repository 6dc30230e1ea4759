"""Trips, weather, stations, score pairs and requests derived from the given tables.

Durations are cut to quarter minutes, so that every sum of minutes is exact in a
double and does not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridecast.functions.times import floor_to_hour
from ridecast.schemas import REQUEST, REQUEST_FIELDS, TRIPS, WEATHER, struct

# The columns used here; a declared schema spares the job that reads the file footers.
TABLES = {
    "events": struct(
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "supplier": struct("s_suppkey BIGINT, s_nationkey INT, s_acctbal DOUBLE"),
    "nation": struct("n_nationkey INT, n_name STRING"),
    "lineitem": struct(
        "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, "
        "l_tax DOUBLE, l_returnflag STRING"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a trip from the user's station; some values are missing or bad on purpose.

    Some trips are open, and some casual riders have a year of birth.
    """
    events = table(spark, sf_dir, "events")
    seconds = F.floor(F.col("value") * 4.0).cast("int") * 15
    member = F.col("event_type").isin("purchase", "signup")
    event, user = F.col("event_id"), F.col("user_id")
    return events.select(
        event.alias("seq_id"),
        (event + 1_000_000).alias("hubway_id"),
        F.when(event % 13 == 0, "open").otherwise("closed").alias("status"),
        F.when(event % 97 == 0, F.lit(None)).when(event % 89 == 0, -60).otherwise(seconds).alias("duration"),
        F.col("ts").alias("start_date"),
        F.nullif(user, F.lit(3)).cast("int").alias("strt_statn"),
        (F.col("ts") + F.make_dt_interval(mins=F.lit(10))).alias("end_date"),
        F.nullif(event % 40, F.lit(0)).cast("int").alias("end_statn"),
        F.concat(F.lit("B"), (event % 500).cast("string")).alias("bike_nr"),
        F.when(member, "Registered").otherwise("Casual").alias("subsc_type"),
        F.when(member, F.concat(F.lit("'0"), (user % 2000 + 1000).cast("string"))).alias("zip_code"),
        F.when(member | (event % 17 == 0), F.lit(1950) + user % 50).cast("int").alias("birth_date"),
        F.when(member, F.when(user % 2 == 0, "Female").otherwise("Male")).alias("gender"),
    )


def trip_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips with their times as the text of a trip file."""
    text = {name: F.date_format(name, "M/d/yyyy H:mm:ss") for name in ("start_date", "end_date")}
    return trips(spark, sf_dir).withColumns(text).to(TRIPS)


def weather_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weather with its times as the text of a weather file."""
    return weather(spark, sf_dir).withColumn("DATE", F.date_format("DATE", "yyyyMMdd HH:mm")).to(WEATHER)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per hour with a purchase; hours without one have no reading."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    cents = F.sum(F.floor(F.col("value")).cast("bigint"))
    hourly = events.groupBy(floor_to_hour(F.col("ts")).alias("DATE")).agg(
        cents.alias("_cents"), F.count(F.lit(1)).alias("_events")
    )
    trace = F.col("_events") == 1
    return hourly.select(
        F.lit("COOP:190770").alias("STATION"),
        F.lit("MAIN").alias("STATION_NAME"),
        F.lit(6.1).alias("ELEVATION"),
        F.lit(42.36).alias("LATITUDE"),
        F.lit(-71.01).alias("LONGITUDE"),
        "DATE",
        F.when(trace, 0.0).otherwise(F.col("_cents") / 100.0).alias("HPCP"),
        F.when(trace, "T").alias("Measurement_Flag"),
        F.lit(None).cast("string").alias("Quality_Flag"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier is a station named after its nation, existing or removed by its balance."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    # No hint: Spark broadcasts the nations by the size of their file.
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("int").alias("id"),
        F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("terminal"),
        F.col("n_name").alias("station"),
        F.col("n_name").alias("municipal"),
        (F.lit(42.0) + F.col("s_suppkey") % 64 / 64.0).alias("lat"),
        (F.lit(-71.0) - F.col("s_suppkey") % 32 / 32.0).alias("lng"),
        F.when(F.col("s_acctbal") >= 0, "Existing").otherwise("Removed").alias("status"),
    )


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truth and a prediction per line item, with a group, a fold and two parameters.

    Both are whole numbers over 1024, so that sums of errors and squares are exact.
    """
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        (F.col("l_orderkey") % 4).cast("int").alias("fold"),
        F.col("l_linenumber").alias("max_depth"),
        (F.col("l_tax") * 100).cast("int").alias("n_estimators"),
        (F.floor(F.col("l_extendedprice")) / 1024.0).alias("y"),
        (F.col("l_quantity") * 1500.0 / 1024.0).alias("y_hat"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw request fields, some missing, out of range or of a wrong type."""
    event, value = F.col("event_id"), F.col("value")
    quarter = F.floor(value * 4.0) / 4.0
    flags = F.element_at(F.array(*[F.lit(t) for t in ("true", "false", "1", "No", "maybe")]), (event % 5 + 1).cast("int"))
    return (
        table(spark, sf_dir, "events")
        .select(
            event.alias("request_id"),
            F.when(event % 31 == 0, F.lit(None))
            .when(event % 37 == 0, F.lit("-1.5"))
            .when(event % 41 == 0, F.lit("fast"))
            .otherwise(quarter.cast("string"))
            .alias("avg_duration_prev_7days"),
            F.when(event % 43 == 0, F.lit("-0.25")).otherwise((event % 8 / 8.0).cast("string")).alias("HPCP"),
            F.when(event % 47 == 0, F.lit("2.5")).otherwise((F.col("user_id") % 9 - 1).cast("string")).alias("dow"),
            F.when(event % 2 == 0, F.lit("true")).otherwise(flags).alias("is_registered"),
            F.when(event % 53 == 0, F.lit(None)).otherwise(F.lit("false")).alias("has_trace"),
        )
        .select("request_id", *REQUEST_FIELDS)
        .to(REQUEST)
    )

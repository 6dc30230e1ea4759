"""Request scans, validation, features and the stream of both."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridecast.functions import flags
from ridecast.plans import scoring
from ridecast.schemas import REQUEST_FIELDS
from ridecast.session import new_shared_path
from ridecast.sources import driver_tables as src
from ridecast.sources import files
from ridecast.streaming.requests import run_stream
from ridecast_queries.preparation import with_fixed
from ridecast_queries.registry import fp, query

_FEATURE_SQL = f"""SELECT request_id, avg_duration_prev_7days, "HPCP", CAST(is_registered AS INTEGER) AS is_registered,
                   CAST(has_trace AS INTEGER) AS has_trace, {fp("sin(2 * pi() * dow / 7)", "dow_sin")},
                   {fp("cos(2 * pi() * dow / 7)", "dow_cos")} FROM checked WHERE reasons = ''"""
_CHECK_SQL = """SELECT request_id, avg_duration_prev_7days, "HPCP", dow, is_registered, has_trace,
                       reasons = '' AS is_valid, reasons FROM checked"""
_SCAN_SQL = 'SELECT request_id, avg_duration_prev_7days, "HPCP", dow, is_registered, has_trace FROM req'


def written_requests(spark, sf) -> str:
    path = new_shared_path(spark, "requests")
    src.requests(spark, sf).write.json(path)
    return path


def joined_reasons(validated):
    return validated.withColumn("reasons", F.array_join("reasons", "; "))


def accepted_features(raw):
    return scoring.request_features(scoring.accepted(scoring.validate(raw)))


@query("request_json_scan", _SCAN_SQL)
def request_json_scan(spark, sf):
    return files.read_requests(spark, written_requests(spark, sf)).drop(files.RAW)


@query("request_bodies", _SCAN_SQL)
def request_bodies(spark, sf):
    body = F.to_json(F.struct(*REQUEST_FIELDS)).alias("body")
    return files.parse_request_bodies(src.requests(spark, sf).select("request_id", body)).drop(files.RAW)


@query(
    "malformed_bodies",
    """SELECT request_id, CASE WHEN request_id % 10 = 0 THEN 'no json ' || request_id END AS raw,
              CASE WHEN request_id % 10 = 0 THEN 'body: not valid JSON' ELSE reasons END AS reasons FROM checked""",
)
def malformed_bodies(spark, sf):
    """Every tenth body is no JSON: it keeps its text and gets one reason."""
    number = F.col("request_id")
    broken = F.concat(F.lit("no json "), number.cast("string"))
    body = F.when(number % 10 == 0, broken).otherwise(F.to_json(F.struct(*REQUEST_FIELDS))).alias("body")
    parsed = files.parse_request_bodies(src.requests(spark, sf).select("request_id", body))
    return joined_reasons(scoring.validate(parsed)).select("request_id", files.RAW, "reasons")


@query("request_validation", _CHECK_SQL)
def request_validation(spark, sf):
    return joined_reasons(scoring.validate(src.requests(spark, sf)))


@query("request_rejections", "SELECT request_id, reasons FROM checked WHERE reasons <> ''")
def request_rejections(spark, sf):
    return joined_reasons(scoring.rejected(scoring.validate(src.requests(spark, sf)))).select("request_id", "reasons")


@query("request_features", _FEATURE_SQL)
def request_features(spark, sf):
    return with_fixed(accepted_features(src.requests(spark, sf)), "dow_sin", "dow_cos")


@query(
    "flag_to_int",
    "SELECT request_id, CAST(is_registered AS INTEGER) AS is_registered, CAST(has_trace AS INTEGER) AS has_trace FROM checked",
)
def flag_to_int(spark, sf):
    typed = scoring.validate(src.requests(spark, sf))
    return typed.select(
        "request_id", *[flags.bool_to_int(F.col(name)).alias(name) for name in ("is_registered", "has_trace")]
    )


def streamed(spark, sf, transform):
    """Run the transformation over the written requests as a stream and read what it wrote."""
    sink = new_shared_path(spark, "stream-sink")
    stream = run_stream(
        spark, written_requests(spark, sf), sink, new_shared_path(spark, "stream-state"), transform, files_per_trigger=2
    )
    stream.awaitTermination()
    return spark.read.parquet(sink)


@query("stream_request_validation", _CHECK_SQL)
def stream_request_validation(spark, sf):
    return streamed(spark, sf, lambda raw: joined_reasons(scoring.validate(raw))).drop(files.RAW)


@query("stream_request_features", _FEATURE_SQL)
def stream_request_features(spark, sf):
    return with_fixed(streamed(spark, sf, accepted_features), "dow_sin", "dow_cos")

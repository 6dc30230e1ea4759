"""Tables kept up to date: audits while writing, months, station states, sketches, co-located joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ridecast.operators import cleaning, profile, sketches, windows
from ridecast.operators.joins import attach_station_avg
from ridecast.plans import prepare, scoring
from ridecast.schemas import REQUEST_FIELDS, TRAINING
from ridecast.session import materialise, new_shared_path
from ridecast.sources import colocated, files, refresh
from ridecast.sources import driver_tables as src
from ridecast_queries import tables  # noqa: F401  (registers SQL that queries here share)
from ridecast_queries.preparation import stored_training, with_fixed
from ridecast_queries.registry import query


def _typed(spark, sf):
    return prepare.typed_trips(src.trips(spark, sf))


@query("drop_audit_observed", like="drop_audit")
def drop_audit_observed(spark, sf):
    """The audit of the cleaned table's own write."""
    path = new_shared_path(spark, "cleaned")
    return cleaning.clean_and_audit(stored_training(spark, sf), lambda df: files.write_training(df, path, files_per_month=None))


@query("training_refreshed", like="training_roundtrip_parquet")
def training_refreshed(spark, sf):
    """All months written, then each month written again from its own rows."""
    table, path = stored_training(spark, sf), new_shared_path(spark, "training-months")
    month = F.date_format(F.col("start_date").cast("date"), "yyyy-MM")
    months = [r[0] for r in table.select(month).distinct().collect()]  # the table's months
    refresh.refresh_training(table, path, months)
    for name in months:
        refresh.refresh_training(table.where(month == name), path, [name])
    return with_fixed(files.read_training(spark, path), "dow_sin", "dow_cos").select(*TRAINING.names)


@query("trailing_avg_7_advanced", like="trailing_avg_7")
def trailing_avg_7_advanced(spark, sf):
    """The trailing average, week by week from the state of the stations."""
    trips = _typed(spark, sf)
    first, last = trips.agg(F.min(windows.DAY), F.max(windows.DAY)).first()
    state, parts = windows.empty_station_state(spark), []
    while first is not None and first <= last:
        until = first + dt.timedelta(days=7)
        week = trips.where((F.col(windows.DAY) >= F.lit(first)) & (F.col(windows.DAY) < F.lit(until)))
        features, after = windows.advance_stations(state, week, 7, 90.0)
        parts.append(materialise(features, "station-features"))
        state, first = materialise(after, "station-state"), until
    every = parts[0] if parts else windows.station_trailing_avg(trips, 7, 90.0)
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


SKETCHED = ("seq_id", "strt_statn", "end_statn", "bike_nr", "zip_code", "start_date")
_DISTINCT = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nunique, TRUE AS within FROM raw" for c in SKETCHED)


@query("distinct_sketches", _DISTINCT)
def distinct_sketches(spark, sf):
    """Merged daily sketches against the exact numbers: within three standard errors."""
    trips = src.trips(spark, sf).withColumn("day", F.col("start_date").cast("date"))
    kept = materialise(sketches.distinct_sketches(trips, SKETCHED, ["day"]), "day-sketches")
    estimates = sketches.distinct_estimates(kept, SKETCHED).withColumnRenamed("column", "_column")
    exact = profile.distinct_counts(trips, SKETCHED)
    apart = F.abs(F.col("estimate") - F.col("nunique"))
    within = apart <= 3 * sketches.STANDARD_ERROR * F.col("nunique") + 1
    return exact.join(estimates, F.col("column") == F.col("_column")).select("column", "nunique", within.alias("within"))


@query("station_averages_colocated", like="station_averages_written")
def station_averages_colocated(spark, sf):
    """Trips and averages stored by station and day, joined where they lie."""
    trips, keys = _typed(spark, sf), [windows.STATION, windows.DAY]
    averages = windows.station_trailing_avg(trips, 7, 90.0)
    stored = [colocated.write_colocated(df, name, keys, 16) for df, name in ((trips, "trips"), (averages, "averages"))]
    return attach_station_avg(*stored).select("seq_id", "strt_statn", "avg_duration_prev_7days")


def request_bodies(spark, sf):
    """Bodies with unknown, nested and wrong-typed fields; every eleventh is a JSON array."""
    number = F.col("request_id")
    client = F.struct(F.lit("web").alias("app"), (number % 5).cast("int").alias("build")).alias("client")
    others = [F.col(name) for name in REQUEST_FIELDS if name != "dow"]
    plain = F.to_json(F.struct(*REQUEST_FIELDS, client, F.lit("a note").alias("note")))
    nested = F.to_json(F.struct(*others, F.struct(F.col("dow").alias("day")).alias("dow"), client))
    body = F.when(number % 11 == 0, F.concat(F.lit("["), plain, F.lit("]"))).when(number % 7 == 0, nested).otherwise(plain)
    return src.requests(spark, sf).select("request_id", body.alias("body"))


@query(
    "request_variants",
    """SELECT request_id, CASE WHEN request_id % 7 <> 0 AND request_id % 11 <> 0 THEN dow END AS dow,
              CASE WHEN request_id % 11 = 0 THEN 'body: not valid JSON' ELSE array_to_string(list_sort(list_concat(
                list_filter(string_split(reasons, '; '), lambda x: x <> '' AND (request_id % 7 <> 0 OR x NOT LIKE 'dow:%')),
                CASE WHEN request_id % 7 = 0 THEN ['dow: not valid'] ELSE [] END)), '; ') END AS reasons,
              CASE WHEN request_id % 11 = 0 THEN NULL WHEN request_id % 7 = 0 THEN 'client' ELSE 'client,note' END AS unknown,
              CASE WHEN request_id % 11 <> 0 THEN CAST(request_id % 5 AS INTEGER) END AS build
       FROM checked""",
)
def request_variants(spark, sf):
    """Unknown fields stay as variants, of which a path is read; wrong types are reasons."""
    checked = scoring.validate(files.parse_request_variants(request_bodies(spark, sf)))
    extra = F.col(files.EXTRA)
    return checked.select(
        "request_id",
        "dow",
        F.array_join(F.array_sort("reasons"), "; ").alias("reasons"),
        F.array_join(F.array_sort(F.map_keys(extra)), ",").alias("unknown"),
        F.try_variant_get(extra["client"], "$.build", "int").alias("build"),
    )

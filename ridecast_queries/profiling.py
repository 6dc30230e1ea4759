"""Profiles, descriptions, histograms, trends and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridecast.functions import flags, times
from ridecast.operators import profile, projection, windows
from ridecast.operators.ranks import exact_quantiles
from ridecast.plans import prepare
from ridecast.sources import driver_tables as src
from ridecast_queries.preparation import cleaned, stored_training, study, with_fixed
from ridecast_queries.registry import fp, query


def raw_minutes(spark, sf):
    return projection.with_minutes(src.trips(spark, sf))


def profiled(df, keys, target="duration_min"):
    return profile.group_profile(df, keys, target)


def profile_sql(key: str, view: str, target: str = "duration_min", expression: str | None = None) -> str:
    return f"""SELECT {key}, count({target}) AS {target}_count, avg({target}) AS {target}_mean
               FROM (SELECT {target}, {expression or key} AS {key} FROM {view}) v WHERE {key} IS NOT NULL GROUP BY 1"""


@query("near_zero_rain", 'SELECT "DATE", "HPCP", has_trace FROM wx WHERE "HPCP" < 0.0001')
def near_zero_rain(spark, sf):
    return projection.near_zero(prepare.prepare_weather(src.weather(spark, sf)), "HPCP")


@query(
    "casual_birth_count",
    "SELECT count(birth_date) AS birth_dates FROM raw WHERE subsc_type = 'Casual'",
)
def casual_birth_count(spark, sf):
    casual = src.trips(spark, sf).where(F.col("subsc_type") == "Casual")
    return casual.agg(F.count("birth_date").alias("birth_dates"))


_TRIP_COLUMNS = (
    "seq_id", "hubway_id", "duration", "start_date", "strt_statn", "end_date", "end_statn", "bike_nr",
    "subsc_type", "zip_code", "birth_date", "gender",
)


@query(
    "non_null_by_status",
    "SELECT status, " + ", ".join(f"count({c}) AS {c}_count" for c in _TRIP_COLUMNS) + " FROM raw GROUP BY 1",
)
def non_null_by_status(spark, sf):
    return profile.non_null_counts(src.trips(spark, sf), "status")


@query("profile_by_station", profile_sql("strt_statn", "raw", "duration"))
def profile_by_station(spark, sf):
    return profiled(src.trips(spark, sf), ["strt_statn"], "duration")


@query("profile_by_subscription", profile_sql("subsc_type", "raw", "duration"))
def profile_by_subscription(spark, sf):
    return profiled(src.trips(spark, sf), ["subsc_type"], "duration")


@query("profile_by_registered", profile_sql("is_registered", "study"))
def profile_by_registered(spark, sf):
    return profiled(study(spark, sf), ["is_registered"])


@query("profile_by_birth_year", profile_sql("birth_date", "raw", "duration"))
def profile_by_birth_year(spark, sf):
    return profile.sort_by(profiled(src.trips(spark, sf), ["birth_date"], "duration"), F.asc("birth_date"))


@query(
    "profile_by_gender_transposed",
    """WITH g AS (SELECT gender, count(duration) AS n, avg(duration) AS m FROM raw WHERE gender IS NOT NULL GROUP BY 1)
       SELECT gender, 'duration_count' AS stat, CAST(n AS DOUBLE) AS value FROM g
       UNION ALL SELECT gender, 'duration_mean', m FROM g""",
)
def profile_by_gender_transposed(spark, sf):
    by_gender = profiled(src.trips(spark, sf), ["gender"], "duration")
    return projection.transpose(by_gender, ["gender"], ["duration_count", "duration_mean"])


@query("profile_by_weekday", profile_sql("dow", "study"))
def profile_by_weekday(spark, sf):
    return profiled(study(spark, sf), ["dow"])


@query("profile_by_month", profile_sql("month", "study", expression="CAST(month(start_date) AS INTEGER)"))
def profile_by_month(spark, sf):
    return profiled(study(spark, sf), ["month"])


@query("profile_by_day", profile_sql("start_date_trunc", "study"))
def profile_by_day(spark, sf):
    return profiled(study(spark, sf), [windows.DAY])


@query(
    "profile_by_rain",
    """SELECT has_precip_data, "HPCP" > 0 AS has_rain, count(duration_min) AS duration_min_count,
              avg(duration_min) AS duration_min_mean FROM study GROUP BY 1, 2""",
)
def profile_by_rain(spark, sf):
    rainy = study(spark, sf).withColumn("has_rain", flags.above(F.col("HPCP"), 0.0))
    return profiled(rainy, ["has_precip_data", "has_rain"])


@query(
    "station_status_history",
    """SELECT n_name AS station, count(*) AS "count",
              count(DISTINCT CASE WHEN s_acctbal >= 0 THEN 'Existing' ELSE 'Removed' END) AS nunique,
              array_to_string(list_sort(list(DISTINCT CASE WHEN s_acctbal >= 0 THEN 'Existing' ELSE 'Removed' END)), ',')
                AS "unique"
       FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
)
def station_status_history(spark, sf):
    history = profile.distinct_history(src.stations(spark, sf), "station", "status")
    ordered = profile.sort_by(history, F.desc("count"), F.desc("nunique"))
    return ordered.withColumn("unique", F.array_join("unique", ","))


@query(
    "distinct_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nunique, count(DISTINCT {c}) <= 1 AS is_constant FROM raw"
        for c in ("status", "subsc_type", "gender", "bike_nr", "strt_statn")
    ),
)
def distinct_counts(spark, sf):
    return profile.distinct_counts(src.trips(spark, sf), ["status", "subsc_type", "gender", "bike_nr", "strt_statn"])


@query("row_count", 'SELECT count(*) AS "rows" FROM raw')
def row_count(spark, sf):
    return profile.row_count(src.trips(spark, sf))


@query("value_range", 'SELECT min("DATE") AS "min", max("DATE") AS "max" FROM wx')
def value_range(spark, sf):
    return profile.value_range(src.weather(spark, sf), "DATE")


@query(
    "target_stats",
    f"""SELECT quantile_cont(duration_min, 0.5) AS median, avg(duration_min) AS mean,
               {fp("stddev_samp(duration_min)", "std")} FROM cleaned""",
)
def target_stats(spark, sf):
    return with_fixed(profile.target_stats(cleaned(spark, sf), "duration_min"), "std")


_PROBS = [0.05, 0.5, 0.95, 0.98]


def quantile_sql(view: str, value: str, key: str | None = None) -> str:
    lead, tail = (f"{key}, ", f"WHERE {value} IS NOT NULL GROUP BY {key}") if key else ("", "")
    return " UNION ALL ".join(
        f"""SELECT {lead}CAST({p} AS DOUBLE) AS prob, {fp(f"quantile_cont({value}, CAST({p} AS DOUBLE))", "quantile")}
            FROM {view} {tail}"""
        for p in _PROBS
    )


@query("duration_quantiles", quantile_sql("raw", "duration"))
def duration_quantiles(spark, sf):
    return with_fixed(exact_quantiles(src.trips(spark, sf), "duration", _PROBS), "quantile")


@query("duration_quantiles_by_station", quantile_sql("typed", "duration_min", "strt_statn"))
def duration_quantiles_by_station(spark, sf):
    trips = prepare.typed_trips(src.trips(spark, sf))
    return with_fixed(exact_quantiles(trips, "duration_min", _PROBS, ["strt_statn"]), "quantile")


def describe_sql(columns: list[str], percentiles: list[float], view: str) -> str:
    def one(column: str) -> str:
        quantiles = ", ".join(
            fp(f'quantile_cont("{column}", CAST({p} AS DOUBLE))', f"{p * 100:g}%") for p in percentiles
        )
        return f"""SELECT '{column}' AS "column", count("{column}") AS "count", {fp(f'avg("{column}")', "mean")},
                   {fp(f'stddev_samp("{column}")', "std")}, CAST(min("{column}") AS DOUBLE) AS "min", {quantiles},
                   CAST(max("{column}") AS DOUBLE) AS "max" FROM {view}"""

    return " UNION ALL ".join(one(column) for column in columns)


def described(df, columns, percentiles):
    table = profile.describe(df, columns, percentiles)
    names = [name for name in table.columns if name in ("mean", "std") or name.endswith("%")]
    return with_fixed(table, *names)


_NUMBERS = ["duration_min", "HPCP", "is_registered", "has_trace", "has_precip_data", "strt_statn", "end_statn"]


@query("describe_numeric", describe_sql(_NUMBERS, [0.25, 0.5, 0.75, 0.95], "training"))
def describe_numeric(spark, sf):
    return described(stored_training(spark, sf), _NUMBERS, [0.25, 0.5, 0.75, 0.95])


@query("describe_duration", describe_sql(["duration"], [0.0, 0.5, 0.75, 0.95, 0.99], "(SELECT * FROM raw WHERE strt_statn IS NOT NULL) r"))
def describe_duration(spark, sf):
    kept = projection.with_station(src.trips(spark, sf))
    return described(kept, ["duration"], [0.0, 0.5, 0.75, 0.95, 0.99])


@query("describe_prices", describe_sql(["l_extendedprice", "l_quantity", "l_discount", "l_tax"], [0.25, 0.5, 0.75], "lineitem"))
def describe_prices(spark, sf):
    columns = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    return described(src.table(spark, sf, "lineitem"), columns, [0.25, 0.5, 0.75])


@query(
    "info_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null FROM raw"
        for c, t in {
            "seq_id": "bigint", "hubway_id": "bigint", "status": "string", "duration": "int",
            "start_date": "timestamp_ntz", "strt_statn": "int", "end_date": "timestamp_ntz", "end_statn": "int",
            "bike_nr": "string", "subsc_type": "string", "zip_code": "string", "birth_date": "int", "gender": "string",
        }.items()
    ),
)
def info_counts(spark, sf):
    return profile.info(src.trips(spark, sf))


def histogram_sql(column: str, view: str, bins: int = 10) -> str:
    return f"""WITH v AS (SELECT CAST({column} AS DOUBLE) AS x FROM {view} WHERE {column} IS NOT NULL),
        b AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / CAST({bins} AS DOUBLE) AS step FROM v),
        e AS (SELECT CAST(i AS INTEGER) AS bin, lo + i * step AS low,
                     CASE WHEN i + 1 = {bins} THEN hi ELSE lo + (i + 1) * step END AS high, i
              FROM b CROSS JOIN range({bins}) r(i))
        SELECT bin, low, high, count(x) AS "count"
        FROM e LEFT JOIN v ON x >= low AND (x < high OR (bin = {bins - 1} AND x = high)) GROUP BY ALL"""


@query("hist_duration", histogram_sql("duration_min", "typed"))
def hist_duration(spark, sf):
    return profile.histogram(prepare.typed_trips(src.trips(spark, sf)), "duration_min")


@query("hist_rain", histogram_sql('"HPCP"', '(SELECT "HPCP" FROM study WHERE "HPCP" > 0) r'))
def hist_rain(spark, sf):
    rainy = study(spark, sf).where(flags.above(F.col("HPCP"), 0.0))
    return profile.histogram(rainy, "HPCP")


@query(
    "hist_unplaced_days",
    histogram_sql("days", "(SELECT duration / CAST(86400 AS DOUBLE) AS days FROM raw WHERE strt_statn IS NULL OR end_statn IS NULL) d"),
)
def hist_unplaced_days(spark, sf):
    rows = projection.rows_with_any_null(src.trips(spark, sf), ["strt_statn", "end_statn"])
    return profile.histogram(rows.select((F.col("duration") / 86400.0).alias("days")), "days")


@query("hist_station_means", histogram_sql("m", "(SELECT avg(duration) AS m FROM raw WHERE strt_statn IS NOT NULL GROUP BY strt_statn) d"))
def hist_station_means(spark, sf):
    return profile.histogram(profiled(src.trips(spark, sf), ["strt_statn"], "duration"), "duration_mean")


@query("hist_flag", "SELECT has_trace, count(*) AS \"count\" FROM wx GROUP BY 1")
def hist_flag(spark, sf):
    return profile.value_histogram(prepare.prepare_weather(src.weather(spark, sf)), "has_trace")


@query("hist_measurement_flag", "SELECT 'T' AS \"Measurement_Flag\", count(*) AS \"count\" FROM wx WHERE has_trace = 1 HAVING count(*) > 0")
def hist_measurement_flag(spark, sf):
    return profile.value_histogram(src.weather(spark, sf), "Measurement_Flag")


@query("trips_per_day", "SELECT CAST(start_date AS DATE) AS start_date_trunc, count(*) AS \"count\" FROM raw GROUP BY 1")
def trips_per_day(spark, sf):
    days = src.trips(spark, sf).select(times.day_of(F.col("start_date")).alias(windows.DAY))
    return profile.value_histogram(days, windows.DAY)


@query(
    "weather_completeness",
    """SELECT min("DATE") AS "first", max("DATE") AS "last", epoch(max("DATE") - min("DATE")) / 3600 AS expected_rows,
              count(*) AS actual_rows, count(*) < epoch(max("DATE") - min("DATE")) / 3600 AS is_short FROM wx""",
)
def weather_completeness(spark, sf):
    return profile.completeness(src.weather(spark, sf))


_GAPS_SQL = """SELECT "DATE", CAST(1 AS BIGINT) AS readings,
                      epoch("DATE" - lag("DATE") OVER (ORDER BY "DATE")) / 3600 AS "DATE_delta_hours" FROM wx"""


@query("weather_gaps", _GAPS_SQL)
def weather_gaps(spark, sf):
    return windows.reading_gaps(src.weather(spark, sf))


@query("describe_gaps", describe_sql(["DATE_delta_hours"], [0.5, 0.8, 0.85, 0.95], f"({_GAPS_SQL}) g"))
def describe_gaps(spark, sf):
    gaps = windows.reading_gaps(src.weather(spark, sf), each_reading=True)
    return described(gaps, ["DATE_delta_hours"], [0.5, 0.8, 0.85, 0.95])


@query(
    "order_gaps",
    """SELECT l_returnflag, l_orderkey,
              l_orderkey - lag(l_orderkey) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey) AS l_orderkey_delta_hours
       FROM lineitem""",
)
def order_gaps(spark, sf):
    """Many repeated readings: each order number taken as an hour count, several lines per order."""
    lines = src.table(spark, sf, "lineitem").withColumn(
        "l_orderkey", F.lit("1900-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("l_orderkey").cast("int"))
    )
    gaps = windows.reading_gaps(lines, "l_orderkey", ["l_returnflag"], each_reading=True)
    start = F.lit("1900-01-01").cast("timestamp_ntz")
    return gaps.withColumn("l_orderkey", times.hours_between(start, F.col("l_orderkey")).cast("bigint"))


@query(
    "event_gaps_by_user",
    """WITH t AS (SELECT user_id, ts, count(*) AS readings FROM events GROUP BY 1, 2)
       SELECT user_id, ts, readings,
              epoch_us(ts) IS NOT NULL AND lag(ts) OVER w IS NULL AS is_first,
              (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / CAST(1000000 AS DOUBLE) / CAST(3600 AS DOUBLE) AS ts_delta_hours
       FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
def event_gaps_by_user(spark, sf):
    gaps = windows.reading_gaps(src.table(spark, sf, "events"), "ts", ["user_id"])
    return gaps.withColumn("is_first", F.col("ts_delta_hours").isNull())


@query(
    "daily_trend_7",
    f"""WITH d AS (SELECT start_date_trunc, count(duration_min) AS "count", avg(duration_min) AS "mean"
                   FROM study WHERE strt_statn > 0 GROUP BY 1)
        SELECT start_date_trunc, "count", "mean",
               CASE WHEN count(*) OVER w = 7 THEN {fp('avg("mean") OVER w')} END AS duration_min_7davg
        FROM d WINDOW w AS (ORDER BY start_date_trunc ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def daily_trend_7(spark, sf):
    placed = projection.positive_key(study(spark, sf), windows.STATION)
    return with_fixed(windows.daily_trend(placed), "duration_min_7davg")


@query("newest_trips", "SELECT seq_id, start_date, strt_statn FROM raw ORDER BY start_date DESC, seq_id LIMIT 5")
def newest_trips(spark, sf):
    return profile.newest(src.trips(spark, sf).select("seq_id", "start_date", "strt_statn"), "start_date", "seq_id")


@query(
    "trip_quality",
    """SELECT 'open_trip' AS rule, count(*) FILTER (status <> 'closed') AS violations FROM raw
       UNION ALL SELECT 'no_start_station', count(*) FILTER (strt_statn IS NULL) FROM raw
       UNION ALL SELECT 'no_end_station', count(*) FILTER (end_statn IS NULL) FROM raw
       UNION ALL SELECT 'birth_date_of_casual', count(*) FILTER (subsc_type <> 'Registered' AND birth_date IS NOT NULL) FROM raw""",
)
def trip_quality(spark, sf):
    return profile.quality_report(src.trips(spark, sf), profile.trip_rules())

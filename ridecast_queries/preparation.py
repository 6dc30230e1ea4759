"""Preparation: columns, flags, averages, weather and cleaning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ridecast.functions import flags, times
from ridecast.operators import cleaning, joins, projection, windows
from ridecast.plans import prepare
from ridecast.schemas import FEATURES, TARGET, TRAINING
from ridecast.session import written_once
from ridecast.sources import driver_tables as src
from ridecast_queries.registry import fp, query


def training(spark, sf):
    return prepare.training_table(src.trips(spark, sf), src.weather(spark, sf))


def stored_training(spark, sf):
    """The training table as the preparation leaves it to the studies: written once, read by column.

    The station averages and the hourly weather are written before it. Tables that are read
    back have a size that Spark's broadcast check can see, so the trips are not shuffled
    where those are small.
    """

    def build():
        raw = src.trips(spark, sf)
        averages = windows.station_trailing_avg(prepare.typed_trips(raw), 7, 90.0)
        averages = written_once(spark, "station-averages", sf, lambda: averages)
        weather = written_once(spark, "weather", sf, lambda: src.weather(spark, sf))
        return prepare.training_table(raw, weather, averages)

    return written_once(spark, "training-table", sf, build)


def cleaned(spark, sf):
    return cleaning.clean(stored_training(spark, sf))


def study_input(spark, sf):
    """The training table with the derived columns of the exploratory study."""
    start = F.col("start_date")
    return stored_training(spark, sf).withColumns(
        {windows.DAY: times.day_of(start), "dow": times.weekday(start), "month": times.month_of(start)}
    )


def study(spark, sf):
    return cleaning.clean(study_input(spark, sf), cleaning.STUDY_STEPS)


def with_fixed(df, *names):
    """Six digits for columns that libm or the order of a sum may change in the last bit."""
    return df.withColumns({name: flags.fixed_point(F.col(f"`{name}`")) for name in names})


@query("trip_minutes", "SELECT seq_id, duration / CAST(60 AS DOUBLE) AS duration_min FROM raw")
def trip_minutes(spark, sf):
    return projection.with_minutes(src.trips(spark, sf)).select("seq_id", "duration_min")


@query("drop_columns", "SELECT seq_id, start_date, strt_statn, end_statn FROM raw")
def drop_columns(spark, sf):
    drops = [name for name in prepare.TRIP_DROPS if name not in (windows.DAY, "dow")]
    return projection.drop_columns(src.trips(spark, sf), drops)


@query("trips_with_station", "SELECT seq_id, strt_statn FROM raw WHERE strt_statn IS NOT NULL")
def trips_with_station(spark, sf):
    return projection.with_station(src.trips(spark, sf)).select("seq_id", "strt_statn")


@query("registered_flag", "SELECT seq_id, is_registered FROM typed")
def registered_flag(spark, sf):
    return prepare.typed_trips(src.trips(spark, sf)).select("seq_id", "is_registered")


@query("capped_trips", "SELECT seq_id, duration_min FROM typed WHERE duration_min <= 90")
def capped_trips(spark, sf):
    trips = prepare.typed_trips(src.trips(spark, sf))
    return projection.at_most(trips, "duration_min", 90.0).select("seq_id", "duration_min")


@query("day_floor", "SELECT seq_id, start_date, start_date_trunc FROM typed")
def day_floor(spark, sf):
    return prepare.typed_trips(src.trips(spark, sf)).select("seq_id", "start_date", windows.DAY)


@query(
    "label_match",
    """SELECT event_id, event_type = 'purchase' AS is_purchase,
              CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS purchase_flag,
              split_part(props, ':', 1) AS props_key FROM events""",
)
def label_match(spark, sf):
    label = F.col("event_type")
    return src.table(spark, sf, "events").select(
        "event_id",
        (label == "purchase").alias("is_purchase"),
        flags.label_flag(label, "purchase").alias("purchase_flag"),
        F.split("props", ":")[0].alias("props_key"),
    )


@query(
    "station_day_totals",
    """SELECT strt_statn, start_date_trunc, tot AS daily_trips_total_duration, n AS daily_trips_count FROM days90""",
)
def station_day_totals(spark, sf):
    return windows.station_day_totals(prepare.typed_trips(src.trips(spark, sf)), 90.0)


@query(
    "station_lag",
    """SELECT strt_statn, start_date_trunc,
              lag(tot) OVER w AS daily_trips_total_duration_lag1, lag(n) OVER w AS daily_trips_count_lag1
       FROM days90 WINDOW w AS (PARTITION BY strt_statn ORDER BY start_date_trunc)""",
)
def station_lag(spark, sf):
    days = windows.station_day_totals(prepare.typed_trips(src.trips(spark, sf)), 90.0)
    return windows.group_lag(days, [windows.STATION], windows.DAY, [windows.TOTAL, windows.COUNT])


@query("trailing_avg_7", "SELECT * FROM avg7")
def trailing_avg_7(spark, sf):
    return windows.station_trailing_avg(prepare.typed_trips(src.trips(spark, sf)), 7, 90.0)


@query(
    "trailing_avg_4_uncapped",
    """WITH days AS (SELECT strt_statn, start_date_trunc, coalesce(sum(duration_min), 0) AS tot,
                            count(duration_min) AS n FROM typed GROUP BY 1, 2),
            avg4 AS (SELECT strt_statn, start_date_trunc,
                            CASE WHEN count(*) OVER w = 4 THEN sum(tot) OVER w / nullif(CAST(sum(n) OVER w AS DOUBLE), 0)
                            END AS avg_duration_prev_7days_prev_days
                     FROM days WINDOW w AS (PARTITION BY strt_statn ORDER BY start_date_trunc
                                            ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
       SELECT p.seq_id, p.strt_statn, p.start_date_trunc, p.avg_duration_prev_7days, a.avg_duration_prev_7days_prev_days
       FROM prep p LEFT JOIN avg4 a ON p.strt_statn = a.strt_statn AND p.start_date_trunc = a.start_date_trunc""",
)
def trailing_avg_4_uncapped(spark, sf):
    return prepare.station_average_study(prepare.prepare_trips(src.trips(spark, sf))).select(
        "seq_id", windows.STATION, windows.DAY, "avg_duration_prev_7days", "avg_duration_prev_7days_prev_days"
    )


@query(
    "trips_with_trailing_avg",
    f"""SELECT seq_id, start_date, strt_statn, end_statn, duration_min, is_registered, avg_duration_prev_7days,
               {fp("dow_sin", "dow_sin")}, {fp("dow_cos", "dow_cos")} FROM prep""",
)
def trips_with_trailing_avg(spark, sf):
    return with_fixed(prepare.prepare_trips(src.trips(spark, sf)), "dow_sin", "dow_cos")


@query("weather_prepared", 'SELECT "DATE", "HPCP", has_trace FROM wx')
def weather_prepared(spark, sf):
    return prepare.prepare_weather(src.weather(spark, sf))


@query(
    "weather_key",
    "SELECT seq_id, date_trunc('hour', start_date - INTERVAL 1 MINUTE) AS weather_hour FROM typed",
)
def weather_key(spark, sf):
    trips = prepare.typed_trips(src.trips(spark, sf))
    return trips.select("seq_id", times.weather_key(F.col("start_date")).alias("weather_hour"))


@query(
    "trips_with_weather",
    """SELECT p.seq_id, p.wkey AS date_to_merge_weather_data, w."DATE", w."HPCP", w.has_trace
       FROM prep p LEFT JOIN wx w ON p.wkey = w."DATE" """,
)
def trips_with_weather(spark, sf):
    trips = prepare.typed_trips(src.trips(spark, sf))
    joined = joins.join_weather(trips, prepare.prepare_weather(src.weather(spark, sf)))
    return joined.select("seq_id", "date_to_merge_weather_data", "DATE", "HPCP", "has_trace")


@query("weather_coverage", "SELECT seq_id, has_precip_data FROM training")
def weather_coverage(spark, sf):
    weather = prepare.prepare_weather(src.weather(spark, sf))
    joined = joins.join_weather(prepare.typed_trips(src.trips(spark, sf)), weather)
    return joins.with_coverage(joined, weather).select("seq_id", "has_precip_data")


@query(
    "training_table",
    f"""SELECT seq_id, start_date, strt_statn, end_statn, duration_min, is_registered, avg_duration_prev_7days,
               {fp("dow_sin", "dow_sin")}, {fp("dow_cos", "dow_cos")}, "HPCP", has_trace, has_precip_data FROM training""",
)
def training_table(spark, sf):
    return with_fixed(training(spark, sf), "dow_sin", "dow_cos").select(*TRAINING.names)


@query("covered_trips", 'SELECT seq_id, duration_min, "HPCP", has_trace FROM covered')
def covered_trips(spark, sf):
    kept = cleaning.clean(training(spark, sf), [cleaning.KeepFlag("has_precip_data")])
    return kept.select("seq_id", "duration_min", "HPCP", "has_trace")


@query("trim_p95", "SELECT seq_id, duration_min, avg_duration_prev_7days FROM cleaned")
def trim_p95(spark, sf):
    return cleaned(spark, sf).select("seq_id", "duration_min", "avg_duration_prev_7days")


@query("trim_p98", "SELECT seq_id, duration_min, avg_duration_prev_7days FROM study")
def trim_p98(spark, sf):
    return study(spark, sf).select("seq_id", "duration_min", "avg_duration_prev_7days")


@query("drop_null_features", "SELECT seq_id, duration_min, avg_duration_prev_7days FROM nonnull")
def drop_null_features(spark, sf):
    kept = cleaning.clean(study_input(spark, sf), [cleaning.DropNulls(cleaning.STUDY_COLUMNS)])
    return kept.select("seq_id", "duration_min", "avg_duration_prev_7days")


@query(
    "any_null_rows",
    "SELECT seq_id, strt_statn, end_statn, duration FROM raw WHERE strt_statn IS NULL OR end_statn IS NULL",
)
def any_null_rows(spark, sf):
    rows = projection.rows_with_any_null(src.trips(spark, sf), ["strt_statn", "end_statn"])
    return rows.select("seq_id", "strt_statn", "end_statn", "duration")


@query(
    "drop_audit",
    """WITH q AS (SELECT quantile_cont(duration_min, 0.95) AS bound FROM covered),
            f AS (SELECT has_precip_data = 1 AS a,
                         coalesce(duration_min > 0 AND duration_min <= bound, FALSE) AS b,
                         avg_duration_prev_7days IS NOT NULL AS c FROM training CROSS JOIN q)
       SELECT 1 AS step, 'has_precip_data == 1' AS rule, count(*) FILTER (NOT a) AS removed, count(*) AS total FROM f
       UNION ALL
       SELECT 2, '0 < duration_min <= p95', count(*) FILTER (a AND NOT b), count(*) FILTER (a) FROM f
       UNION ALL
       SELECT 3, 'avg_duration_prev_7days not null', count(*) FILTER (a AND b AND NOT c), count(*) FILTER (a AND b) FROM f""",
)
def drop_audit(spark, sf):
    return cleaning.audit(stored_training(spark, sf))


@query(
    "drop_audit_study",
    """WITH q AS (SELECT quantile_cont(duration_min, 0.98) AS bound FROM nonnull),
            f AS (SELECT avg_duration_prev_7days IS NOT NULL AND duration_min IS NOT NULL AS a,
                         coalesce(duration_min > 0 AND duration_min <= bound, FALSE) AS b FROM training CROSS JOIN q)
       SELECT 1 AS step, 'is_registered, dow, has_trace, has_precip_data, avg_duration_prev_7days, HPCP, duration_min not null' AS rule,
              count(*) FILTER (NOT a) AS removed, count(*) AS total FROM f
       UNION ALL
       SELECT 2, '0 < duration_min <= p98', count(*) FILTER (a AND NOT b), count(*) FILTER (a) FROM f""",
)
def drop_audit_study(spark, sf):
    return cleaning.audit(study_input(spark, sf), cleaning.STUDY_STEPS)


@query("positive_station", "SELECT seq_id, strt_statn FROM raw WHERE strt_statn > 0")
def positive_station(spark, sf):
    return projection.positive_key(src.trips(spark, sf), "strt_statn").select("seq_id", "strt_statn")


@query("flag_as_string", "SELECT seq_id, CAST(is_registered AS VARCHAR) AS is_registered FROM training")
def flag_as_string(spark, sf):
    return training(spark, sf).select("seq_id", flags.as_category(F.col("is_registered")).alias("is_registered"))


@query(
    "feature_target",
    f"""SELECT avg_duration_prev_7days, "HPCP", is_registered, {fp("dow_sin", "dow_sin")}, {fp("dow_cos", "dow_cos")},
               has_trace, duration_min FROM training""",
)
def feature_target(spark, sf):
    return projection.feature_target(
        with_fixed(training(spark, sf), "dow_sin", "dow_cos"), FEATURES, TARGET
    )


@query(
    "cyclic_weekday",
    f"""SELECT seq_id, dow, {fp("dow_sin", "dow_sin")}, {fp("dow_cos", "dow_cos")} FROM prep""",
)
def cyclic_weekday(spark, sf):
    trips = prepare.typed_trips(src.trips(spark, sf)).withColumn("dow", times.weekday(F.col("start_date")))
    return with_fixed(prepare.with_weekday_cycle(trips).select("seq_id", "dow", "dow_sin", "dow_cos"), "dow_sin", "dow_cos")


@query("log_rain", f"""SELECT "DATE", {fp('ln(1 + "HPCP")', "HPCP_log")} FROM wx""")
def log_rain(spark, sf):
    weather = prepare.prepare_weather(src.weather(spark, sf))
    return with_fixed(weather.select("DATE", flags.log_rain(F.col("HPCP")).alias("HPCP_log")), "HPCP_log")


@query(
    "daily_refresh_with_fallback",
    """WITH d AS (SELECT * FROM days90 WHERE start_date_trunc < DATE '2024-01-08'),
            r AS (SELECT *, row_number() OVER (PARTITION BY strt_statn ORDER BY start_date_trunc DESC) AS age FROM d),
            g AS (SELECT sum(tot) / nullif(CAST(sum(n) AS DOUBLE), 0) AS overall FROM d)
       SELECT strt_statn, DATE '2024-01-08' AS as_of,
              coalesce(CASE WHEN count(*) = 7 THEN sum(tot) / nullif(CAST(sum(n) AS DOUBLE), 0) END, max(overall))
                AS avg_duration_prev_7days
       FROM r CROSS JOIN g WHERE age <= 7 GROUP BY strt_statn""",
)
def daily_refresh_with_fallback(spark, sf):
    trips = prepare.typed_trips(src.trips(spark, sf))
    return windows.daily_station_features(trips, dt.date(2024, 1, 8), fallback_to_global=True)

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridecast.operators import joins, projection
from ridecast.plans import prepare
from ridecast.schemas import TRAINING
from ridecast.sources import files
from ridecast.operators.windows import station_trailing_avg
from tests import fixtures as fx

HOUR = dt.timedelta(hours=1)


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(fx.edge_trips(), fx.TRIP_DDL)


def by_id(df, column):
    return {r.seq_id: r[column] for r in df.select("seq_id", column).collect()}


def test_typed_trips(raw):
    df = prepare.typed_trips(raw)
    assert 1005 not in by_id(df, "strt_statn")  # no start station
    assert by_id(df, "end_statn")[1007] is None  # no end station is kept
    assert by_id(df, "duration_min")[1001] == 90.0
    assert by_id(df, "duration_min")[1003] is None
    assert by_id(df, "is_registered")[1002] == 0 and by_id(df, "is_registered")[1000] == 1
    assert by_id(df, "start_date")[1001] == dt.datetime(2012, 3, 1, 12, 1)
    assert df.schema["start_date"].dataType.typeName() == "timestamp_ntz"


def test_prepare_trips_columns(raw):
    assert set(prepare.prepare_trips(raw).columns) == {
        "seq_id", "start_date", "strt_statn", "end_statn", "duration_min", "is_registered",
        "avg_duration_prev_7days", "dow_sin", "dow_cos",
    }


def test_typed_input_equals_text_input(spark, raw):
    typed = raw.withColumn("start_date", F.to_timestamp_ntz("start_date", F.lit("M/d/yyyy H:mm:ss")))
    assert sorted(prepare.prepare_trips(typed).collect(), key=str) == sorted(prepare.prepare_trips(raw).collect(), key=str)


def test_prepare_weather(spark):
    rows = [fx.reading(fx.DAY0, 0.0, "T"), fx.reading(fx.DAY0 + HOUR, 0.2, "x"), fx.reading(fx.DAY0 + 2 * HOUR, 0.3)]
    raw = spark.createDataFrame(rows, fx.WEATHER_DDL)
    df = prepare.prepare_weather(raw)
    assert df.columns == ["DATE", "HPCP", "has_trace"]
    assert [r.has_trace for r in df.orderBy("DATE").collect()] == [1, 0, 0]
    assert prepare.prepare_weather(raw, drop_unnecessary_columns=False).columns == [*raw.columns, "has_trace"]


def test_drop_columns_strict(raw):
    with pytest.raises(ValueError):
        projection.drop_columns(raw, ["nothing"])
    assert projection.drop_columns(raw, ["nothing", "gender"], strict=False).columns == raw.columns[:-1]


def weather_of(spark, rows):
    return prepare.prepare_weather(spark.createDataFrame([fx.reading(*r) for r in rows], fx.WEATHER_DDL))


def starts(spark, times):
    return spark.createDataFrame(list(enumerate(times)), "seq_id INT, start_date TIMESTAMP_NTZ")


def test_coverage_is_inclusive_on_the_lagged_hour(spark):
    first, last = fx.DAY0 + 10 * HOUR, fx.DAY0 + 14 * HOUR
    weather = weather_of(spark, [(first, 0.5), (fx.DAY0 + 12 * HOUR, None, "T"), (last, 0.25, "T")])
    minute = dt.timedelta(minutes=1)
    times = [
        first,  # lagged hour 9: before the first reading
        first + minute,  # lagged hour 10: the first reading
        first + HOUR + minute,  # covered hour without a reading
        fx.DAY0 + 12 * HOUR + minute,  # a reading with a null amount
        last + HOUR,  # lagged hour 14: the last reading
        last + HOUR + minute,  # lagged hour 15: after the last reading
    ]
    rows = joins.attach_weather(starts(spark, times), weather).orderBy("seq_id").collect()
    assert [r.has_precip_data for r in rows] == [0, 1, 1, 1, 1, 0]
    assert [r.HPCP for r in rows] == [0.0, 0.5, 0.0, 0.0, 0.25, 0.0]
    assert [r.has_trace for r in rows] == [0, 0, 0, 1, 1, 0]
    assert "DATE" not in rows[0].asDict()


def test_repeated_hour_repeats_trips(spark):
    weather = weather_of(spark, [(fx.DAY0, 0.5), (fx.DAY0, 0.7)])
    rows = joins.attach_weather(starts(spark, [fx.DAY0 + dt.timedelta(minutes=5)]), weather).collect()
    assert sorted(r.HPCP for r in rows) == [0.5, 0.7]


def test_training_table_schema_and_written_averages(spark, tmp_path):
    raw = spark.createDataFrame(fx.station_trips(), fx.TRIP_DDL)
    weather = spark.createDataFrame([fx.reading(fx.DAY0, 0.1)], fx.WEATHER_DDL)
    df = prepare.training_table(raw, weather).select(*TRAINING.names)
    assert [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in TRAINING.fields]
    path = str(tmp_path / "averages")
    files.write_station_averages(station_trailing_avg(prepare.typed_trips(raw), 7, 90.0), path)
    again = prepare.training_table(raw, weather, files.read_station_averages(spark, path)).select(*TRAINING.names)
    assert sorted(map(str, df.collect())) == sorted(map(str, again.collect()))
    # The written averages are small, so the trips are joined without a shuffle.
    plan = prepare.prepare_trips(raw, station_avg=files.read_station_averages(spark, path))
    assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()


def test_hot_station_day_is_split_by_aqe(spark):
    """A third of all trips on one station-day: the sorted join splits that partition."""
    trips = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("int").alias("strt_statn"),
        F.lit(dt.date(2012, 3, 1)).alias("start_date_trunc"),
        F.col("id").alias("seq_id"),
    )
    averages = spark.range(500).select(
        F.col("id").cast("int").alias("strt_statn"),
        F.lit(dt.date(2012, 3, 1)).alias("start_date_trunc"),
        (F.col("id") * 1.0).alias("avg_duration_prev_7days"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = joins.attach_station_avg(trips, averages)
        assert joined.where(F.col("avg_duration_prev_7days") == F.col("strt_statn")).count() == 300_000
        rows = joined.select("seq_id", "avg_duration_prev_7days")
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_repeated_weather_hours_are_refused(spark):


    hours = [dt.datetime(2012, 1, 1, h) for h in (1, 2, 2)]
    weather = spark.createDataFrame([(h, 0.1, 0) for h in hours], "DATE TIMESTAMP_NTZ, HPCP DOUBLE, has_trace INT")
    assert joins.with_unique_hours(weather.distinct()).count() == 2
    with pytest.raises(Exception, match="more than one reading at 2012-01-01 02"):
        joins.with_unique_hours(weather).collect()


def test_null_filters_reach_the_file(spark, tmp_path):
    from ridecast.operators import profile

    spark.createDataFrame([(1, 2.0), (None, 3.0)], "strt_statn INT, x DOUBLE").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for out in (projection.with_station(df), profile.group_profile(df, ["strt_statn"], "x")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(strt_statn)]" in plan

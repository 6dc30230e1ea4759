import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridecast.functions import flags, times


def one(spark, sql, *columns):
    return spark.sql(sql).select(*columns).first()


def test_trip_time_padded_and_unpadded(spark):
    row = one(
        spark,
        "SELECT '7/8/2011 9:05:42' a, '07/08/2011 09:05:42' b, '12/31/2012 23:59:59' c",
        *[times.parse_trip_time(F.col(c)) for c in "abc"],
        times.parse_trip_date(F.col("a")),
    )
    assert row[0] == row[1] == dt.datetime(2011, 7, 8, 9, 5)
    assert row[2] == dt.datetime(2012, 12, 31, 23, 59)
    assert row[3] == dt.date(2011, 7, 8)


def test_malformed_time_fails(spark):
    with pytest.raises(Exception):
        one(spark, "SELECT 'noon' a", times.parse_trip_time(F.col("a")))


def test_weather_and_iso_time(spark):
    row = one(
        spark,
        "SELECT '20110729 13:00' a, '2012-03-01 10:11:12' b",
        times.parse_weather_time(F.col("a")),
        times.parse_iso_time(F.col("b")),
    )
    assert row[0] == dt.datetime(2011, 7, 29, 13)
    assert row[1] == dt.datetime(2012, 3, 1, 10, 11, 12)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_floors_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist in New York on this day.
        row = one(
            spark,
            "SELECT TIMESTAMP_NTZ'2024-03-10 02:30:15.25' a, TIMESTAMP_NTZ'2024-03-10 03:00:00' b",
            times.floor_to_minute(F.col("a")).cast("string"),
            times.floor_to_hour(F.col("a")).cast("string"),
            times.hours_between(F.col("a"), F.col("b")),
            times.weather_key(F.col("b")).cast("string"),
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row[0] == "2024-03-10 02:30:00"
    assert row[1] == "2024-03-10 02:00:00"
    assert row[2] == pytest.approx((30 * 60 - 15.25) / 3600)
    assert row[3] == "2024-03-10 02:00:00"


def test_weather_key_lags_a_minute(spark):
    row = one(
        spark,
        "SELECT TIMESTAMP_NTZ'2012-03-01 12:00:00' a, TIMESTAMP_NTZ'2012-03-01 12:01:00' b, TIMESTAMP_NTZ'2012-03-01 00:00:00' c",
        *[times.weather_key(F.col(c)) for c in "abc"],
    )
    assert [r.hour for r in row] == [11, 12, 23]
    assert row[2].day == 29  # the day before, in a leap year


def test_weekday_starts_on_monday(spark):
    row = one(spark, "SELECT TIMESTAMP_NTZ'2011-07-28 10:12:00' a", times.weekday(F.col("a")), times.month_of(F.col("a")))
    assert tuple(row) == (3, 7)


def test_days_between_counts_seconds(spark):
    row = one(
        spark,
        "SELECT TIMESTAMP_NTZ'2012-03-01 00:00:00' a, TIMESTAMP_NTZ'2012-03-02 12:00:00' b",
        times.days_between(F.col("a"), F.col("b")),
    )
    assert row[0] == 1.5


def test_label_flag_and_threshold_treat_null_as_no(frame):
    rows = frame([("T",), ("x",), (None,)], "f STRING").select("f", flags.label_flag(F.col("f"), "T").alias("v")).collect()
    assert {r.f: r.v for r in rows} == {"T": 1, "x": 0, None: 0}
    rows = frame([(0.0,), (0.1,), (None,)], "x DOUBLE").select("x", flags.above(F.col("x"), 0.0).alias("v")).collect()
    assert {r.x: r.v for r in rows} == {0.0: False, 0.1: True, None: False}


def test_request_conversions(frame):
    texts = ["1", "true", "No", "maybe", " 5 ", "2.0", "2.5", "nan", None, "9999999999"]
    df = frame([(t,) for t in texts], "t STRING").select(
        "t",
        flags.to_boolean(F.col("t")).alias("b"),
        flags.to_number(F.col("t")).alias("x"),
        flags.to_whole_number(F.col("t")).alias("i"),
    )
    got = {r.t: (r.b, r.x, r.i) for r in df.collect()}
    assert got["1"] == (True, 1.0, 1)
    assert got["true"] == (True, 1.0, 1)
    assert got["No"] == (False, None, None)
    assert got["maybe"] == (None, None, None)
    assert got[" 5 "] == (None, 5.0, 5)
    assert got["2.0"] == (None, 2.0, 2)
    assert got["2.5"] == (None, 2.5, None)
    assert got["nan"] == (None, None, None)
    assert got[None] == (None, None, None)
    assert got["9999999999"][2] is None

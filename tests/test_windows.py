import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridecast.operators import windows
from ridecast.plans.prepare import typed_trips
from tests import fixtures as fx


def pandas_average(trips: pd.DataFrame, window: int, cap) -> pd.DataFrame:
    """The definition, written independently: per station, ratio of sums over the previous rows."""
    kept = trips if not cap else trips[trips.duration_min <= cap]
    days = kept.groupby(["strt_statn", "start_date_trunc"]).duration_min.agg(["sum", "count"]).reset_index()
    parts = []
    for _, station in days.groupby("strt_statn"):
        sums = station[["sum", "count"]].shift().rolling(window).sum()
        parts.append(station.assign(avg=sums["sum"] / sums["count"]))
    return pd.concat(parts)


@pytest.fixture(scope="module")
def trips(spark):
    return typed_trips(spark.createDataFrame(fx.station_trips() + fx.edge_trips(), fx.TRIP_DDL)).cache()


@pytest.mark.parametrize("window,cap", [(7, 90.0), (4, None), (4, 0.0), (1, 90.0)])
def test_trailing_average_matches_pandas(trips, window, cap):
    got = windows.station_trailing_avg(trips, window, cap).toPandas().set_index(["strt_statn", "start_date_trunc"])
    expected = pandas_average(trips.toPandas(), window, cap).set_index(["strt_statn", "start_date_trunc"])
    assert len(got) == len(expected)
    both = got.join(expected)
    assert (both.avg_duration_prev_7days.isna() == both.avg.isna()).all()
    assert np.allclose(both.avg_duration_prev_7days, both.avg, equal_nan=True, rtol=1e-12)


def test_first_active_days_are_null(trips):
    rows = windows.station_trailing_avg(trips, 7, 90.0).groupBy("strt_statn").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("avg_duration_prev_7days").isNull()).alias("nulls")
    )
    nulls = {r.strt_statn: (r.days, r.nulls) for r in rows.collect()}
    assert all(n == min(d, 7) for d, n in nulls.values())


def test_day_above_the_cap_is_not_active(trips):
    days = windows.station_day_totals(trips, 90.0).where("strt_statn = 1")
    found = {r.start_date_trunc: (r.daily_trips_total_duration, r.daily_trips_count) for r in days.collect()}
    assert found == {
        dt.date(2012, 3, 1): (100.0, 2),  # 10 + exactly 90 minutes
        dt.date(2012, 3, 2): (-1.0, 1),  # the null duration is not kept by the cap
        dt.date(2012, 3, 4): (10.0, 1),
    }


def test_null_durations_without_cap(frame):
    day = dt.date(2012, 3, 1)
    df = frame([(1, day, None), (1, day, None)], "strt_statn INT, start_date_trunc DATE, duration_min DOUBLE")
    assert tuple(windows.station_day_totals(df).first())[2:] == (0.0, 0)
    later = [(1, day + dt.timedelta(days=i), None) for i in range(3)]
    df = frame(later, "strt_statn INT, start_date_trunc DATE, duration_min DOUBLE")
    assert {r[2] for r in windows.station_trailing_avg(df, 2).collect()} == {None}  # 0 / 0 does not raise


def test_no_leakage_from_the_same_or_a_later_day(spark):
    rows = fx.station_trips()
    changed = [r if r[5] != 30 else (*r[:3], r[3] + 600, *r[4:]) for r in rows]
    cut = dt.date(2012, 3, 10)
    mixed = [b if dt.datetime.strptime(a[4], "%m/%d/%Y %H:%M:%S").date() >= cut else a for a, b in zip(rows, changed)]

    def until_cut(data):
        averages = windows.station_trailing_avg(typed_trips(spark.createDataFrame(data, fx.TRIP_DDL)), 7, 90.0)
        return {tuple(r) for r in averages.where(F.col("start_date_trunc") <= F.lit(cut)).collect()}

    assert until_cut(rows) == until_cut(mixed)


@pytest.mark.parametrize("partitions", [1, 7])
def test_result_does_not_depend_on_partitioning(spark, trips, partitions):
    expected = sorted(windows.station_trailing_avg(trips, 7, 90.0).collect(), key=str)
    got = sorted(windows.station_trailing_avg(trips.repartition(partitions, "seq_id"), 7, 90.0).collect(), key=str)
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    assert all(a[2] == pytest.approx(b[2], rel=1e-12) if b[2] is not None else a[2] is None for a, b in zip(got, expected))


def test_only_day_rows_reach_the_window(spark, trips):
    plan = windows.station_trailing_avg(trips, 7, 90.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("HashAggregate")  # printed top-down: aggregated below the window
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_group_lag(frame):
    df = frame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30)], "k STRING, o INT, v INT")
    got = {(r.k, r.o): r.v_lag1 for r in windows.group_lag(df, ["k"], "o", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 2): 10, ("b", 1): None}


def test_daily_trend_is_the_mean_of_daily_means(frame):
    day = lambda i: dt.date(2012, 1, 1) + dt.timedelta(days=2 * i)
    rows = [(day(i), float(v)) for i in range(9) for v in range(i, 2 * i + 1)] + [(None, 5.0)]
    got = {r.start_date_trunc: r for r in windows.daily_trend(frame(rows, "start_date_trunc DATE, duration_min DOUBLE")).collect()}
    means = [1.5 * i for i in range(9)]
    assert len(got) == 9
    for i in range(9):
        value = got[day(i)].duration_min_7davg
        assert value is None if i < 6 else value == pytest.approx(np.mean(means[i - 6 : i + 1]))


def test_reading_gaps(frame):
    t0 = dt.datetime(2012, 1, 31, 22)
    hours = [0, 1, 1, 1, 5, 30, 24 * 60]  # a repeated time, and steps over days and months
    df = frame([(t0 + dt.timedelta(hours=h),) for h in hours], "DATE TIMESTAMP_NTZ")
    got = sorted(tuple(r) for r in windows.reading_gaps(df).collect())
    expected = [(0, 1, None), (1, 3, 1.0), (5, 1, 4.0), (30, 1, 25.0), (24 * 60, 1, 24 * 60 - 30.0)]
    assert got == [(t0 + dt.timedelta(hours=h), n, gap) for h, n, gap in expected]


def test_a_row_for_each_reading_matches_pandas(spark):
    t0 = dt.datetime(2012, 1, 1)
    hours = [0] * 3 + [2] + [7] * 70_000 + [8]
    df = spark.createDataFrame([(t0 + dt.timedelta(hours=h), n) for h, n in ((0, 3), (2, 1), (7, 70_000), (8, 1))], "DATE TIMESTAMP_NTZ, n INT")
    df = df.withColumn("_", F.explode(F.expr("sequence(1, n)"))).select("DATE").repartition(3)
    gaps = windows.reading_gaps(df, each_reading=True).groupBy("DATE_delta_hours").count().collect()
    expected = pd.Series(hours).diff().value_counts(dropna=False)
    assert {r.DATE_delta_hours: r["count"] for r in gaps} == {None if pd.isna(k) else k: v for k, v in expected.items()}


def test_reading_gaps_per_station(frame):
    rows = [("a", dt.datetime(2012, 1, 1, 1, 10)), ("a", dt.datetime(2012, 1, 1, 1, 40)), ("b", dt.datetime(2012, 1, 1, 2))]
    got = {(r.s, r.t.hour, r.t.minute): r.t_delta_hours for r in windows.reading_gaps(frame(rows, "s STRING, t TIMESTAMP_NTZ"), "t", ["s"]).collect()}
    assert got == {("a", 1, 10): None, ("a", 1, 40): 0.5, ("b", 2, 0): None}


def test_daily_features_equal_the_training_feature(trips):
    """Refreshed before its first trip, an active day gets the value of the training table."""
    table = windows.station_trailing_avg(trips, 7, 90.0).where("strt_statn = 30 AND avg_duration_prev_7days IS NOT NULL")
    for row in table.orderBy("start_date_trunc").collect()[::6]:
        fresh = windows.daily_station_features(trips, row.start_date_trunc).where("strt_statn = 30").first()
        assert fresh.avg_duration_prev_7days == pytest.approx(row.avg_duration_prev_7days)


def test_daily_features_fallback(trips):
    day = dt.date(2012, 3, 7)
    plain = {r.strt_statn: r.avg_duration_prev_7days for r in windows.daily_station_features(trips, day).collect()}
    filled = {r.strt_statn: r.avg_duration_prev_7days for r in windows.daily_station_features(trips, day, fallback_to_global=True).collect()}
    before = trips.where((F.col("start_date_trunc") < F.lit(day)) & (F.col("duration_min") <= 90)).toPandas()
    assert set(plain.values()) == {None} and plain.keys() == filled.keys()
    assert all(v == pytest.approx(before.duration_min.mean()) for v in filled.values())

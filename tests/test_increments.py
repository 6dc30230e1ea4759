"""Tables kept up to date: audits while writing, months, station states, sketches, co-located joins, variants."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ridecast.operators import cleaning, sketches, windows
from ridecast.operators.joins import attach_station_avg
from ridecast.plans.prepare import typed_trips
from ridecast.schemas import TRAINING
from ridecast.session import materialise
from ridecast.sources import colocated, files, refresh
from tests import fixtures as fx


@pytest.fixture(scope="module")
def trips(spark):
    return typed_trips(spark.createDataFrame(fx.station_trips() + fx.edge_trips(), fx.TRIP_DDL)).cache()


def training_rows(spark, months, per_month=20, shift=0.0):
    rows = [
        (m * 1000 + i, dt.datetime(2012, m, 1 + i, 8), i % 5, i % 3, 1.0 + i + shift, i % 2, None if i % 7 == 0 else 9.0, 0.0, 1.0, 0.0, 0, int(i % 6 > 0))
        for m in months
        for i in range(per_month)
    ]
    return spark.createDataFrame(rows, TRAINING).repartition(3)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def month_files(path, month):
    return {f.name: f.read_bytes() for f in Path(path, f"start_month={month}").glob("*.parquet")}


STEPS = (cleaning.KeepFlag("has_precip_data"), cleaning.TrimQuantile("duration_min", 0.9), cleaning.DropNulls(("avg_duration_prev_7days",)))


@pytest.mark.parametrize("steps", [STEPS, STEPS[::2]])
def test_audit_while_writing(spark, tmp_path, steps):
    table, path = training_rows(spark, (6, 7)), str(tmp_path / "cleaned")
    got = cleaning.clean_and_audit(table, lambda df: files.write_training(df, path, files_per_month=None), steps)
    assert sorted_rows(got) == sorted_rows(cleaning.audit(table, steps))
    assert sorted_rows(files.read_training(spark, path)) == sorted_rows(cleaning.clean(table, steps))


def test_audit_while_writing_an_empty_table(spark, tmp_path):
    got = cleaning.clean_and_audit(training_rows(spark, ()), lambda df: df.write.parquet(str(tmp_path / "none")), STEPS)
    assert [(r["removed"], r["total"]) for r in got.collect()] == [(0, 0)] * 3


def test_a_month_is_written_again_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "training")
    refresh.refresh_training(training_rows(spark, (5, 6, 7)), path, ["2012-05", "2012-06", "2012-07"])
    before = {m: month_files(path, m) for m in ("2012-05", "2012-07")}
    changed = training_rows(spark, (6,), 12, 0.5)
    for _ in range(2):
        refresh.refresh_training(changed, path, ["2012-06"])
        assert {m: month_files(path, m) for m in before} == before
        assert sorted_rows(files.read_training(spark, path, months=["2012-06"])) == sorted_rows(changed)
        assert refresh.months_to_redo(spark, path).collect() == []
    assert files.read_training(spark, path).count() == 52


def test_a_month_without_rows_is_emptied_and_other_months_are_refused(spark, tmp_path):
    path = str(tmp_path / "training")
    refresh.refresh_training(training_rows(spark, (5, 6)), path, ["2012-05", "2012-06"])
    refresh.refresh_training(training_rows(spark, ()), path, ["2012-06"])
    assert files.read_training(spark, path).count() == 20 and refresh.months_to_redo(spark, path).collect() == []
    with pytest.raises(Exception, match="not refreshed: 2012-06"):
        refresh.refresh_training(training_rows(spark, (5, 6)), path, ["2012-05"])


def test_a_refresh_that_was_cut_off_shows(spark, tmp_path):
    path = str(tmp_path / "training")
    refresh.refresh_training(training_rows(spark, (5, 6)), path, ["2012-05", "2012-06"])
    lost = next(Path(path, "start_month=2012-05").glob("*.parquet"))
    Path(lost.parent, f".{lost.name}.crc").unlink()
    lost.unlink()
    with pytest.raises(Exception, match="not refreshed"):  # its commit is withdrawn before anything is written
        refresh.refresh_training(training_rows(spark, (5,)), path, ["2012-06"])
    found = {r["start_month"]: (r["rows"] < 20, r["committed"]) for r in refresh.months_to_redo(spark, path).collect()}
    assert found == {"2012-05": (True, 20), "2012-06": (False, None)}
    refresh.refresh_training(training_rows(spark, (5, 6)), path, ["2012-05", "2012-06"])
    assert refresh.months_to_redo(spark, path).collect() == []


@pytest.mark.parametrize("window,cap", [(7, 90.0), (2, None)])
def test_daily_arrivals_give_the_batch_average(spark, trips, window, cap):
    days = sorted({r[0] for r in trips.select(windows.DAY).distinct().collect() if r[0] is not None})
    cuts = [days[:-6], *([day] for day in days[-6:])]  # the past at once, then day by day
    state, got = windows.empty_station_state(spark), []
    for cut in cuts:
        features, after = windows.advance_stations(state, trips.where(F.col(windows.DAY).isin(cut)), window, cap)
        got += features.collect()
        state = materialise(after, "state")
    assert sorted(got, key=repr) == sorted(windows.station_trailing_avg(trips, window, cap).collect(), key=repr)
    assert state.groupBy(windows.STATION).count().agg(F.max("count")).first()[0] <= window
    features, after = windows.advance_stations(state, trips.where("false"), window, cap)
    assert features.collect() == [] and sorted_rows(after) == sorted_rows(state)
    with pytest.raises(Exception, match="not after the state"):
        windows.advance_stations(state, trips.where(F.col(windows.DAY) == F.lit(days[-1])), window, cap)[0].collect()


def test_sketches_merge_and_take_one_pass(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 700).alias("few"), (F.col("id") % 9).alias("month"), F.lit(None).cast("string").alias("none"), (F.col("id") % 50).cast("double").alias("real"))
    columns = ["id", "few", "none", "real"]
    kept = sketches.distinct_sketches(df, columns, ["month"])
    assert "Expand" not in kept._jdf.queryExecution().executedPlan().toString()
    got = {r["column"]: r["estimate"] for r in sketches.distinct_estimates(kept, columns).collect()}
    for name, exact in {"id": 20_000, "few": 700, "none": 0, "real": 50}.items():
        assert abs(got[name] - exact) <= 3 * sketches.STANDARD_ERROR * exact, name
    none = sketches.distinct_estimates(sketches.distinct_sketches(df.where("false"), columns, ["month"]), columns)
    assert {r["estimate"] for r in none.collect()} == {0}


def test_colocated_tables_join_without_a_shuffle(spark, trips):
    averages = windows.station_trailing_avg(trips, 2, 90.0)
    keys = [windows.STATION, windows.DAY]
    left, right = (colocated.write_colocated(df, name, keys, 4) for df, name in ((trips, "trips"), (averages, "averages")))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_station_avg(left, right)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" in plan
        assert sorted_rows(joined.select(*trips.columns, "avg_duration_prev_7days")) == sorted_rows(attach_station_avg(trips, averages).select(*trips.columns, "avg_duration_prev_7days"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_bodies_of_any_shape(spark):
    bodies = {
        1: '{"dow": 1.50, "is_registered": true, "x": null, "deep": {"list": [1, {"k": "v"}]}}', 2: '{"dow": {"k": 1}, "HPCP": [0]}',
        3: "[1]", 4: "no json", 5: None, 6: '{"dow": 3, "dow": 4}', 7: "{}", 8: '{"dow": "3", "HPCP": 1e-3, "has_trace": null}', 9: "null", 10: "",
    }
    df = files.parse_request_variants(spark.createDataFrame(list(bodies.items()), "request_id long, body string"))
    got = {r["request_id"]: r for r in df.withColumn("deep", F.try_variant_get(F.col("extra")["deep"], "$.list[1].k", "string")).withColumn("names", F.map_keys("extra")).drop("extra").collect()}
    assert (got[1]["dow"], got[1]["is_registered"], got[1]["deep"], sorted(got[1]["names"])) == ("1.5", "true", "v", ["deep", "x"])
    assert (got[2]["dow"], got[2]["HPCP"], got[2]["names"]) == ('{"k":1}', "[0]", [])
    assert {i: got[i]["raw"] for i in got} == {i: bodies[i] if i in (3, 4, 6, 9, 10) else None for i in bodies}
    assert (got[8]["dow"], float(got[8]["HPCP"]), got[8]["has_trace"]) == ("3", 0.001, None)
    assert all(got[i][name] is None for i in (3, 4, 5, 6, 7, 9, 10) for name in ("dow", "HPCP", "has_trace"))

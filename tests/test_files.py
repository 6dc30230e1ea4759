import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridecast import schemas
from ridecast.session import materialise, shared_folder
from ridecast.sources import files
from tests import fixtures as fx

TRIP_HEADER = "seq_id,hubway_id,status,duration,start_date,strt_statn,end_date,end_statn,bike_nr,subsc_type,zip_code,birth_date,gender"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_trips_csv(spark, tmp_path):
    path = write(
        tmp_path / "trips.csv",
        TRIP_HEADER,
        "1,8,closed,9,7/28/2011 10:12:00,23,7/28/2011 10:12:00,23,B00468,Registered,'97217,1976,Male",
        '2,9,closed,,7/28/2011 10:21:00,23.0,7/28/2011 10:21:00,,"B,1",Casual,,,',
    )
    rows = files.read_trips(spark, path).orderBy("seq_id").collect()
    assert rows[0].zip_code == "'97217" and rows[0].birth_date == 1976 and rows[0].strt_statn == 23
    assert rows[1].strt_statn == 23 and rows[1].end_statn is None and rows[1].duration is None
    assert rows[1].bike_nr == "B,1" and rows[1].gender is None
    df = files.read_trips(spark, path)
    assert [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in schemas.TRIPS.fields]


def test_column_order_and_extra_columns_of_a_file(spark, tmp_path):
    path = write(
        tmp_path / "stations.csv",
        "status,id,terminal,station,municipal,lng,lat,extra",
        "Existing,3,B32006,Colleges of the Fenway,Boston,-71.1,42.3,x",
    )
    row = files.read_stations(spark, path).first()
    assert row.asDict() == dict(
        id=3, terminal="B32006", station="Colleges of the Fenway", municipal="Boston", lat=42.3, lng=-71.1, status="Existing"
    )


def test_missing_column_and_bad_value_fail(spark, tmp_path):
    with pytest.raises(ValueError, match="gender"):
        files.read_trips(spark, write(tmp_path / "a.csv", TRIP_HEADER.replace(",gender", "")))
    bad = write(tmp_path / "b.csv", "id,terminal,station,municipal,lat,lng,status", "one,t,s,m,1.0,2.0,Existing")
    with pytest.raises(Exception):
        files.read_stations(spark, bad).collect()


def test_a_fraction_is_no_whole_number(spark, tmp_path):
    line = "1,8,closed,9,7/28/2011 10:12:00,23.7,7/28/2011 10:12:00,23,B,Registered,,1976,Male"
    with pytest.raises(Exception, match="strt_statn is not a whole number: 23.7"):
        files.read_trips(spark, write(tmp_path / "trips.csv", TRIP_HEADER, line)).collect()


TEXTS = ['Fan "Pier", East', 'say ""x""', " padded ", "", None, "back\\slash", "'quoted'", '"', "a,b", "#1", "\ttab\t"]


def test_text_round_trip(spark, tmp_path):
    rows = [(i, "t", text, text, 1.0, 2.0, "Existing") for i, text in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, schemas.STATIONS)
    files.write_csv(df, str(tmp_path / "a"))
    back = files.read_stations(spark, str(tmp_path / "a")).orderBy("id").collect()
    assert [r.station for r in back] == TEXTS and [r.municipal for r in back] == TEXTS


def test_line_breaks_need_multi_line(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", "two\nlines, \"q\"", "m", 1.0, 2.0, "Existing")], schemas.STATIONS)
    with pytest.raises(Exception, match="line break"):
        files.write_csv(df, str(tmp_path / "a"))
    files.write_csv(df, str(tmp_path / "b"), multi_line=True)
    assert files.read_stations(spark, str(tmp_path / "b"), multi_line=True).collect() == df.collect()


def test_malformed_requests_keep_their_text(spark, tmp_path):
    from ridecast.plans import scoring

    good = '{"request_id": 1, "avg_duration_prev_7days": "3", "HPCP": 0, "dow": 1, "is_registered": true, "has_trace": false}'
    path = write(tmp_path / "requests.json", good, "not json", '{"dow": ')
    batch = scoring.validate(files.read_requests(spark, path)).select("request_id", "raw", "reasons", "is_valid")
    rows = {r.raw: r for r in batch.collect()}
    assert rows[None].is_valid and rows[None].request_id == 1
    for text in ("not json", '{"dow": '):
        assert rows[text].reasons == ["body: not valid JSON"] and not rows[text].is_valid
    stream = files.stream_requests(spark, str(tmp_path)).writeStream.format("memory").queryName("malformed").trigger(availableNow=True).start()
    stream.awaitTermination()
    again = scoring.validate(spark.table("malformed")).select("request_id", "raw", "reasons", "is_valid")
    assert sorted(map(str, again.collect())) == sorted(map(str, batch.collect()))
    bodies = spark.createDataFrame([(1, good), (2, "not json"), (3, None)], "id INT, body STRING")
    parsed = {r.id: r for r in scoring.validate(files.parse_request_bodies(bodies)).collect()}
    assert parsed[1].is_valid and parsed[2].raw == "not json" and parsed[2].reasons == ["body: not valid JSON"]
    assert len(parsed[3].reasons) == 5


def test_numbers_of_requests(spark):
    from ridecast.functions import flags

    texts = ["1d", "2f", "0x10", "NaN", "Infinity", "1e999", " 1.5 ", "-2", ".5", "5.", "1e2", "true", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = [r.n for r in rows.select("i", flags.to_number(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [None] * 6 + [1.5, -2.0, 0.5, 5.0, 100.0, 1.0, None, None]


def test_weather_csv(spark, tmp_path):
    path = write(
        tmp_path / "weather.csv",
        "STATION,STATION_NAME,ELEVATION,LATITUDE,LONGITUDE,DATE,HPCP,Measurement_Flag,Quality_Flag",
        "COOP:190770,BOSTON,6.1,42.36057,-71.00975,20110729 13:00,0.00,T,",
    )
    row = files.read_weather(spark, path).first()
    assert (row.DATE, row.HPCP, row.Measurement_Flag, row.Quality_Flag) == ("20110729 13:00", 0.0, "T", None)


TRAINING_ROWS = [
    (1, dt.datetime(2012, 3, 1, 10, 5), 3, None, 12.5, 1, None, 0.0, 1.0, 0.1, 0, 1),
    (2, dt.datetime(2012, 4, 2, 0, 0), 4, 9, 3.25, 0, 14.125, 0.5, -0.5, 0.0, 1, 0),
]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("files_per_month", [None, 2])
def test_training_round_trip(spark, tmp_path, fmt, files_per_month):
    df = spark.createDataFrame(TRAINING_ROWS, schemas.TRAINING)
    path = str(tmp_path / "training")
    files.write_training(df, path, fmt, files_per_month=files_per_month)
    back = files.read_training(spark, path, fmt)
    assert sorted(back.collect()) == sorted(df.collect())
    assert [(f.name, f.dataType) for f in back.schema.fields] == [(f.name, f.dataType) for f in schemas.TRAINING.fields]


def test_training_csv_of_other_tools(spark, tmp_path):
    path = write(
        tmp_path / "training.csv",
        ",".join(schemas.TRAINING.names),
        "7,2012-03-01 10:05:00,23.0,,12.5,1,,0.0,1.0,0.1,0.0,1",
    )
    row = files.read_training(spark, path, "csv").first()
    assert (row.strt_statn, row.end_statn, row.has_trace, row.start_date) == (23, None, 0, dt.datetime(2012, 3, 1, 10, 5))


def test_months_prune_folders(spark, tmp_path):
    path = str(tmp_path / "training")
    files.write_training(spark.createDataFrame(TRAINING_ROWS, schemas.TRAINING), path)
    df = files.read_training(spark, path, months=["2012-04"]).select("seq_id")
    assert [r.seq_id for r in df.collect()] == [2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(start_month" in plan or "start_month#" in plan.split("PartitionFilters")[1][:60]


def test_search_results_round_trip(spark, tmp_path):
    row = (0.75, 20, 1, 10, 0.5, 5, *[float(i) for i in range(10)])
    path = str(tmp_path / "search")
    files.write_csv(spark.createDataFrame([row], schemas.SEARCH), path)
    assert [tuple(r) for r in files.read_search(spark, path).collect()] == [row]


def test_requests_and_bodies(spark, tmp_path):
    path = write(
        tmp_path / "requests.json",
        '{"request_id": 1, "avg_duration_prev_7days": 13.5, "HPCP": 0.2, "dow": 5, "is_registered": false, "has_trace": false}',
        '{"request_id": 2, "dow": "5", "is_registered": "yes"}',
    )
    rows = files.read_requests(spark, path).orderBy("request_id").collect()
    assert tuple(rows[0])[:6] == (1, "13.5", "0.2", "5", "false", "false") and rows[0].raw is None
    assert tuple(rows[1])[:6] == (2, None, None, "5", "yes", None)
    bodies = spark.createDataFrame([(9, '{"HPCP": 0.2, "dow": 5}')], "offset INT, body STRING")
    row = files.parse_request_bodies(bodies).first()
    assert (row.offset, row.HPCP, row.dow, row.has_trace) == (9, "0.2", "5", None)


def test_rows_to_frame(spark):
    df = files.rows_to_frame(spark, [{"id": "m", "mae": 1.0}], schemas.SCORES)
    assert tuple(df.first()) == ("m", 1.0, None, None, None, None)


def test_materialise_writes_below_the_shared_folder(spark):
    df = materialise(spark.range(10).withColumn("x", F.lit(1.5)), "numbers")
    assert df.count() == 10
    assert spark.conf.get("spark.checkpoint.dir") == shared_folder(spark)
    assert all(shared_folder(spark) in name for name in df.inputFiles())


def test_projection_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "training")
    files.write_training(spark.createDataFrame(TRAINING_ROWS, schemas.TRAINING), path)
    df = files.read_training(spark, path).where("has_precip_data = 1").select("duration_min")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(has_precip_data,1)" in plan
    assert "ReadSchema: struct<duration_min:double,has_precip_data:int>" in plan


def test_fixture_trips_read_back(spark, tmp_path):
    df = spark.createDataFrame(fx.edge_trips(), fx.TRIP_DDL)
    files.write_csv(df, str(tmp_path / "t"))
    assert sorted(map(str, files.read_trips(spark, str(tmp_path / "t")).collect())) == sorted(map(str, df.collect()))

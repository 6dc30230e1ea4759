"""File round trips, parsing, score tables, samples, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridecast.functions import times
from ridecast.operators import metrics, sampling
from ridecast.operators.windows import station_trailing_avg
from ridecast.plans import prepare, search
from ridecast.plans.training import baseline
from ridecast.schemas import METRICS, SEARCH, STATIONS, TARGET, TRAINING, TRIPS, WEATHER
from ridecast.session import materialise, new_shared_path
from ridecast.sources import driver_tables as src
from ridecast.sources import files
from ridecast_queries.preparation import cleaned, training, with_fixed
from ridecast_queries.registry import fp, query

_KEY = ["seq_id"]


@query(
    "parse_trip_time",
    """SELECT event_id, strftime(ts, '%-m/%-d/%Y %-H:%M:%S') AS text, date_trunc('minute', ts) AS start_date,
              CAST(ts AS DATE) AS start_day FROM events""",
)
def parse_trip_time(spark, sf):
    text = src.table(spark, sf, "events").select("event_id", F.date_format("ts", "M/d/yyyy H:mm:ss").alias("text"))
    return text.select(
        "event_id",
        "text",
        times.parse_trip_time(F.col("text")).alias("start_date"),
        times.parse_trip_date(F.col("text")).alias("start_day"),
    )


@query(
    "parse_weather_time",
    "SELECT event_id, strftime(ts, '%Y%m%d %H:%M') AS text, date_trunc('minute', ts) AS parsed FROM events",
)
def parse_weather_time(spark, sf):
    text = src.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd HH:mm").alias("text"))
    return text.withColumn("parsed", times.parse_weather_time(F.col("text")))


@query(
    "parse_iso_time",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, date_trunc('second', ts) AS parsed FROM events",
)
def parse_iso_time(spark, sf):
    text = src.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"))
    return text.withColumn("parsed", times.parse_iso_time(F.col("text")))


@query(
    "csv_roundtrip_trips",
    """SELECT * REPLACE (strftime(start_date, '%-m/%-d/%Y %-H:%M:%S') AS start_date,
                         strftime(end_date, '%-m/%-d/%Y %-H:%M:%S') AS end_date) FROM raw""",
)
def csv_roundtrip_trips(spark, sf):
    path = new_shared_path(spark, "trips-csv")
    files.write_csv(src.trip_file_rows(spark, sf), path)
    return files.read_trips(spark, path).select(*TRIPS.names)


@query(
    "csv_roundtrip_weather",
    """SELECT 'COOP:190770' AS "STATION", 'MAIN' AS "STATION_NAME", CAST(6.1 AS DOUBLE) AS "ELEVATION",
              CAST(42.36 AS DOUBLE) AS "LATITUDE", CAST(-71.01 AS DOUBLE) AS "LONGITUDE",
              strftime("DATE", '%Y%m%d %H:%M') AS "DATE", "HPCP",
              CASE WHEN has_trace = 1 THEN 'T' END AS "Measurement_Flag", CAST(NULL AS VARCHAR) AS "Quality_Flag" FROM wx""",
)
def csv_roundtrip_weather(spark, sf):
    path = new_shared_path(spark, "weather-csv")
    files.write_csv(src.weather_file_rows(spark, sf), path)
    return files.read_weather(spark, path).select(*WEATHER.names)


@query(
    "csv_roundtrip_stations",
    """SELECT CAST(s_suppkey AS INTEGER) AS id, 'T' || s_suppkey AS terminal, n_name AS station, n_name AS municipal,
              42 + s_suppkey % 64 / CAST(64 AS DOUBLE) AS lat, -71 - s_suppkey % 32 / CAST(32 AS DOUBLE) AS lng,
              CASE WHEN s_acctbal >= 0 THEN 'Existing' ELSE 'Removed' END AS status
       FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def csv_roundtrip_stations(spark, sf):
    path = new_shared_path(spark, "stations-csv")
    files.write_csv(src.stations(spark, sf), path)
    return files.read_stations(spark, path).select(*STATIONS.names)


_TRAINING_SQL = f"""SELECT seq_id, start_date, strt_statn, end_statn, duration_min, is_registered, avg_duration_prev_7days,
                    {fp("dow_sin", "dow_sin")}, {fp("dow_cos", "dow_cos")}, "HPCP", has_trace, has_precip_data FROM training"""


@query("training_roundtrip_parquet", _TRAINING_SQL)
def training_roundtrip_parquet(spark, sf):
    path = new_shared_path(spark, "training")
    files.write_training(training(spark, sf), path)
    return with_fixed(files.read_training(spark, path), "dow_sin", "dow_cos").select(*TRAINING.names)


@query("training_roundtrip_csv", _TRAINING_SQL)
def training_roundtrip_csv(spark, sf):
    path = new_shared_path(spark, "training-csv")
    files.write_training(training(spark, sf), path, "csv")
    return with_fixed(files.read_training(spark, path, "csv"), "dow_sin", "dow_cos").select(*TRAINING.names)


@query("station_averages_written", f"""SELECT seq_id, strt_statn, avg_duration_prev_7days FROM prep""")
def station_averages_written(spark, sf):
    raw, path = src.trips(spark, sf), new_shared_path(spark, "station-averages")
    files.write_station_averages(station_trailing_avg(prepare.typed_trips(raw), 7, 90.0), path)
    prepared = prepare.prepare_trips(raw, station_avg=files.read_station_averages(spark, path))
    return prepared.select("seq_id", "strt_statn", "avg_duration_prev_7days")


def scores_sql(view: str, truth: str, predicted: str, keys: str) -> str:
    group = f"{keys}, " if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {group}{fp("avg(abs(e))", "mae")}, {fp("quantile_cont(abs(e), 0.5)", "medae")}, {fp("avg(e * e)", "mse")},
                      {fp("sqrt(avg(e * e))", "rmse")}, {fp("1 - sum(e * e) / (count(*) * var_pop(t))", "r2")}
               FROM (SELECT *, {truth} AS t, {truth} - {predicted} AS e FROM {view}) x {tail}"""


@query("baseline_scores", scores_sql("cleaned", "duration_min", "avg_duration_prev_7days", "").replace("SELECT ", "SELECT 'baseline' AS id, ", 1))
def baseline_scores(spark, sf):
    scores = metrics.score_row(baseline(cleaned(spark, sf)), TARGET, "prediction", "baseline")
    return with_fixed(scores, *METRICS)


@query("group_scores", scores_sql("pairs", "y", "y_hat", "model"))
def group_scores(spark, sf):
    return with_fixed(metrics.regression_scores(src.score_pairs(spark, sf), "y", "y_hat", ["model"]), *METRICS)


_SETS = ["max_depth", "n_estimators"]
_FOLD_SQL = """SELECT max_depth, n_estimators, fold, avg(abs(e)) AS mae, quantile_cont(abs(e), 0.5) AS medae,
                      avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (count(*) * var_pop(t)) AS r2
               FROM (SELECT *, y AS t, y - y_hat AS e FROM pairs) x GROUP BY 1, 2, 3"""
_SPREAD = ", ".join(fp(f"avg({m})", f"{m}_avg") + ", " + fp(f"stddev_pop({m})", f"{m}_std") for m in METRICS)


def _set_scores(spark, sf):
    return metrics.regression_scores(src.score_pairs(spark, sf), "y", "y_hat", [*_SETS, "fold"])


def _spread_names():
    return [f"{m}_{kind}" for m in METRICS for kind in ("avg", "std")]


@query(
    "search_table",
    f"""SELECT max_depth AS regressor__max_depth, n_estimators AS regressor__n_estimators, {_SPREAD}
        FROM ({_FOLD_SQL}) f GROUP BY 1, 2""",
)
def search_table(spark, sf):
    return with_fixed(search.search_results(_set_scores(spark, sf)), *_spread_names())


@query(
    "search_file_roundtrip",
    f"""SELECT max_depth AS regressor__max_depth, n_estimators AS regressor__n_estimators, {_SPREAD}
        FROM ({_FOLD_SQL}) f GROUP BY 1, 2""",
)
def search_file_roundtrip(spark, sf):
    """Search results written to the results file and read back."""
    results = with_fixed(search.search_results(_set_scores(spark, sf)), *_spread_names())
    path = new_shared_path(spark, "search-csv")
    absent = [f for f in SEARCH.fields if f.name not in results.columns]
    full = results.withColumns({f.name: F.lit(0).cast(f.dataType) for f in absent}).select(*SEARCH.names)
    files.write_csv(full, path)
    return files.read_search(spark, path).drop(*[f.name for f in absent])


@query(
    "search_top10",
    f"""SELECT max_depth, n_estimators, {fp("medae_avg", "medae_avg")} FROM (
          SELECT max_depth, n_estimators, avg(medae) AS medae_avg FROM ({_FOLD_SQL}) f GROUP BY 1, 2
          ORDER BY 3, 1, 2 LIMIT 10) t""",
)
def search_top10(spark, sf):
    best = metrics.best_first(metrics.search_table(_set_scores(spark, sf), _SETS), "medae", 10)
    return with_fixed(best.select(*_SETS, "medae_avg"), "medae_avg")


def _score_tables(spark, sf):
    """The scores of every model, scored once by group, and again under another id."""
    scores = metrics.regression_scores(src.score_pairs(spark, sf), "y", "y_hat", ["model"])
    scores = materialise(scores.withColumnRenamed("model", "id"), "model-scores")
    return [scores, scores, scores.withColumn("id", F.concat("id", F.lit(" again")))]


_BY_MODEL = scores_sql("pairs", "y", "y_hat", "model")


@query(
    "stack_scores",
    f"""WITH s AS ({_BY_MODEL}) SELECT model AS id, mae, medae, mse, rmse, r2 FROM s
        UNION ALL SELECT model || ' again', mae, medae, mse, rmse, r2 FROM s""",
)
def stack_scores(spark, sf):
    return with_fixed(metrics.stack_scores(*_score_tables(spark, sf)), *METRICS)


@query("stack_scores_by_value", f"SELECT mae, medae, mse, rmse, r2 FROM ({_BY_MODEL}) s")
def stack_scores_by_value(spark, sf):
    stacked = metrics.stack_scores(*_score_tables(spark, sf), ignore_id=True)
    return with_fixed(stacked, *METRICS).select(*METRICS)


def hash_sql(kind: str, key: str = "seq_id", seed: int = 1, salt: str = "") -> str:
    """The SQL twin of `sampling.row_hash` for one key."""
    return f"CAST('0x' || substr(md5('{kind}|{salt}|{seed}|' || {key}), 1, 12) AS BIGINT)"


def share_sql(kind: str, seed: int = 1, salt: str = "") -> str:
    return f"{hash_sql(kind, seed=seed, salt=salt)} / CAST({1 << 48} AS DOUBLE)"


@query("sample_15", f"SELECT * FROM ({_TRAINING_SQL}) t WHERE {share_sql('sample')} < CAST(0.15 AS DOUBLE)")
def sample_15(spark, sf):
    drawn = sampling.sample_fraction(training(spark, sf), 0.15, _KEY, seed=1)
    return with_fixed(drawn, "dow_sin", "dow_cos").select(*TRAINING.names)


@query(
    "sample_15_exact",
    "SELECT CAST(round_even(count(*) * CAST(0.15 AS DOUBLE), 0) AS BIGINT) AS rows_drawn, CAST(0 AS BIGINT) AS repeated FROM typed",
)
def sample_15_exact(spark, sf):
    drawn = sampling.sample_exact(prepare.typed_trips(src.trips(spark, sf)), 0.15, _KEY, seed=1)
    rows = F.count(F.lit(1))
    return drawn.agg(rows.alias("rows_drawn"), (rows - F.count_distinct("seq_id")).alias("repeated"))


@query(
    "split_80_20",
    f"SELECT *, CASE WHEN {share_sql('split')} < CAST(0.2 AS DOUBLE) THEN 'test' ELSE 'train' END AS split FROM ({_TRAINING_SQL}) t",
)
def split_80_20(spark, sf):
    marked = sampling.with_split(training(spark, sf), _KEY, 0.2, seed=1)
    return with_fixed(marked, "dow_sin", "dow_cos").select(*TRAINING.names, "split")


@query(
    "split_80_20_exact",
    """SELECT 'test' AS split, CAST(ceil(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS trips FROM typed
       UNION ALL
       SELECT 'train', count(*) - CAST(ceil(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) FROM typed""",
)
def split_80_20_exact(spark, sf):
    marked = sampling.with_split(prepare.typed_trips(src.trips(spark, sf)), _KEY, 0.2, seed=1, exact=True)
    return marked.groupBy("split").agg(F.count(F.lit(1)).alias("trips"))


@query("folds_4", f"SELECT *, CAST({hash_sql('fold')} % 4 AS INTEGER) AS fold FROM ({_TRAINING_SQL}) t")
def folds_4(spark, sf):
    folds = sampling.hash_folds(training(spark, sf), _KEY, 4, seed=1)
    return with_fixed(folds, "dow_sin", "dow_cos").select(*TRAINING.names, "fold")


@query(
    "sampling_chain",
    f"""WITH s AS (SELECT seq_id, {hash_sql("split")} AS h FROM typed WHERE {share_sql("sample")} < CAST(0.5 AS DOUBLE)),
            f AS (SELECT seq_id, {share_sql("split")} < CAST(0.2 AS DOUBLE) AS test FROM s),
            v AS (SELECT seq_id, {share_sql("split", salt="validation")} < CAST(0.25 AS DOUBLE) AS valid FROM f WHERE NOT test),
            e AS (SELECT seq_id, row_number() OVER (ORDER BY h, seq_id)
                                 <= CAST(ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) AS BIGINT) AS exact_test FROM s)
       SELECT f.seq_id, CASE WHEN f.test THEN 'test' ELSE 'train' END AS split, e.exact_test,
              CASE WHEN f.test THEN NULL WHEN v.valid THEN 'test' ELSE 'train' END AS validation,
              CAST({hash_sql("fold", key="f.seq_id")} % 4 AS INTEGER) AS fold
       FROM f LEFT JOIN v ON f.seq_id = v.seq_id JOIN e ON f.seq_id = e.seq_id""",
)
def sampling_chain(spark, sf):
    """A sample that is split twice, split exactly, and dealt into folds."""
    drawn = sampling.sample_fraction(prepare.typed_trips(src.trips(spark, sf)), 0.5, _KEY, seed=1).select("seq_id")
    exact = sampling.with_split(drawn, _KEY, 0.2, seed=1, exact=True).select("seq_id", (F.col("split") == "test").alias("exact_test"))
    marked = sampling.with_split(drawn, _KEY, 0.2, seed=1)
    train = marked.where(F.col("split") == "train").drop("split")
    inner = sampling.with_split(train, _KEY, 0.25, seed=1, salt="validation").withColumnRenamed("split", "validation")
    folds = sampling.hash_folds(marked, _KEY, 4, seed=1)
    return folds.join(inner, "seq_id", "left").join(exact, "seq_id").select("seq_id", "split", "exact_test", "validation", "fold")


@query(
    "sampling_chain_shares",
    """SELECT part, CAST(0 AS BIGINT) AS repeated, TRUE AS within_bounds FROM (VALUES ('sample'), ('split of sample'),
              ('split of train'), ('fold 0 of test'), ('sample of test')) t(part)""",
)
def sampling_chain_shares(spark, sf):
    """Each step of a chain takes its own share of what the step before left, within five deviations."""
    trips = prepare.typed_trips(src.trips(spark, sf)).select("seq_id")
    drawn = sampling.sample_fraction(trips, 0.5, _KEY, seed=1)
    train, test = sampling.train_test(drawn, _KEY, 0.2, seed=1)
    inner = sampling.train_test(train, _KEY, 0.25, seed=1, salt="validation")[1]
    fold = sampling.hash_folds(test, _KEY, 4, seed=1).where("fold = 0").drop("fold")
    again = sampling.sample_fraction(sampling.train_test(trips, _KEY, 0.2, seed=1)[1], 0.5, _KEY, seed=1)
    steps = [
        ("sample", trips, drawn, 0.5),
        ("split of sample", drawn, test, 0.2),
        ("split of train", train, inner, 0.25),
        ("fold 0 of test", test, fold, 0.25),
        ("sample of test", sampling.train_test(trips, _KEY, 0.2, seed=1)[1], again, 0.5),
    ]
    rows = F.count(F.lit(1))
    out = None
    for name, whole, part, share in steps:
        counts = part.agg(rows.alias("part_rows"), (rows - F.count_distinct("seq_id")).alias("repeated"))
        row = whole.agg(rows.alias("whole_rows")).crossJoin(F.broadcast(counts))
        spread = F.sqrt(F.col("whole_rows") * F.lit(share * (1 - share)))
        near = F.abs(F.col("part_rows") - F.col("whole_rows") * F.lit(share)) <= 5.0 * spread + 1
        row = row.select(F.lit(name).alias("part"), "repeated", near.alias("within_bounds"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "search_draws",
    """SELECT CAST(60 AS BIGINT) AS draws, CAST(0 AS BIGINT) AS repeated, CAST(864 AS BIGINT) AS sets, CAST(0 AS BIGINT) AS outside,
              count(*) AS trips FROM typed""",
)
def search_draws(spark, sf):
    """The 60 draws from the full grid, next to the number of trips they would be fitted on."""
    grid = search.parameter_grid(spark)
    drawn = search.draw_parameters(grid)
    rows = F.count(F.lit(1))
    counts = drawn.agg(rows.alias("draws"), (rows - F.count_distinct(*grid.columns)).alias("repeated"))
    outside = drawn.join(grid, grid.columns, "left_anti").agg(rows.alias("outside"))
    trips = prepare.typed_trips(src.trips(spark, sf)).agg(rows.alias("trips"))
    return counts.crossJoin(grid.agg(rows.alias("sets"))).crossJoin(outside).crossJoin(F.broadcast(trips))


@query(
    "csv_roundtrip_text",
    """SELECT doc_id AS id, source AS terminal, replace(replace(text, chr(10), ' '), chr(13), ' ') AS station,
              CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE ' "a", b\\ ' END AS municipal, lang AS status
       FROM documents""",
)
def csv_roundtrip_text(spark, sf):
    """Whole documents as station names: quotes, commas, backslashes, blanks, empty text and nulls."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    third = F.col("doc_id") % 3
    rows = docs.select(
        F.col("doc_id").cast("int").alias("id"),
        F.col("source").alias("terminal"),
        F.translate("text", "\n\r", "  ").alias("station"),
        F.when(third == 0, F.lit(None)).when(third == 1, "").otherwise(' "a", b\\ ').alias("municipal"),
        F.lit(0.5).alias("lat"),
        F.lit(0.5).alias("lng"),
        F.col("lang").alias("status"),
    ).select(*STATIONS.names)
    path = new_shared_path(spark, "text-csv")
    files.write_csv(rows, path)
    back = files.read_stations(spark, path)
    return back.select(F.col("id").cast("bigint").alias("id"), "terminal", "station", "municipal", "status")


@query(
    "folds_4_contiguous",
    "SELECT seq_id, CAST(ntile(4) OVER (ORDER BY seq_id) - 1 AS INTEGER) AS fold FROM typed",
)
def folds_4_contiguous(spark, sf):
    trips = prepare.typed_trips(src.trips(spark, sf))
    return sampling.contiguous_folds(trips, "seq_id", 4).select("seq_id", "fold")

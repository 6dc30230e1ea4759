"""Scans and sinks with explicit schemas; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridecast import schemas

# Files written by other tools store a whole number with missing values as `23.0`.
_LOOSE = {"strt_statn", "end_statn", "birth_date", "has_trace", "has_precip_data", "is_registered"}
_CSV_TIME = "yyyy-MM-dd HH:mm:ss"
RAW, EXTRA = "raw", "extra"
_REQUEST_AND_RAW = T.StructType([*schemas.REQUEST.fields, T.StructField(RAW, T.StringType())])
# Quotes are doubled and blanks kept. Empty text is written as `""` and null as nothing; the reader's
# mark for null must then be no text that occurs.
_NULL_IN_READ = "\0"
_CSV_TEXT = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _file_schema(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """The declared fields in the order of the file's header (which is all that is read)."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [field.name for field in schema.fields if field.name not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    declared = {
        field.name: T.DoubleType() if field.name in _LOOSE else field.dataType for field in schema.fields
    }
    return T.StructType([T.StructField(name, declared.get(name, T.StringType())) for name in header])


def _whole(name: str) -> Column:
    """A whole number that was read as a double; a fraction is refused, not cut."""
    column = F.col(name)
    refusal = F.raise_error(F.concat(F.lit(f"{name} is not a whole number: "), column.cast("string")))
    return F.when(column.isNull() | (column == F.floor(column)), column).otherwise(refusal.cast("double"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """CSV with a header; values that do not fit the schema fail, as does another header.

    Empty text in quotes is empty text, no text at all is null. `multi_line` allows line
    breaks within quotes; such files cannot be split among tasks.
    """
    reader = (
        spark.read.schema(_file_schema(spark, path, schema))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("timestampNTZFormat", _CSV_TIME)
        .option("multiLine", multi_line)
        .option("nullValue", _NULL_IN_READ)
        .options(**_CSV_TEXT)
    )
    declared = [
        (_whole(field.name) if field.name in _LOOSE else F.col(field.name)).cast(field.dataType).alias(field.name)
        for field in schema.fields
    ]
    return reader.csv(path).select(*declared)


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.TRIPS)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.WEATHER)


def read_stations(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_csv(spark, path, schemas.STATIONS, multi_line)


def read_search(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.SEARCH)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", multi_line: bool = False) -> None:
    """CSV that `read_csv` reads back as it was, blanks, quotes and empty text included.

    Without `multi_line` a text with a line break is refused, as files are read by the line.
    """
    if not multi_line:
        texts = [field.name for field in df.schema.fields if isinstance(field.dataType, T.StringType)]
        broken = F.raise_error(F.lit("a line break in a text needs multi_line=True")).cast("string")
        df = df.withColumns({n: F.when(F.col(f"`{n}`").rlike(r"[\n\r]"), broken).otherwise(F.col(f"`{n}`")) for n in texts})
    df.write.mode(mode).option("header", True).option("timestampNTZFormat", _CSV_TIME).options(**_CSV_TEXT).csv(path)


def write_training(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", files_per_month: int | None = 8
) -> None:
    """Training table as Parquet by start month, or as one CSV table.

    `files_per_month` gathers the rows of a month in that many files; a hot month is
    spread over all of them. With None each task writes a file for each month it holds,
    without a shuffle.
    """
    if fmt == "csv":
        write_csv(df.select(*schemas.TRAINING.names), path, mode)
        return
    month = F.date_format(F.col("start_date").cast("date"), "yyyy-MM")
    out = df.select(*schemas.TRAINING.names, month.alias("start_month"))
    if files_per_month:
        slot = F.pmod(F.xxhash64("seq_id"), F.lit(files_per_month))
        out = out.repartition(F.col("start_month"), slot)
    out.write.mode(mode).partitionBy("start_month").parquet(path)


def read_training(
    spark: SparkSession, path: str, fmt: str = "parquet", months: Sequence[str] | None = None
) -> DataFrame:
    """Training table; `months` (`2012-07`) prunes the Parquet folders."""
    if fmt == "csv":
        return read_csv(spark, path, schemas.TRAINING)
    partitioned = T.StructType([*schemas.TRAINING.fields, T.StructField("start_month", T.StringType())])
    df = spark.read.schema(partitioned).parquet(path)
    if months is not None:
        df = df.where(F.col("start_month").isin(list(months)))
    return df.select(*schemas.TRAINING.names)


def write_station_averages(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Station-day averages as a table of their own, written once a day."""
    df.write.mode(mode).parquet(path)


def read_station_averages(spark: SparkSession, path: str) -> DataFrame:
    """The averages with the size that Spark's broadcast check needs."""
    return spark.read.parquet(path)


def _with_raw(df: DataFrame) -> DataFrame:
    """No field of a malformed record is kept, only its text."""
    fields = {n: F.when(F.col(RAW).isNull(), F.col(n)) for n in schemas.REQUEST_FIELDS}
    return df.withColumns(fields)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, every field as its raw text; a line that is no JSON is kept in `raw`."""
    return _with_raw(spark.read.schema(_REQUEST_AND_RAW).option("columnNameOfCorruptRecord", RAW).json(path))


def stream_requests(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream of arriving files."""
    reader = spark.readStream.schema(_REQUEST_AND_RAW).option("columnNameOfCorruptRecord", RAW)
    return _with_raw(reader.option("maxFilesPerTrigger", files_per_trigger).json(path))


def parse_request_bodies(df: DataFrame, body: str = "body") -> DataFrame:
    """Request bodies held in a text column (a message queue, say) -> raw request fields.

    A body that is no JSON object is kept in `raw`; its fields are null.
    """
    fields = T.StructType([*[schemas.REQUEST[name] for name in schemas.REQUEST_FIELDS], T.StructField(RAW, T.StringType())])
    parsed = F.from_json(body, fields, {"columnNameOfCorruptRecord": RAW})
    rest = [name for name in df.columns if name != body]
    return _with_raw(df.select(*rest, parsed.alias("_request")).select(*rest, "_request.*"))


def parse_request_variants(df: DataFrame, body: str = "body") -> DataFrame:
    """Request bodies of any shape -> raw request fields and `extra`, the unknown fields as variants.

    A field of a wrong type (an object, say) keeps its JSON text, which the validation refuses;
    a JSON null is a missing field. A number's text is that of its value: `1.50` gives `1.5`.
    A body that is no JSON object, or that has a field twice, is kept in `raw`; its fields and
    `extra` are null, and for a null body `raw` is too.
    """
    rest = [name for name in df.columns if name != body]
    whole = df.withColumn("_fields", F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>"))
    known = list(schemas.REQUEST_FIELDS)
    texts = [F.try_variant_get(F.col("_fields")[name], "$", "string").alias(name) for name in known]
    return whole.select(
        *rest,
        *texts,
        F.when(F.col("_fields").isNull(), F.col(body)).alias(RAW),
        F.map_filter("_fields", lambda name, _: ~name.isin(known)).alias(EXTRA),
    )


def rows_to_frame(spark: SparkSession, rows: Sequence[dict], schema: T.StructType) -> DataFrame:
    """A few rows given as dictionaries; a missing key becomes null."""
    return spark.createDataFrame([tuple(row.get(name) for name in schema.names) for row in rows], schema)

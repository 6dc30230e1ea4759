"""The training table refreshed month by month, so that a month can be written again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ridecast import schemas
from ridecast.session import delete_path

MONTH = "start_month"
#: Folder of the committed numbers of rows; Spark's readers skip names that begin like this.
COMMITTED = "_months"


def _overwrite_months(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def refresh_training(df: DataFrame, path: str, months: Sequence[str], files_per_month: int = 8) -> None:
    """Replace whole months (`2012-07`) of a training table by the rows of `df`.

    Other months are not touched, and a second run leaves the same rows. A row of a month that
    is not named is refused; a named month without rows is emptied. Each month's number of rows
    is committed after its files, so a run that was cut off shows in `months_to_redo`.
    """
    spark, months = df.sparkSession, sorted(set(months))
    month = F.date_format(F.col("start_date").cast("date"), "yyyy-MM")
    refusal = F.raise_error(F.concat(F.lit("a row of a month that is not refreshed: "), F.coalesce(month, F.lit("null"))))
    out = df.select(*schemas.TRAINING.names, F.when(month.isin(months), month).otherwise(refusal.cast("string")).alias(MONTH))
    out = out.repartition(F.col(MONTH), F.pmod(F.xxhash64("seq_id"), F.lit(files_per_month)))
    for name in months:
        delete_path(spark, f"{path}/{COMMITTED}/{MONTH}={name}")
    # Behind the shuffle, so that a stage that runs again does not count twice.
    seen = Observation()
    counts = [F.count_if(F.col(MONTH) == name).alias(name) for name in months]
    _overwrite_months(out.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), path)
    found = seen.get  # one number a named month
    for name in months:
        if not found[name]:
            delete_path(spark, f"{path}/{MONTH}={name}")
    committed = spark.createDataFrame([(name, found[name]) for name in months], f"{MONTH} string, rows bigint")
    _overwrite_months(committed.coalesce(1), f"{path}/{COMMITTED}")


def months_to_redo(spark: SparkSession, path: str) -> DataFrame:
    """Months whose rows are not the committed ones: start_month, rows, committed (null: never)."""
    schema = f"{MONTH} string, rows bigint"
    committed = spark.read.schema(schema).parquet(f"{path}/{COMMITTED}").select(F.col(MONTH).alias("_month"), F.col("rows").alias("committed"))
    present = spark.read.schema(f"seq_id bigint, {MONTH} string").parquet(path).groupBy(MONTH).agg(F.count(F.lit(1)).alias("rows"))
    both = present.join(committed, F.col(MONTH) == F.col("_month"), "full")
    rows = F.coalesce("rows", F.lit(0))
    return both.select(F.coalesce(MONTH, "_month").alias(MONTH), rows.alias("rows"), "committed").where(
        F.col("committed").isNull() | (F.col("committed") != F.col("rows"))
    )

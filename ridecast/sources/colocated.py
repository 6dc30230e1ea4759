"""Tables stored by the hash of their keys, so that joins on the keys move no rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridecast.session import new_shared_path


def write_colocated(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The rows in as many files as buckets, sorted by the keys, as a table of the catalog.

    Two tables with equal keys (of equal types) and buckets are joined without a shuffle. Take
    so many buckets that one of the larger table fits a task; keys must spread the rows, as a
    key's rows share a bucket.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, *[F.col(key) for key in keys])
    writer = placed.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", new_shared_path(spark, table))
    writer.saveAsTable(table)
    return spark.table(table)
